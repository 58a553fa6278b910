import json

from pyspark.sql import functions as F

from ledgerloom.engine import Engine, likely_targets, upload_error, writer_passages
from ledgerloom.sources.fixtures import ground_truth, scale_corpus
from ledgerloom.sources.index import build_index
from ledgerloom.sources.results import read_manifest, write_results


def test_generated_archive_end_to_end(spark, tmp_path):
    corpus = scale_corpus(spark, 20).cache()
    rows = corpus.collect()
    assert len({r.source for r in rows}) == 20 and sum(r.superseded for r in rows) == 1
    folder = tmp_path / "in"
    folder.mkdir()
    for r in rows:
        (folder / r.source).write_text(r.content)
    build_index(spark, str(folder), str(tmp_path / "ix"))
    e = Engine.open(spark, str(tmp_path / "ix"))
    inv = [r for r in rows if r.doc_type == "invoice"]
    got = e.aggregate("sum", column="Nettobetrag (EUR)", doc_type="invoice")
    assert abs(got.value - sum(r.amount for r in inv)) < 0.01 and got.n_documents == len(inv)
    hits, dropped = e.search(rows[0].ref)
    assert not dropped and hits.first().source == rows[0].source
    assert e.attach("s", "x.exe", b"a", 0) == "unsupported format"
    assert e.attach("s", "note.txt", b"private note on " + rows[0].ref.encode(), 0) is None
    both = e.search_with_session("s", rows[0].ref, 1).collect()
    assert both[0].scope == "session" and {h.scope for h in both} == {"session", "knowledge_base"}
    assert e.inventory().count() == 20 and e.stats().first().n_documents == 20


def test_questions_and_results(spark, tmp_path):
    corpus = scale_corpus(spark, 60)
    q = ground_truth(corpus, 4)
    assert {r.kind: r["count"] for r in q.groupBy("kind").count().collect()} == {"verbatim_control": 4, "exact_identifier": 4, "paraphrase": 4, "type_synonym": 4, "amount_lookup": 2}
    assert likely_targets(q, 3).count() == 3
    full = write_results(q, str(tmp_path), "r", expected=18)
    assert write_results(q.limit(3), str(tmp_path), "r", expected=18) == full + ".partial"
    assert spark.read.option("header", "true").csv(full).count() == 18
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"documents": [{"source": "a"}], "queries": [{"id": "1", "expect_source": "a"}]}))
    docs, queries = read_manifest(spark, str(m))
    assert (docs.count(), queries.first().expect_source) == (1, "a")


def test_budgets_and_guards(spark):
    e = spark.createDataFrame([(i, "x" * 500) for i in range(20)], "nr int, text string")
    assert writer_passages(e, "nr", 1600).count() == 3
    assert upload_error("a.csv", b"") == "empty file" and upload_error("a.csv", b"x") is None and upload_error("a.csv", b"xx", 1) == "file too large"
