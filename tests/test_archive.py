import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.engine import Engine, write_report
from ledgerloom.operators import metrics as M
from ledgerloom.operators import records as R
from ledgerloom.session import cut, scratch, shared_dir
from ledgerloom.sources.index import build_index, read_index
from ledgerloom.sources.results import append_audit, scrub_files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    (root / "Rechnung_2024.csv").write_text("Rechnungsnummer;Nettobetrag (EUR);Datum\nRE-1;1.000,50;02.01.2024\nRE-2;2.000,00;05.02.2024\nSumme;3.000,50;\n")
    (root / "notiz.md").write_text("# Elbe\n\nDie Lieferung an die Elbe wurde bezahlt.\n\n# Rhein\n\nÜber den Rhein ging nichts.")
    return root


def test_index_with_postings_and_inventory_text(spark, folder, tmp_path):
    index = f"{tmp_path}/index"
    assert build_index(spark, f"file://{folder}", index)["new"] == 2
    e = Engine.open(spark, index)
    for q in ("Elbe", "Rhein Lieferung", "RE-2"):
        stored, _ = e.search(q, channel="lexical")
        e.postings, kept = None, e.postings
        plain, _ = e.search(q, channel="lexical")
        e.postings = kept
        assert [(r.element_id, round(r.score, 6)) for r in stored.collect()] == [(r.element_id, round(r.score, 6)) for r in plain.collect()] != []
    text = e.list_documents()
    assert "Rechnung_2024.csv | invoice | 2024" in text and "Nettobetrag (EUR) [amount]" in text and "2 rows" in text and "WARNING" not in text
    assert "no document" in e.list_documents(year="1999")
    # a file that vanishes takes its postings with it, one that stays is not indexed twice
    (folder / "notiz.md").rename(tmp_path / "away.md")
    assert build_index(spark, f"file://{folder}", index) == {"new": 0, "unchanged": 1, "pruned": 1}
    left = read_index(spark, index)["postings"]
    assert left.where("term = 'elbe'").count() == 0 and left.groupBy("id", "term").count().where("count > 1").count() == 0
    (tmp_path / "away.md").rename(folder / "notiz.md")


def test_append_and_scrub(spark, tmp_path):
    log = f"{tmp_path}/audit"
    entries = lambda *ts: spark.createDataFrame([(t, "x", dt.datetime(2024, 1, n + 1)) for n, t in enumerate(ts)], "thread_id string, action string, created_at timestamp_ntz")
    assert append_audit(entries("a", "b"), log) == 2 and append_audit(entries("b", "a", "b"), log) == 3 and append_audit(entries("a").where("false"), log) == 0
    assert [(r.id, r.thread_id) for r in spark.read.parquet(log).orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "b"), (4, "a"), (5, "b")]
    assert [r.id for r in R.audit_trail(spark.read.parquet(log), "b").collect()] == [2, 3, 5]
    other = f"{tmp_path}/other"
    spark.range(3).write.parquet(other)
    assert scrub_files(spark, {"audit": log, "other": other}, "b") == {"audit": 3}
    assert {r.id for r in spark.read.parquet(log).collect()} == {1, 4} and spark.read.parquet(other).count() == 3
    assert scrub_files(spark, {"audit": log}, "b") == {"audit": 0}


def test_report_is_tried_again_with_less(spark):
    ev = spark.createDataFrame([(i, "x" * 600) for i in range(20)], "rank int, text string")
    seen = []

    def write(passages):
        seen.append([len(p) for p in passages])
        return "" if len(seen) == 1 else "done"

    assert write_report(ev, "rank", 100_000, write) == "done" and seen == [[600] * 12, [400] * 6]
    assert write_report(ev.where("false"), "rank", 10, lambda p: "") == ""


def test_summaries_of_few_and_no_cases(spark):
    schema = "answer_hit boolean, misattributed boolean, retrieval_hit boolean, ungrounded_count int, refusal_correct boolean, s double"
    df = spark.createDataFrame([(True, False, None, 0, None, 0.5), (False, None, True, None, None, None), (None, None, None, None, True, 1.0), (None, None, None, None, None, None)], schema)
    got = {r.metric: (r.hits, r.of, r.share) for r in M.grounding_summary(df).collect()}
    assert got == {"answer_accuracy": (1, 2, 0.5), "misattributed_rate": (0, 2, 0.0), "ungrounded_cases": (0, 2, 0.0), "retrieval_hit_rate": (1, 1, 1.0), "refusal_correct": (1, 1, 1.0)}
    assert {r.share for r in M.grounding_summary(df.where("false")).collect()} == {None}
    assert [(r.n, r.mean, r.reached) for r in M.metric_means(df, {"s": 0.7}).collect()] == [(2, 0.75, True)]
    assert [r.reached for r in M.metric_means(df.where("false"), {"s": 0.7}).collect()] == [False]
    assert M.answer_summary(df, ["answer_hit"]).first().answer_hit == 0.25 and M.answer_summary(df.where("false"), ["answer_hit"]).count() == 0


def test_scratch_leaves_nothing(spark):
    import os

    root = shared_dir(spark).removeprefix("file://")
    kept = cut(spark.range(3), "kept")
    before = set(os.listdir(root))
    with scratch(spark):
        assert cut(spark.range(5), "gone").count() == 5 and len(os.listdir(root)) > len(before)
    assert set(os.listdir(root)) == before and kept.count() == 3


def test_conditions(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(12)], "doc_id string")
    chunks = spark.createDataFrame([(f"d{i}",) for i in range(12) for _ in range(2)], "doc_id string")
    grid = R.evaluation_conditions(docs, chunks, docs.where("doc_id in ('d1')"), docs.where("doc_id in ('d1', 'd2')"), {"6": 6})
    got = {r.condition: sorted(r.d) for r in grid.groupBy("condition").agg(F.collect_set("doc_id").alias("d")).collect()}
    assert got["targets-only"] == ["d1"] and got["confusable-only"] == ["d1", "d2"] and len(got["disjoint@max"]) == 11 and "d2" not in got["disjoint@max"]
    assert len(got["disjoint@6"]) == 3 and "d2" not in got["disjoint@6"] and len(got["both@6"]) == 3 and {"d1", "d2"} < set(got["both@6"])
