import hashlib
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import records as R
from ledgerloom.operators.metrics import first_ranks, retrieval_metrics
from ledgerloom.operators.retrieval import bm25_stored, bm25_topk, dense_topk, dense_topk_many, folded_tokens, fuse, postings, search, search_or_unfiltered
from ledgerloom.streaming.sessions import SessionRegistry, accepted_uploads, illegal_changes, last_status, sessions

CHUNKS = [
    (1, "d1", "Umsatzerlöse der Elbe Spedition", [1.0, 0.0], "ledger", "2024"), (2, "d1", "umsatzerlose Elbe Elbe", [0.9, 0.1], "ledger", "2025"), (3, "d2", "Rechnung RE-2024-53005", [0.0, 1.0], "invoice", "2024"),
    (4, "d3", None, None, "invoice", None), (5, None, "", [0.0, 0.0], "ledger", "2024"), (6, "d4", "nichts", [1.0], "ledger", "2024"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "id long, doc_id string, text string, embedding array<float>, doc_type string, year string").cache()


def test_dense(chunks):
    assert [r.id for r in dense_topk(chunks, [1.0, 0.0], 10).collect()] == [1, 2, 3]
    assert [r.id for r in dense_topk(chunks, [1.0, 0.0], 10, F.col("year") == "2024").collect()] == [1, 3]


def test_dense_of_many_queries(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal((90, 6)), np.repeat(rng.standard_normal((1, 6)), 20, axis=0)])
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)]
    df = spark.createDataFrame(rows + [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0] * 5), (204, [float("nan")] * 6)], "id long, embedding array<double>")
    q = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = {(r["query"], r.id): r["rank"] for r in dense_topk_many(df, q, 4, block=5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(0, len(v), 10):
        s = np.round(u @ u[i], 12)
        want |= {(i, int(j)): n for n, j in enumerate([j for j in np.lexsort((np.arange(len(v)), -s)) if j != i][:4], 1)}
    assert got == want
    assert dense_topk_many(df, q.where("false"), 4).count() == 0 and dense_topk_many(df.where("false"), q, 4).count() == 0


def test_lexical(chunks):
    assert [r.id for r in bm25_topk(chunks, "Elbe?").collect()] == [2, 1]
    assert {r.id for r in bm25_topk(chunks, "Umsatzerlöse").collect()} == {1, 2}
    assert bm25_topk(chunks, "? -").count() == 0
    index = postings(chunks)
    assert index.where("term = 'elbe'").agg(F.sum("tf")).first()[0] == 3
    lengths = chunks.select("id", F.size(folded_tokens(F.col("text"))).alias("n_tokens"))
    for q in ("Elbe?", "Umsatzerlöse elbe Elbe", "? -"):
        assert [(r.id, round(r.score, 9)) for r in bm25_stored(index, lengths, q).collect()] == [(r.id, round(r.score, 9)) for r in bm25_topk(chunks, q).collect()]


def test_fusion_and_search(chunks):
    hits = search(chunks, "RE-2024-53005 Elbe", [1.0, 0.0], k=3).collect()
    assert hits[0].rank == 1 and {h.scope for h in hits} == {"knowledge_base"} and len(hits) == 3
    assert [h.id for h in search(chunks, "Elbe", None, channel="lexical").collect()] == [2, 1]
    got, unfiltered = search_or_unfiltered(chunks, "Elbe", [1.0, 0.0], year="1999")
    assert unfiltered and got.count() > 0
    a = chunks.select("id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    tie = fuse(a.where("id = 3"), a.where("id = 1"), 2).collect()
    assert [r.id for r in tie] == [3, 1]  # dense first


def test_inventory_and_sets(spark, chunks):
    docs = spark.createDataFrame([("d1", "a", "ledger", "2024"), ("d9", "b", "other", "")], "doc_id string, source string, doc_type string, year string")
    assert {(r.doc_id, r.n_chunks) for r in R.inventory(docs, chunks).collect()} == {("d1", 2), ("d9", 0)}
    s = R.index_stats(docs, chunks).first()
    assert (s.n_documents, s.n_chunks, s.n_embedded, s.beyond_envelope, s.years) == (2, 6, 5, False, ["2024"])
    new, same, gone = R.changed(docs.select("doc_id"), spark.createDataFrame([("d1",), ("d5",)], "doc_id string"), "doc_id")
    assert ([r.doc_id for r in new.collect()], [r.doc_id for r in same.collect()], [r.doc_id for r in gone.collect()]) == (["d9"], ["d1"], ["d5"])
    both = R.scoped_union(chunks.select("id", F.lit(1).alias("rank")).where("id = 3"), chunks.select("id", F.lit(1).alias("rank")).where("id < 3"))
    assert [r.scope for r in both.collect()] == ["session", "knowledge_base", "knowledge_base"]
    sub = R.padded_subset(docs, chunks, docs.where("doc_id = 'd1'"), 2)
    assert {r.doc_id for r in sub.collect()} == {"d1", "d9"}
    left = R.scrub({"a": docs.withColumn("thread_id", F.col("doc_id")), "b": docs}, "d1")
    assert left["a"].count() == 1 and left["b"].count() == 2


def test_metrics(spark):
    hits = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 3), ("q3", "x", 1)], "query_id string, source string, rank int")
    want = spark.createDataFrame([("q1", "b", "k"), ("q2", "c", "k"), ("q3", "y", "m")], "query_id string, expect_source string, kind string")
    got = {r.kind: (r.n, r.hit_at_1, r.recall_at_k, r.mrr) for r in retrieval_metrics(first_ranks(hits, want)).collect()}
    assert got["all"] == (3, 0.0, 0.666667, 0.277778) and got["m"] == (1, 0.0, 0.0, 0.0)


def test_sessions(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    e = spark.createDataFrame([(1, at(0)), (1, at(60)), (1, at(121)), (2, at(5)), (None, at(1)), (2, None)], "user_id long, ts timestamp_ntz")
    assert sorted((r.user, r.n_events) for r in sessions(e).collect()) == [(1, 1), (1, 2), (2, 1)]
    u = spark.createDataFrame([("s", "a", 1, 10, 1), ("s", "a", 2, 10, 1), ("s", "b", 3, 0, 0), ("s", "c", 4, 10, 9), ("s", "d", 5, 10, 1)], "session_id string, digest string, uploaded_at int, n_bytes long, n_chunks long")
    got = {r.uploaded_at: r.accepted for r in accepted_uploads(u, max_files=2, max_bytes=100, max_chunks=5).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}
    c = spark.createDataFrame([("t", 1, "running", 1), ("t", 2, "completed", 2), ("t", 3, "running", 3), ("u", 1, "failed", 4)], "thread string, ts int, status string, n int")
    assert {(r.thread, r.status) for r in last_status(c, "thread", "ts", "status", "n").collect()} == {("t", "running"), ("u", "failed")}
    assert {r.n for r in illegal_changes(c, "thread", "ts", "status", "n").collect()} == {3, 4}


def test_session_registry(spark):
    r = SessionRegistry(ttl=10)
    r.add("a", "chunks", spark.range(2), now=0)
    r.add("a", "chunks", spark.range(1), now=1)
    assert r.frames["a"]["chunks"].count() == 3
    r.bind("t", "a")
    assert r.reap(20) == ["a"] and not r.frames and not r.threads


def test_padding_with_documents_without_passages(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(30)], "doc_id string")
    chunks = spark.createDataFrame([("d3",), ("d3",), ("d17",), ("d21",), ("d21",)], "doc_id string")
    targets = docs.where("doc_id = 'd3'")
    n = {"d3": 2, "d17": 1, "d21": 2}
    for budget in (1, 2, 3, 4, 9):
        want, total = {"d3"}, 2
        for _, d in sorted((hashlib.md5(f"0:d{i}".encode()).hexdigest(), f"d{i}") for i in range(30) if i != 3):
            total += n.get(d, 0)
            want |= {d} if total <= budget else set()
        assert {r.doc_id for r in R.padded_subset(docs, chunks, targets, budget).collect()} == want
