import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import neardup
from ledgerloom.llm.neardup import components, link_counts, near_duplicates, record_groups, record_pairs, token_sets
from ledgerloom.llm.nearest import nearest_vectors
from ledgerloom.llm.similar import similar_vectors
from ledgerloom.llm.words import words


def shingles(t, k):
    w = words(t or "")
    return frozenset(zip(*[w[i:] for i in range(k)]))


@pytest.mark.parametrize("k, threshold", [(3, 0.6), (5, 0.8)])
def test_near_duplicates_against_brute_force(spark, k, threshold):
    r = random.Random(k)
    vocab = [f"w{i}ß" if i % 7 == 0 else f"Wort{i}" for i in range(400)]
    rows = []
    for i in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(20, 700))]
        for _ in range(r.randint(1, 4)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 25))):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append(" ".join(t))
    rows += [rows[0].upper().replace("SS", "ß"), rows[1], rows[1] + " _ ", "kurz", "", None, "a " * 40, "a " * 50, "b c " * 30]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(1, rows[1], "x"), (None, rows[1], "x")], "id long, text string, class_a string")
    classes, links = near_duplicates(df, "id", "text", threshold, k)
    got = {(p.id_a, p.id_b) for p in record_pairs(classes, links).collect()}
    sets = {i: shingles(t, k) for i, t in enumerate(rows) if t and len(words(t)) >= 20}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    assert got == want
    counts = {c.id: c for c in link_counts(classes, links).collect()}
    assert set(counts) == set(sets) and counts[1].n_copies >= 2
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, j in want:
        root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {g.id: (g.group_id, g.n_group) for g in record_groups(classes, links).collect()}
    assert groups == {i: (top(i), sum(top(j) == top(i) for j in sets)) for i in sets}
    none = near_duplicates(df.where("false"), "id", "text")
    assert none[1].count() == 0 and record_groups(*none).count() == 0


def test_components(spark):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500 + i, 500) for i in range(1, 90)]
    edges = chain + star + [(r.randrange(30), r.randrange(30)) for _ in range(18)] + [(7, 7), (101, 100)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_token_sets_are_those_of_words():
    texts = ["Ein Wort, noch_ein Wort - und É 12.", "", None, "eins zwei drei eins zwei drei", "\0 a\0b c d"]
    s = token_sets(texts, 2, 1)
    assert dict(zip(s.rows.tolist(), s.sizes.tolist())) == {i: len(shingles(t, 2)) for i, t in enumerate(texts) if shingles(t, 2)}


def test_order_tells_rare_tokens_in_a_large_table():
    """Tokens of ten records rank behind nearly all tokens of one record, of which there are eight million."""
    rng = np.random.default_rng(5)
    rare, common = (rng.integers(0, 1 << neardup.TOKEN_BITS, n, dtype=np.uint64) for n in (8_000_000, 20_000))
    places = neardup.sketch_place(np.concatenate([rare, np.repeat(common, 10)]))
    rank = neardup.rarity(np.bincount(places, minlength=1 << neardup.SKETCH_BITS))
    least = np.quantile(rank[neardup.sketch_place(rare)], 0.9)
    assert (rank[neardup.sketch_place(common)] > least).mean() > 0.95


def test_matrix_opens_what_may_be_similar():
    """Texts of common phrases with a third of tokens of their own: few pairs are opened, none is lost, and the matrix does not grow with its parts."""
    rng = np.random.default_rng(7)
    phrases = rng.integers(0, 1 << neardup.TOKEN_BITS, (60, 12), dtype=np.uint64)
    sets = []
    for _ in range(400):
        own = rng.integers(0, 1 << neardup.TOKEN_BITS, rng.integers(20, 60), dtype=np.uint64)
        common = phrases[rng.permutation(60)[: 1 + len(own) // 6]].ravel()
        sets.append(np.unique(np.concatenate([own, common])))
    sets += [np.unique(np.concatenate([x[: int(f * len(x))], rng.integers(0, 1 << neardup.TOKEN_BITS, 5, dtype=np.uint64)])) for x, f in zip(sets[:120], np.linspace(0.5, 1, 120))]
    s = neardup.Sets(np.arange(len(sets)), np.cumsum([len(x) for x in sets]), np.concatenate(sets))
    rare = neardup.rarity(np.bincount(neardup.sketch_place(s.tokens), minlength=1 << neardup.SKETCH_BITS))
    sig = neardup.signatures(s)[0]
    want = {tuple(sorted((sig[i], sig[j]))) for i in range(len(sets)) for j in range(i) if (k := len(np.intersect1d(sets[i], sets[j], assume_unique=True))) >= 0.6 * (len(sets[i]) + len(sets[j]) - k) - 1e-9}
    assert len(want) > 60
    for parts in (1, 7, 500):
        rows = list(neardup.matrix_parts(s, sig, rare, 0.6, parts))
        assert sum(len(x) for row in rows for x in row[1:]) <= 24 * sum(len(x) - int(np.ceil(0.6 * len(x) - 1e-9)) + 3 for x in sets)
        got = {(a, b) for row in rows for x, y in neardup.open_groups(*([x] for x in row[1:]), 0.6, block=50) for a, b in zip(x.tolist(), y.tolist())}
        assert want <= got and len(got) < 2 * len(want) + 100
    shared = [np.array(x) for x in zip(*[(i, j) for i in range(130) for j in range(400, 520)])]
    bits = pa.array(neardup.bitmaps(s), pa.binary())
    ok = neardup.reach(s.sizes[shared[0]], s.sizes[shared[1]], bits.take(pa.array(shared[0])), bits.take(pa.array(shared[1])), 0.6)
    assert want & {tuple(sorted((sig[i], sig[j]))) for i, j in zip(*shared)} <= {tuple(sorted((sig[i], sig[j]))) for i, j in zip(shared[0][ok], shared[1][ok])} and ok.mean() < 0.2


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 8))
    v = np.concatenate([base + 0.05 * rng.standard_normal(base.shape) for _ in range(5)] + [base[:1]] * 40)
    doc = [f"d{i % 23}" if i % 9 else None for i in range(len(v))]
    rows = [(i, d, [float(x) for x in e], "x") for i, (d, e) in enumerate(zip(doc, v))]
    bad = [(9001, "q", None, "x"), (9002, "q", [], "x"), (9003, "q", [1.0] * 7, "x"), (9004, "q", [0.0] * 8, "x"), (9005, "q", [float("nan")] * 8, "x"), (9006, "q", [float("inf")] + [1.0] * 7, "x"), (None, "q", [1.0] * 8, "x"), rows[5], (9007, " D1 ", rows[1][2], "x")]
    df = spark.createDataFrame(rows + bad, "id long, doc_id string, embedding array<float>, nth string")
    got = {(r.id, r.neighbour) for r in similar_vectors(df, dim=8, k=4, least=0.9, leaf_rows=100, sample=50).collect()}
    allrows = [(i, (d or ""), np.float32(e).astype(float)) for i, d, e, _ in rows] + [(9007, "d1", np.float32(rows[1][2]).astype(float))]
    want = set()
    for i, d, e in allrows:
        c = sorted((-round(float(e @ f / np.linalg.norm(e) / np.linalg.norm(f)), 12), j) for j, g, f in allrows if g != d and j != i)
        want |= {(i, j) for s, j in c[:4] if -s >= 0.9}
    assert len(got & want) / len(want) > 0.97 and len(got) == len(want)
    assert similar_vectors(df.where("false"), dim=8, least=0.9).count() == 0


def test_similar_vectors_in_a_dense_cluster(spark):
    """A third of the rows lie close together, in more leaves than one."""
    rng = np.random.default_rng(4)
    n, dim = 9000, 64
    v = rng.standard_normal((n, dim))
    v[::3] = 5 * rng.standard_normal(dim) + rng.standard_normal((n // 3, dim))
    df = spark.createDataFrame([(i, f"d{i // 2}", [float(x) for x in e]) for i, e in enumerate(v)], "id long, doc_id string, embedding array<float>")
    got = {(r.id, r.neighbour) for r in similar_vectors(df, least=0.9, leaf_rows=2000).collect()}
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = set()
    for i in range(0, n, 30):
        s = u @ u[i]
        s[[j for j in (i - i % 2, i - i % 2 + 1) if j < n]] = -1
        want |= {(i, int(j)) for j in np.argsort(-s)[:10] if s[j] >= 0.9}
    assert len(want) > 2000 and len(got & want) / len(want) > 0.995


def test_similar_vectors_of_a_row_among_many_of_its_document(spark):
    """One of 60 near passages of a document has a copy in another one; its neighbours elsewhere are further off than the 60."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    v = np.concatenate([base + 0.01 * rng.standard_normal((60, 16)), base + 0.1 * rng.standard_normal((15, 16))])
    v = np.concatenate([v, v[:1]]).astype(np.float32).astype(float)
    doc = ["heavy"] * 60 + [f"d{i}" for i in range(15)] + ["copy"]
    df = spark.createDataFrame([(i, d, [float(x) for x in e]) for i, (d, e) in enumerate(zip(doc, v))], "id long, doc_id string, embedding array<float>")
    got = {(r.id, r.neighbour) for r in similar_vectors(df, dim=16, least=0.9).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(len(v)) for j in sorted((j for j in range(len(v)) if doc[j] != doc[i] and s[i, j] >= 0.9), key=lambda j: (-round(s[i, j], 12), j))[:10]}
    assert got == want


def nearest_by_brute_force(ids, docs, v, asked, k):
    """Neighbours of each asked row, and what is as similar as the k-th."""
    u = np.asarray(v, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for i in asked:
        s = u @ u[i]
        s[np.asarray(docs, object) == docs[i]] = -2
        out[ids[i]] = {ids[j] for j in np.lexsort((ids, -np.round(s, 12)))[:k] if s[j] > -2}
    return out


@pytest.mark.parametrize("shape", ["far", "dense"])
def test_nearest_vectors_at_any_distance(spark, shape):
    """Vectors in all directions, and a third of them close together; every 20th row asks."""
    rng = np.random.default_rng(8)
    n, dim = 4000, 24
    v = rng.standard_normal((n, dim))
    if shape == "dense":
        v[::3] = 5 * rng.standard_normal(dim) + rng.standard_normal((len(v[::3]), dim))
    docs = [f"d{i // 3}" for i in range(n)]
    df = spark.createDataFrame([(i, d, [float(x) for x in e]) for i, (d, e) in enumerate(zip(docs, v))], "id long, doc_id string, embedding array<float>")
    got = nearest_vectors(df.repartition(3), F.col("id") % 20 == 0, dim=dim, sample=500, shard_rows=1000, block=90).collect()
    want = nearest_by_brute_force(list(range(n)), docs, v, range(0, n, 20), 10)
    found = {(r.id, r.neighbour) for r in got}
    assert {r.id for r in got} == set(want) and all(1 <= r.nth <= 10 for r in got)
    assert sum((i, j) in found for i, js in want.items() for j in js) / (10 * len(want)) > 0.93


def test_nearest_vectors_of_dirty_rows(spark):
    """Copies of one vector hold a third of the rows; ties, repeated rows, unusable vectors, clashing names."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.standard_normal((80, 8)), np.repeat(rng.standard_normal((1, 8)), 60, axis=0)])
    docs = [f"d{i % 7}" if i % 5 else "" for i in range(len(v))]
    rows = [(i, f" {d.upper()} " if i % 2 else d or None, [float(x) for x in e], "x") for i, (d, e) in enumerate(zip(docs, v))]
    bad = [(900, "q", None, "x"), (901, "q", [], "x"), (902, "q", [1.0] * 7, "x"), (903, "q", [0.0] * 8, "x"), (904, "q", [float("nan")] * 8, "x"), (None, "q", [1.0] * 8, "x"), *rows[:9]]
    df = spark.createDataFrame(rows + bad, "id long, doc_id string, embedding array<float>, cosine string")
    got = nearest_vectors(df, dim=8, k=4, sample=40, shard_rows=50)
    assert {(r.id, r.neighbour) for r in got.collect()} == {(i, j) for i, js in nearest_by_brute_force(list(range(len(v))), docs, v, range(len(v)), 4).items() for j in js}
    assert nearest_vectors(df.where("false"), dim=8).count() == 0 and nearest_vectors(df, F.lit(False), dim=8).count() == 0
    alone = nearest_vectors(df.where("id = 1"), dim=8)
    assert alone.count() == 0
    assert similar_vectors(df, dim=8, k=4).count() > 0.97 * got.count()  # without a threshold: the same search, of every row


def test_filter_holds_every_key(spark):
    from ledgerloom.llm import filters

    keys = spark.range(300_000).select(F.xxhash64("id").alias("key"))
    for df in (keys, keys.where("false"), keys.limit(1)):
        bits, packed = filters.build(df, F.col("key"))
        got = np.array([r.key for r in df.collect()], np.int64)
        assert len(packed) * 8 == 1 << bits and filters.held(packed, got % (1 << bits)).all()
        others = np.array([r.key for r in spark.range(1 << 40, (1 << 40) + 5000).select(F.xxhash64("id").alias("key")).collect()])
        assert filters.held(packed, others % (1 << bits)).mean() < 0.16
