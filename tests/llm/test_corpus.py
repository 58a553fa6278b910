import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.leakage import FMIndex, find_leaks, suffix_array
from ledgerloom.llm.mixing import mix_sources, plan_repeats
from ledgerloom.llm.reading import calibrate, complexity_bounds, measure, measured, reading_profile, sentence_features, vocabulary
from ledgerloom.llm.words import folded_words, words


def test_suffix_array_and_search():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 400):
        seq = np.append(r.integers(1, 4, n), 0).astype(np.int16)
        assert list(suffix_array(seq)) == sorted(range(len(seq)), key=lambda i: list(seq[i:]))
    for copies in (1, 3):
        seq = np.concatenate([np.append(r.integers(1, 6, 50), 0)] * copies + [np.append(r.integers(1, 6, 90), 0)]).astype(np.int16)
        index = FMIndex(seq, 6)
        for k in (1, 2, 4):
            for _ in range(20):
                p = r.integers(1, 6, k)
                lo, hi = index.search(p[None].astype(np.int64))
                want = [i for i in range(len(seq) - k + 1) if (seq[i : i + k] == p).all()]
                assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_leaks(spark):
    r = random.Random(2)
    vocab = [f"wört{i}" for i in range(60)]
    passages = [" ".join(r.choice(vocab) for _ in range(25)) for _ in range(4)] + ["zu kurz"]
    passages.append(passages[0])
    docs = []
    for i in range(60):
        t = [r.choice(vocab) for _ in range(30)]
        if i % 3 == 0:
            w = passages[i % 4].split()
            a, n = r.randrange(10), r.randint(10, 15)
            t[5:5] = [x.upper().replace("Ö", "O") + "," for x in w[a : a + n]]
        docs.append("  ".join(t))
    docs += ["", None, passages[1], docs[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)] + [(0, docs[0], "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(i, p) for i, p in enumerate(passages)] + [(99, None)], "item_id long, passage string")
    got = {(x.doc_id, x.item_id) for x in find_leaks(df, items, shard_words=500).collect()}
    runs = {}
    for i, p in enumerate(passages):
        w = folded_words(p)
        for k in range(len(w) - 11):
            runs.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(i, item) for i, t in enumerate(docs) if t for k in range(len(folded_words(t)) - 11) for item in runs.get(tuple(folded_words(t)[k : k + 12]), ())}
    assert got == want and want
    assert find_leaks(df.where("false"), items).count() == 0
    assert find_leaks(df, items.where("false")).count() == 0


def test_leaks_of_more_words_than_two_bytes_name_and_in_blocks(spark):
    passages = [" ".join(f"w{i}x{j}" for j in range(1700)) for i in range(24)]
    texts = [" ".join(p.split()[100 * i : 100 * i + 11 + i % 2]) for i, p in enumerate(passages[:16])] + [passages[23]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    want = {(i, i, 0, 12, texts[i]) for i in range(1, 16, 2)} | {(16, 23, 0, 1700, texts[16])}
    for block_mb in (16, 0.1):
        assert {tuple(r) for r in find_leaks(df, items, block_mb=block_mb).collect()} == want


def test_plan():
    assert plan_repeats({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 4), ("c", 0.3, 1)]) == {"a": 0.4, "b": 4.0}
    got = plan_repeats({"a": 100, "b": 10}, [("a", 0.5, None), ("b", 0.5, 2)], 100)
    assert got == {"a": 0.8, "b": 2.0}
    assert plan_repeats({}, [("a", 1.0, 1)]) == {}


def test_mixture(spark):
    r = random.Random(5)
    rows = [(i, "A-b " if i % 2 else "a_B", "wort " * r.randint(1, 60)) for i in range(300)] + [(1000 + i, "small", "text " * 20) for i in range(10)] + [(2000, None, "x"), (2001, "other", "x"), (2002, "small", ""), (2003, "small", None), (0, "a_B", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a_b", 0.5, 1), ("SMALL", 0.5, 4), ("none", 0.2, None), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    copies, shares = mix_sources(docs, targets)
    s = {x.source: x for x in shares.collect()}
    assert abs(s["a_b"].actual_share - 0.5) < 0.05 and abs(s["small"].actual_share - 0.5) < 0.05 and s["none"].tokens == 0
    per = {x.doc_id: x.n for x in copies.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert max(n for d, n in per.items() if d < 1000) == 1 and all(per[1000 + i] == 4 for i in range(10))
    empty = mix_sources(docs.where("false"), targets)
    assert empty[0].count() == 0 and empty[1].count() == 3
    assert mix_sources(docs, targets.where("false"))[0].count() == 0


def test_registered_mixture_is_not_shrunk_to_its_smallest_source(spark, tmp_path):
    from ledgerloom.llm.queries import p8_mixture, p8_shares

    rows = [(i, "big", "wort " * 40) for i in range(200)] + [(1000 + i, "mid", "text " * 40) for i in range(100)] + [(2000, "tiny", "kurz")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.1, 4)], "source string, weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    s = {x.source: x for x in p8_shares(spark, str(tmp_path)).collect()}
    assert sum(x.tokens for x in s.values()) > 0.95 * sum(x.available_tokens for x in s.values())
    assert s["tiny"].repeats == 4 and s["tiny"].actual_share < s["tiny"].target_share and all(x.repeats <= x.max_repeats for x in s.values())
    n = p8_mixture(spark, str(tmp_path)).where("source = 'big'").select("doc_id").distinct().count()
    assert abs(n - 200 * s["big"].repeats) <= 1 and s["big"].repeats > 0.6


def test_coverage_against_brute_force(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{int(r.paretovariate(0.7)) % 300}" for _ in range(r.randint(0, 80))) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {}
    for t in texts:
        for w in words(t or ""):
            counts[w] = counts.get(w, 0) + 1
    rank = {w: sum(m >= n for m in counts.values()) for w, n in counts.items()}
    vocab = vocabulary(df)
    assert {(x.word, x.n, x["rank"]) for x in vocab.collect()} == {(w, n, rank[w]) for w, n in counts.items()}
    for head in (5, 1 << 16):  # nearly all through the join, and none
        got = {x.id: x.coverage_rank for x in measure(df, vocab, "doc_id", "text", 0.8, head).collect()}
        for i, t in enumerate(texts):
            ranks = sorted(rank[w] for w in words(t or ""))
            assert got.get(i) == (ranks[-(-len(ranks) * 4 // 5) - 1] if ranks else None)


def test_levels(spark):
    easy = "Der Hund ist da. Er isst gern. Wir sind im Haus.\n\nDas ist gut und schön so. Er geht nun weg. Ja."
    hard = ("Rückstellungsberechnung " + "außerordentliche Gesellschafterversammlung der " * 11 + "AG. ") * 2
    rows = [(1, easy), (2, hard), (3, "zu kurz."), (4, ""), (5, None), (1, easy), (None, easy), (6, easy.replace(".", ","))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("level", F.lit("clash"))
    labels = spark.createDataFrame([(1, "a", 1), (1, "b", None), (2, "a", 5), (9, "a", 3)], "doc_id long, rater string, grade int")
    got = {r.doc_id: r for r in reading_profile(df, labels).collect()}
    assert {k: r.level for k, r in got.items()} == {1: "easy", 2: "hard", 3: None, 4: None, 5: None, 6: "medium"}
    assert (got[1].n_sentences, got[4].n_sentences, got[1].grade) == (6, 0, None)
    assert reading_profile(df.where("false"), labels).count() == 0


def test_sentence_features_against_plain_rules():
    import re

    import pyarrow as pa

    r = random.Random(4)
    texts = ["".join(r.choice(["wort ", "Lieferung", "ende. ", "ja!\n", "a\n \n", "\n\n", ".  ", "Übergabestellen7 ", "3.5 ", "?", "\x01", "\f", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(200)] + ["", None, ".", " . . ", "Satz", "\n\n\n"]
    got = sentence_features(pa.array(texts, pa.string()))
    blank = "\t\n\x0b\f\r "
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(f"[^{blank}]+", t)
        parts = [x for x in re.split(f"(?<=[.!?])[{blank}]+|\n[ \t\r]*\n", t) if x.strip(blank)]
        long = [w for w in words if re.search(r"[^\W\d_]{7}", w)]
        assert (got["n_words"][i].as_py(), got["n_sentences"][i].as_py(), got["n_long"][i].as_py()) == (len(words), len(parts), len(long))


def test_calibration_learns_and_bounds_lose_nothing(spark):
    """Grades made of sentence length and rare words: the error on documents held out is far below that of the mean."""
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows, grades = [], []
    for i in range(400):
        per, rare = r.randint(4, 45), r.random()
        words = [(vocab[int(r.random() ** 2 * 40)] if r.random() > rare else r.choice(vocab)) + ("Verwaltung" if r.random() < i % 5 / 8 else "") for _ in range(120)]
        t = "".join(w + (". " if k % per == per - 1 else " ") for k, w in enumerate(words))
        rows.append((i, t))
        if i % 2:
            grades.append((i, "a", max(1, min(5, round(1 + per / 15 + 2 * rare)))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(grades, "doc_id long, rater string, grade int")
    fit = calibrate(measured(df), labels)
    assert fit.n == 200 and 20 <= fit.n_held_out <= 60 and fit.rmse < 0.6 * fit.rmse_of_mean
    easy, hard = complexity_bounds(fit)
    got = reading_profile(df, labels).collect()
    assert {x.level for x in got} == {"easy", "medium", "hard"} and {x.band for x in got} <= {1, 2, 3, 4, 5}
    want = {x.doc_id: "easy" if x.words_per_sentence <= 9 and x.n_long * 4 <= x.n_words else "hard" if x.words_per_sentence >= 30 and x.n_long * 10 >= x.n_words * 3 else "medium" for x in got}
    assert {x.doc_id: x.level for x in got} == want
