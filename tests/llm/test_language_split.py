import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.language import LANGS, cost, languages, named_language, train
from ledgerloom.llm.splitting import EDGE, atoms, merge, split_items, split_text

WORDS = {
    "de": "der die das und nicht mit rechnung wurde bezahlt lager buchung saldo gegen ohne prüfung",
    "en": "the and with was paid invoice warehouse without inspection against balance booked of by",
    "fr": "le la les et avec facture payée sans contrôle dépôt solde contre été par des",
    "es": "el la los y con factura pagada sin revisión almacén saldo contra fue por las",
}


def text(lang, n, seed=0):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n)) + "."


def test_code_lengths_sum_to_one():
    tree = train({"de": [text("de", 200)], "en": [text("en", 200)], "fr": [], "es": []}, order=2)
    import numpy as np

    known = (cost(tree, np.array([(100 << 16) | (101 << 8) | b for b in range(256)]), 2)[:, :2]).astype(float)
    assert (np.exp2(-known).sum(0) <= 1.0001).all()


def test_languages(spark):
    rows = [(i, text(lang, 40, i), lang, "x") for i, lang in enumerate(LANGS * 15)]
    rows += [(100, text("de", 30, 1) + "\n" + text("fr", 30, 2), "de", "x"), (101, text("es", 40, 3), "en_US", "x"), (102, "", "de", "x"), (103, None, "de", "x"), (104, "12 34 a1b2", "?", "x"), (101, text("es", 40, 3), "en_US", "x")]
    df = spark.createDataFrame(rows, "id long, text string, hint string, n_langs string")
    got = languages(df, "id", "text", "hint").distinct().collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.lang)
    assert all(by[i] == {lang} for i, lang in enumerate(LANGS * 15))
    assert by[100] == {"de", "fr"} and by[101] == {"es"} and not {102, 103, 104} & set(by)
    assert all(0.8 <= r.confidence <= 1 for r in got)
    assert languages(df.where("false"), "id", "text", "hint").count() == 0


def test_hints(spark):
    names = ["de_AT", "Deutsch", "EN", "français", "spa", "?", "", None, "und", "en-GB"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, h string")
    assert [r.x for r in df.select("i", named_language(df.h).alias("x")).orderBy("i").collect()] == ["de", "de", "en", "fr", "es", None, None, None, None, "en"]


@pytest.mark.parametrize("seed", range(30))
def test_round_trip(seed):
    r = random.Random(seed)
    t = "".join(r.choice(["wort ", "ende. ", "frage? ", "\n", "\n\n", "\f", " | ", "x" * r.randint(1, 90), " "]) for _ in range(r.randint(1, 300)))
    limit, overlap = r.choice([(60, 10), (120, 30), (1200, 150)])
    pieces = split_text(t, limit, overlap)
    assert "".join(t[own:b] for _, own, b, _ in pieces) == t.strip(EDGE)
    assert all(b - a <= limit and 0 <= own - a <= overlap for a, own, b, _ in pieces)


def test_merging_weakest_first():
    ends, strengths, kind = atoms("aa. bb.\ncc", 100)
    assert (ends, strengths[:2], kind) == ([4, 8, 10], [2, 3], "clean")
    assert merge([4, 8, 10], [2, 3, 6], 8) == [8, 10]
    assert merge([4, 8, 10], [3, 2, 6], 8) == [4, 10]


def test_split_items(spark):
    rows = [(1, "a b. " * 300, "x", 3), (1, "a b. " * 300, "x", 3), (2, "short", "x", None), (3, None, "x", 1), (4, "w " * 900, "x", None), (5, "y" * 1300, "x", 1), (6, ("z " * 300 + "\f") * 3, "x", 7)]
    df = spark.createDataFrame(rows, "id long, text string, piece string, page int")
    got = split_items(df).collect()
    assert {r.id: r.cut_class for r in got} == {1: "clean", 4: "word", 5: "hard", 6: "clean"}
    assert [r.page for r in sorted(got, key=lambda r: r.piece) if r.id == 6] == [7, 8, 9] or {r.page for r in got if r.id == 6} >= {7}
    assert all(len(r.text) <= 1200 for r in got)
    assert split_items(df.where("false")).count() == 0


def test_items_without_id_are_all_split(spark):
    texts = ["Ein Satz von hier. " * 100, "Ein anderer Satz. " * 100]
    df = spark.createDataFrame([(None, texts[0], 1), (None, texts[1], 1), (5, texts[0], 1), (5, texts[0], 1)], "id long, text string, page int")
    assert [r.id for r in split_items(df).where("piece = 0").orderBy("id").collect()] == [None, None, 5]


def test_stretches_of_low_confidence_come_out(spark):
    shared = ["alpha beta gamma delta epsilon"] * 5
    tree = train({"de": shared + ["haus und hof"], "en": shared + ["house and yard"], "fr": ["maison et cour"], "es": ["casa y patio"]})
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", None)], "id long, text string, hint string")
    got = languages(df, "id", "text", "hint", tree).collect()
    assert len(got) == 1 and got[0].confidence < 0.8 and got[0].n_langs == 0


def test_labels_of_short_texts_only_and_none(spark):
    rows = [(i, "der hund und das haus" if i % 2 else "the dog and the house", "de" if i % 2 else "en") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, hint string")
    got = {r.id: r.lang for r in languages(df, "id", "text", "hint").collect()}
    assert got == {i: h for i, _, h in rows}
    with pytest.raises(ValueError, match="nothing to learn from"):
        languages(df.withColumn("hint", F.lit("?")), "id", "text", "hint")


def test_every_text_with_a_word_comes_out(spark):
    rows = [(i, text(lang, 40, i), lang) for i, lang in enumerate(LANGS * 15)]
    rows += [(100, "questa fattura è già stata pagata dal magazzino", "it"), (101, "Total EUR", None), (102, "xqzjk wvxqp zzkqj xkcdq", None), (103, "ok", None)]
    got = languages(spark.createDataFrame(rows, "id long, text string, hint string"), "id", "text", "hint").collect()
    assert {r.id for r in got} == {r[0] for r in rows}
    assert {r.lang for r in got if r.id == 102} == {"und"} and all(r.n_langs == 0 for r in got if r.id == 102)
    assert all(0 < r.confidence <= 1 for r in got)


def test_a_rare_language_is_learnt_from_all_its_labels(spark):
    rows = [(i, text("de", 40, i), "de") for i in range(4000)] + [(5000 + i, text("es", 40, i), "es") for i in range(4)] + [(9000, text("es", 40, 77), None)]
    got = languages(spark.createDataFrame(rows, "id long, text string, hint string"), "id", "text", "hint", sample=200)
    assert {r.lang for r in got.where("id >= 5000").collect()} == {"es"}


@pytest.mark.parametrize("limit, overlap", [(1200, 150), (60, 20), (10, 4)])
def test_overlap_where_there_is_no_blank(limit, overlap):
    for t in ("a" * 3000, "b" * (limit + 1), "wort " * 5 + "c" * 5 * limit + " ende"):
        pieces = split_text(t, limit, overlap)
        assert "".join(t[own:b] for _, own, b, _ in pieces) == t
        assert all(b - a <= limit for a, _, b, _ in pieces)
        inside = [(a, own) for a, own, b, _ in pieces[1:] if b - own <= limit - overlap and " " not in t[own - min(overlap, limit - 1, own) : own]]
        assert inside and all(own - a == min(overlap, limit - 1, own) for a, own in inside)
