import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import archive as A
from ledgerloom.functions import grounding as G
from ledgerloom.functions.text import key, norm_col, tokens
from ledgerloom.functions.values import read_amount, read_date


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_parse_number(spark):
    grid = {
        "1.245.300,50": 1245300.5, "1,245,300.50": 1245300.5, "-55022,59": -55022.59, "(1.234)": -1234.0, "128.400,00 EUR": 128400.0, "4400": 4400.0, "12,5 %": 12.5,
        "5 Mio EUR": 5.0, "0.5": 0.5, "1.2.3": None, "2025-1042": None, "2024-11-19": None, "": None, "Elbe Spedition GmbH": None, None: None, "€ 1.000": 1000.0, "1,2,3": None, "-": None,
    }
    assert column(spark, list(grid), A.parse_number) == list(grid.values())


def test_parse_date(spark):
    grid = {"2025-07-26": "2025-07-26", "26.07.2025": "2025-07-26", "2025-07-26 00:00:00": "2025-07-26", "2025/7/6": "2025-07-06", "2/3/2025": "2025-03-02", "31.02.2025": "2025-02-31", "1.1.25": None, "not a date": None, "2025-13-01": None, "": None, None: None}
    assert column(spark, list(grid), A.parse_date) == list(grid.values())


def test_read_amount_and_date(spark):
    grid = {"216 033,40": 216033.4, "(4682,50) €": -4682.5, "-€ 5,10": -5.1, "5-": -5.0, "0.125": 0.125, "1.234": 1234.0, "1.2.3.4": None, "1O4,50 EUR": None, "12:30": None, "—": None, "  ": None, None: None}
    assert column(spark, list(grid), read_amount) == list(grid.values())
    days = {"31.02.2025": None, "2025-07-26T10:11:12Z": datetime.date(2025, 7, 26), " 09.08.2024 ": datetime.date(2024, 8, 9), "12.2025": None, None: None, "2025-07.01": None}
    assert column(spark, list(days), read_date) == list(days.values())


@pytest.mark.parametrize(
    "period, span",
    [("Q3 2025", ("2025-07-01", "2025-09-30")), ("2025-Q1", ("2025-01-01", "2025-03-31")), ("2024", ("2024-01-01", "2024-12-31")), ("2025-07", ("2025-07-01", "2025-07-31")), ("2024-02", ("2024-02-01", "2024-02-29")), ("nonsense", None), ("2025-13", None), ("", None), (None, None)],
)
def test_period(period, span):
    assert A.period_range(period) == span


def test_names_and_keys(spark):
    assert column(spark, ["Größe (€)", "Échéance", "Straße", "fällig_am", "", None], norm_col) == ["groe".replace("oe", "osse"), "echeance", "strasse", "falligam", "", None]
    assert column(spark, [" A-1 ", "", "  ", None], key) == ["a-1", None, None, None]
    assert column(spark, ["Ein Test_1!"], tokens) == [["ein", "test", "1"]]


def test_language_type_year(spark):
    assert column(spark, ["der Saldo und die Bank für", "the bank and the fee of it", "", None], A.guess_lang) == ["de", "en", "", ""]
    names = ["Rechnung_1.csv", "README_x.md", "Kontoauszug.csv", "Hauptbuch_Konzern.csv", "x.csv"]
    assert column(spark, names, lambda c: A.infer_doc_type(c, F.lit("Steuer"))) == ["invoice", "other", "statement", "ledger", "tax"]
    assert column(spark, ["Bilanz 2024.csv", "X_2025.csv"], lambda c: A.infer_year(c, F.lit("im Jahr 2023"))) == ["2024", "2023"]


def test_anchor_and_terms(spark):
    yes = ["BEL-2024-3015", "128.400 EUR", "DE44", "2025-Q3-00123", "Konto 4821000"]
    no = ["Wie hoch war der Umsatz in 2025?", "", None]
    assert column(spark, yes + no, A.has_literal_anchor) == [True] * 5 + [False] * 3
    assert column(spark, ["Wie hoch? a Umsatz-Umsatz"], A.query_terms) == [["wie", "hoch", "umsatz", "umsatz"]]


def test_formats(spark):
    assert column(spark, [1234567.0, 4581668.99, None], A.format_amount, "double") == ["1.234.567", "4.581.668,99", "—"]
    assert column(spark, ["<p>a  <b>b</b></p>", None], A.html_text) == ["a b", None]
    assert column(spark, ["abcdefgh", "abc"], lambda c: A.clip(c, 6)) == ["abc...", "abc"]
    got = spark.range(1).select(A.row_text(F.array(F.lit("H"), F.lit("")), F.array(F.lit("1"), F.lit("2"), F.lit(""), F.lit("3"))).alias("x")).first().x
    assert got == "H: 1 | Spalte 2: 2 | Spalte 4: 3"


def test_decimals(spark):
    same = column(spark, ["18.452.000,00", "18,452,000.00", "18452000"], G.to_decimal)
    assert len(set(same)) == 1
    assert [float(x) for x in column(spark, ["16.180.000.00", "1.234", "1234.56", "0.5"], G.to_decimal)] == [16180000.0, 1234.0, 1234.56, 0.5]
    got = column(spark, ["am 31.12.2024 waren es 4.821.000 EUR, 2024 und 12 Stück", None], G.numbers_in)
    assert [[float(x) for x in g] for g in got] == [[2024.0, 4821000.0], []]


def test_answers(spark):
    assert column(spark, ["Das ist nicht enthalten.", "Der Umsatz ist 5.", None], G.looks_like_refusal) == [True, False, False]
    assert column(spark, ["Es sind 4.821.000,00 EUR.", "Es sind 5.", ""], lambda c: G.contains_value(c, F.array(F.lit("4821000")))) == [True, False, False]
    dec = lambda *v: F.array(*[F.lit(x).cast(G.AMOUNT) for x in v])
    assert column(spark, [352000.0, 350000.0, 77.0], lambda c: G.derivable(c.cast(G.AMOUNT), dec(2522000, 2170000)), "double") == [True, True, False]
    wrong = lambda c: G.misattributed(c, F.array(F.lit("Q3")), F.array(F.lit("900000")), F.array(F.lit("800000")))
    assert column(spark, ["In Q3 waren es 900.000 EUR.", "In Q3 waren es 800.000 EUR.", "In Q3, im Vergleich 900.000 EUR."], wrong) == [True, False, False]


def test_text_blocks(spark):
    from ledgerloom.sources.files import paragraphs

    texts = ["a\n\nb\n\n# c\n\nd", "x" * 1300 + "\n\ny", "", "  \n\n ", "\n\n".join("w" * 500 for _ in range(7)), "# a\n\n# b"]
    assert column(spark, texts, A.text_blocks) == [paragraphs(t) for t in texts]
    assert column(spark, [None], A.text_blocks) == [[]]
