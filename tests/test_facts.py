import pytest

from ledgerloom.operators.aggregate import FactStore, FrameStore
from ledgerloom.operators.extract import extract, facts_of_frame
from ledgerloom.plans.render import render
from ledgerloom.session import cut
from ledgerloom.sources.files import describe, elements_of, payloads_of

INVOICES = """Rechnungsnummer;Kunde;Datum;Nettobetrag (EUR);Status
2025-1042;Alster;2025-07-03;1.000,50;bezahlt
2025-1043;Elbe;2025-08-04;2.000,00;offen
2025-1044;Alster;2025-09-05;3.500,00;bezahlt
2025-1045;Weser;2025-09-30;5.000,00;bezahlt
2025-1046;Elbe;2025-10-01;4.000,00;bezahlt
2025-1047;Elbe;2025-11-01;6.000,00;offen
"""
ACCOUNT = """Datum;Verwendungszweck;Betrag (EUR);Saldo (EUR)
2025-07-01;Start;100,00;1.100,00
2025-07-04;Miete;-200,00;900,00
2025-07-02;Gehalt;-50,00;1.050,00
2025-07-03;Ausgleich;50,00;1.100,00
"""
BALANCE = """Position;2024 (EUR)
Kasse;1.000
Forderungen;2.000
Summe Aktiva;3.000
"""
SHEET = """Feld;Wert
Dokumenttyp;Rechnung
Kunde;Alster GmbH
Nettobetrag (EUR);100.000,00

Position;Beschreibung;Betrag (EUR)
1;Fracht;100,00
2;Zoll;200,00
"""
UNHINTED = """Nr;Betrag;Stand
1;100;1100
2;-400;700
3;250;950
4;-50;900
"""
FILES = {"Rechnungsausgang_Q3_2025.csv": INVOICES, "Kontoauszug_2025.csv": ACCOUNT, "Bilanz_2024.csv": BALANCE, "Beleg_1.csv": SHEET, "Stand.csv": UNHINTED}


def store_of(spark, files):
    df = spark.createDataFrame([(f"/x/{n}", bytearray(t.encode())) for n, t in files.items()], "path string, content binary")
    parsed = elements_of(df)
    about = describe(parsed)
    parsed, about = cut(parsed, "parsed"), cut(about, "about")
    made = [cut(t, "made") for t in extract(payloads_of(parsed, about))]
    return FactStore(*made, documents=cut(parsed.select("doc_id", "source").distinct().join(about, "doc_id"), "documents"))


@pytest.fixture(scope="module")
def store(spark):
    return store_of(spark, FILES)


def test_roles(store):
    roles = {(r.source, r.column): r.role for r in store.available_columns().collect()}
    assert roles["Rechnungsausgang_Q3_2025.csv", "Rechnungsnummer"] == "identifier"
    assert roles["Rechnungsausgang_Q3_2025.csv", "Kunde"] == "label"
    assert roles["Rechnungsausgang_Q3_2025.csv", "Datum"] == "date"
    assert roles["Rechnungsausgang_Q3_2025.csv", "Nettobetrag (EUR)"] == "amount"
    assert roles["Kontoauszug_2025.csv", "Saldo (EUR)"] == "balance"
    assert roles["Stand.csv", "Stand"] == "balance"
    assert roles["Stand.csv", "Betrag"] == "amount"


def test_count_sum_filters(store):
    inv = {"source": "rechnungsausgang"}
    assert store.aggregate("count", **inv).value == 6
    assert store.aggregate("sum", column="Nettobetrag", **inv).value == 21500.5
    assert store.aggregate("average", column="Nettobetrag", **inv).value == 3583.42
    assert store.aggregate("max", column="Nettobetrag", **inv).value == 6000.0
    assert store.aggregate("count", period="Q3 2025", **inv).value == 4
    assert store.aggregate("count", period="Q3 2025", where_column="Status", where_value="bezahlt", **inv).value == 3
    assert store.aggregate("distinct", column="Kunde", **inv).value == 3
    b = store.aggregate("breakdown", column="Status", **inv)
    assert [(g["key"], g["n_rows"], g["total"]) for g in b.groups] == [("bezahlt", 4, 13500.5), ("offen", 2, 8000.0)]
    assert "bezahlt" in render(b)


def test_refusal_and_closing(store):
    acc = {"source": "Kontoauszug"}
    assert store.aggregate("sum", column="Betrag", **acc).value == -100.0
    r = store.aggregate("sum", column="Saldo", **acc)
    assert r.refused and r.role == "balance" and r.alternatives == ["Betrag (EUR)"]
    assert r.closing.first().value == 900.0
    c = store.aggregate("closing", column="Saldo", **acc)
    assert (c.value, c.closing.first().day) == (900.0, "2025-07-04")
    assert store.aggregate("max", column="Saldo", **acc).value == 1100.0
    assert "REFUSED" in render(r)


def test_totals_and_filters_that_do_not_apply(store):
    r = store.aggregate("sum", column="2024", source="Bilanz")
    assert (r.value, r.totals_excluded) == (3000.0, 1)
    r = store.aggregate("count", source="Bilanz", period="Q3 2024")
    assert not r.ok and "NOT a count of zero" in r.error


def test_property_sheet_and_stacked_blocks(store):
    layouts = {(t.source, t.layout): t.n_rows for t in store.tables.collect()}
    assert layouts["Beleg_1.csv", "keyvalue_record"] == 1 and layouts["Beleg_1.csv", "records"] == 2
    assert store.aggregate("sum", column="Betrag (EUR)", source="Beleg_1").value == 300.0
    assert store.aggregate("sum", column="Nettobetrag (EUR)", source="Beleg_1").value == 100000.0
    assert "Zeile 8" in {f.locator for f in store.facts.collect()}


def test_errors(store):
    assert not store.aggregate("median").ok
    assert not store.aggregate("sum").ok
    assert not store.aggregate("count", source="nowhere").ok
    r = store.aggregate("sum", column="xyz")
    assert not r.ok and "xyz" in r.error and render(r).startswith("ERROR")


def test_combined_and_loose_matches(store):
    r = store.aggregate("sum", column="Betrag")
    assert r.value == -100.0  # only the closest match takes part: the exact 'Betrag'
    assert any("loosely" in w for w in r.warnings)
    r = store.aggregate("sum", column="Betrag (EUR)")
    assert r.value == 200.0 and any("COMBINES" in w for w in r.warnings) and any("DIFFERENT" in w for w in r.warnings)
    per = {(t.source, t.value) for t in r.per_table.collect()}
    assert per == {("Kontoauszug_2025.csv", -100.0), ("Beleg_1.csv", 300.0)}


def test_colliding_headers(spark):
    s = store_of(spark, {"a.csv": "Betrag;Betrag ;x\n1;10;a\n2;20;b\n"})
    assert sorted(c.name for c in s.tables.first().columns) == ["betrag", "betrag2", "x"]


def test_empty(spark):
    s = store_of(spark, {"a.md": "# nothing\n"})
    assert not s.aggregate("count").ok


def test_typed_tables_give_what_their_cells_give(spark):
    """A FrameStore against a FactStore over the same table as attribute-value rows, for every operation and filter."""
    import datetime as dt
    import random

    r = random.Random(1)
    rows = [(i, r.choice("ABC"), r.choice([None, round(r.uniform(-50, 50), 2)]), r.choice([None, "offen", "bezahlt", ""]), r.choice([None, dt.date(2025, r.randint(1, 12), 3)]), r.choice([None, 7, 8])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, kind string, betrag double, status string, datum date, kunde_nr int")
    roles = {"betrag": "amount", "status": "label", "datum": "date", "kunde_nr": "identifier"}
    more = {"label": "status", "uid_col": "kind"}
    wide, tall = FrameStore(df, "t", "id", roles, **more), FactStore(*(cut(x, "tall") for x in facts_of_frame(df, "t", "id", roles, **more)))
    cases = [("average", "Betrag", {"period": "Q2 2025"}), ("distinct", "status", {}), ("breakdown", "status", {"where_column": "kunde_nr", "where_value": "7"}), ("sum", "kundenr", {}), ("min", "betrag", {"where_column": "status", "where_value": "OFF"}), ("count", "", {"period": "nie"})]
    for op, column, scope in cases:
        a, b = wide.aggregate(op, column=column, **scope), tall.aggregate(op, column=column, **scope)
        assert (a.ok, a.value, a.matched_rows, a.scanned_rows, a.n_tables, a.error, a.refused, a.warnings, a.groups) == (b.ok, b.value, b.matched_rows, b.scanned_rows, b.n_tables, b.error, b.refused, b.warnings, b.groups), (op, column, scope)
