import datetime as dt
import json

import pytest

from ledgerloom.operators.orphans import Reference, orphan_references
from ledgerloom.operators.skew import hot_keys, salted_join
from ledgerloom.operators.wide import attributes, catalogue, cell_issues, wide_table, wide_tables


def day(d, m=1):
    return dt.datetime(2024, m, d)


def refs(spark, child, parent):
    c = spark.createDataFrame(child, "ref string, at timestamp_ntz, since string")
    p = spark.createDataFrame(parent, "key string, since timestamp_ntz, deleted_at timestamp_ntz")
    return [Reference("c", c, "ref", "at", p, "key", "since", "deleted_at")]


def test_orphans(spark):
    child = [("a", day(5), None), (" A ", day(6), None), ("gone", day(5), None), ("late", day(5), None), ("late", day(20), None), ("late", day(1, 3), None), ("none", day(5), None), ("none", day(5), None), ("", day(5), None), ("  ", day(5), None), (None, day(5), None), ("notime", None, None)]
    parent = [("A", day(1), None), ("a", day(9), day(10)), ("gone", day(1), day(2)), ("gone", day(3), day(4)), ("late", day(10), None), ("late", day(12), day(13)), (None, day(1), None), ("notime", None, None)]
    got = {(r.ref_key, r.period, r.state, r.n_refs) for r in orphan_references(refs(spark, child, parent)).collect()}
    assert got == {("gone", "2024-01", "deleted", 1), ("late", "2024-01", "late", 2), ("none", "2024-01", "missing", 2)}


def test_orphans_of_empty_tables(spark):
    assert orphan_references(refs(spark, [], [])).count() == 0
    assert [r.state for r in orphan_references(refs(spark, [("x", None, None)], [])).collect()] == ["missing"]


CATALOGUE = '[{"name":"betrag","raw":"Betrag","role":"amount","kind":"number"},{"name":"datum","raw":"Datum","role":"date","kind":"date"},{"name":"strasse","raw":"Straße","role":"label","kind":"text"}]'
VALUES = "fact_id long, table_uid string, col string, text string, num double, date string, loaded_at timestamp_ntz, extra string"


def frames(spark, values):
    tables = spark.createDataFrame([("t1", CATALOGUE, day(1)), ("t1", CATALOGUE, day(1)), ("t2", None, day(1)), (None, CATALOGUE, day(1))], "table_uid string, column_json string, loaded_at timestamp_ntz")
    return spark.createDataFrame([(*v, "x") for v in values], VALUES), tables


def test_issues(spark):
    values, tables = frames(
        spark,
        [
            (1, "t1", "Betrag", "1.234,50", None, None, day(1)), (1, "t1", "BETRAG", None, 1234.5, None, day(2)),
            (2, "t1", "betrag", "zwölf", None, None, day(1)), (3, "t1", "betrag", "5", None, None, day(1)), (3, " T1 ", "betrag", "6", None, None, day(1)),
            (4, "t1", "datum", "31.02.2025", None, None, day(1)), (5, "t1", "datum", "1.2.2025", None, "2025-02-01", day(1)), (6, "t1", "STRASSE", " a", None, None, day(1)), (6, "t1", "straße", "b ", None, None, day(1)),
            (7, "t1", "betrag", "  ", None, None, day(1)), (8, "tX", "betrag", "??", None, None, day(1)), (None, "t1", "betrag", "??", None, None, day(1)), (9, "t1", "strasse", "q", None, None, day(1)), (9, "t1", "strasse", " q", None, None, day(1)),
            (10, "t1", "datum", "tbd", None, None, day(1)), (10, "t1", "datum", "2025-01-01", None, None, day(1)), (10, "t1", "datum", "2025-01-02", None, None, day(1)),
        ],
    )
    got = {tuple(r) for r in cell_issues(values, tables).collect()}
    assert got == {(2, "betrag", "mistyped"), (3, "betrag", "conflict"), (4, "datum", "mistyped"), (6, "strasse", "conflict"), (10, "datum", "mistyped"), (10, "datum", "conflict")}


def test_wide(spark):
    values, tables = frames(
        spark,
        [
            (1, "t1", "Betrag", "1,5", None, None, day(1)), (1, "t1", "betrag", None, 7.0, None, day(3)), (1, "t1", "betrag", "x", None, None, day(4)), (1, "t1", "datum", "2.1.2025", None, None, day(1)), (1, "t1", "strasse", " Weg ", None, None, day(1)),
            (2, "t1", "strasse", "a", None, None, day(1)), (2, "t1", "strasse", "b", None, None, day(1)),
        ],
    )
    got = {r.fact_id: r for r in wide_table(values, tables).collect()}
    assert (got[1].betrag, got[1].datum, got[1].strasse) == (7.0, dt.date(2025, 1, 2), "Weg")
    assert (got[2].betrag, got[2].strasse) == (None, "b")
    assert attributes(catalogue(tables)) == [("betrag", "number"), ("datum", "date"), ("strasse", "text")]
    with pytest.raises(ValueError):
        attributes(catalogue(tables), 2)
    assert wide_table(values.where("false"), tables).count() == 0
    by_block = {tuple(r) for r in wide_table(values, tables, block=1).collect()}
    assert by_block == {tuple(r) for r in got.values()}
    ties, _ = frames(spark, [(5, "t1", "betrag", None, 9.0, None, day(1)), (5, "t1", "betrag", "10", None, None, day(1)), (5, "t1", "datum", "9.1.2025", None, None, day(1)), (5, "t1", "datum", "10.1.2025", None, None, day(1))])
    assert [(r.betrag, r.datum) for r in wide_table(ties, tables).collect()] == [(10.0, dt.date(2025, 1, 10))]


def test_salted_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k5", 2), ("zz", 3), (None, 4)], "k string, v int")
    assert [k for k, _ in hot_keys(left, ["k"], 4)] == [("hot",)]
    assert salted_join(left, right, "k", "i", max_hot=4).count() == 901
    assert salted_join(left.where("false"), right, "k", "i").count() == 0


def test_wide_tables_by_kind(spark):
    names = lambda *c: json.dumps([{"name": n, "raw": n, "role": "x", "kind": k} for n, k in c])
    at = dt.datetime(2025, 1, 1)
    tables = spark.createDataFrame([("a", names(("x", "number"), ("y", "text")), at), ("b", names(("y", "text"), ("x", "number")), at), ("c", names(("x", "text"), ("zahl", "number")), at), ("d", None, at), (None, names(("x", "number")), at)], "table_uid string, column_json string, loaded_at timestamp_ntz")
    cells = [(1, "a", "x", "1", None, None, at), (1, "a", "y", "u", None, None, at), (2, "B ", "X", "2", None, None, at), (3, "c", "x", "3", None, None, at), (3, "c", "Zahl", "7", None, None, at), (4, "zz", "x", "3", None, None, at), (None, "a", "x", "1", None, None, at)]
    values = spark.createDataFrame(cells, "fact_id long, table_uid string, col string, text string, num double, date string, loaded_at timestamp_ntz")
    got = sorted(([sorted(w.columns), sorted(tuple(r[c] for c in sorted(w.columns)) for r in w.collect())] for w in wide_tables(values, tables).values()), key=str)
    assert got == [[["fact_id", "n_cells", "table_uid", "x", "y"], [(1, 2, "a", 1.0, "u"), (2, 1, "b", 2.0, None)]], [["fact_id", "n_cells", "table_uid", "x", "zahl"], [(3, 2, "c", "3", 7.0)]]]
    assert wide_tables(values, tables.where("false")) == {} and all(w.count() == 0 for w in wide_tables(values.where("false"), tables).values())
