import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.files import blocks_of, paragraphs, parse
from ledgerloom.sources.index import backfill_facts, build_index, index_exists, read_index
from ledgerloom.streaming.ingest import ingest_stream
from ledgerloom.streaming.sessions import session_stream


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


def kinds(name, raw):
    return [e["kind"] for e in parse(name, raw)[1]]


def test_csv():
    doc, els = parse("Hauptbuch.csv", "Konto;Bezeichnung\n4400;Umsatzerlöse\n".encode("cp1252"))
    assert [e["text"] for e in els if e["kind"] == "table_row"] == ["Konto: 4400 | Bezeichnung: Umsatzerlöse"]
    els = parse("a.csv", b"Feld;Wert\nA;1\n\nX;Y\n1;2\n")[1]
    assert [e["table_id"][-4:] for e in els if e["kind"] == "table_summary"] == ["csv1", "csv2"]
    assert [e["locator"] for e in els if e["kind"] == "table_row"] == ["Zeile 2", "Zeile 5"]
    assert [len(b) for b in blocks_of([["a"], [""], ["b"], ["c"]])] == [1, 2]


def test_row_cap():
    els = parse("a.csv", ("a;b\n" + "1;2\n" * 2100).encode())[1]
    assert els[0]["reason"] == "row_cap" and sum(e["kind"] == "table_row" for e in els) == 2000
    assert els[1]["payload"]["n_rows_total"] == 2100 and len(els[1]["payload"]["rows"]) == 2100


def test_text():
    assert paragraphs("a\n\nb\n\n# c\n\nd") == ["a\n\nb", "# c\n\nd"]
    assert paragraphs("x" * 1300 + "\n\n" + "y") == ["x" * 1300, "y"]
    assert kinds("a.md", b"# A\n\ntext") == ["text"] and kinds("a.txt", b"  ") == []


def test_office():
    sheet = '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>B</t></is></c></row><row r="3"><c r="A3"><v>5</v></c><c r="C3"><f>A3*2</f></c></row></sheetData></worksheet>'
    book = zipped({
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="T" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>A</t></si></sst>", "xl/worksheets/sheet1.xml": sheet,
    })
    els = parse("a.xlsx", book)[1]
    assert [e["kind"] for e in els] == ["notice", "table_summary", "table_row"]
    assert els[2]["locator"] == "T!Z3" and els[1]["payload"]["headers"] == ["A", "", "B"]
    doc = zipped({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hallo</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>K</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>1</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert kinds("a.docx", doc) == ["text", "table_summary", "table_row"]


def test_notices():
    assert parse("a.exe", b"")[1][0]["reason"] == "unsupported_format"
    assert parse("a.xlsx", b"no zip")[1][0]["reason"] == "parse_error"
    assert parse("noname", b"")[1][0]["reason"] == "unsupported_format"


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_index(spark, tmp_path):
    folder, index = str(tmp_path / "in"), str(tmp_path / "ix")
    write(folder, "Rechnung_2024.csv", "Datum;Betrag\n2024-01-01;5,00\n2024-01-02;7,00\n")
    write(folder, "b.md", "# Notiz\n\nText über Saldo")
    write(folder, "copy.md", "# Notiz\n\nText über Saldo")
    assert build_index(spark, folder, index) == {"new": 2, "unchanged": 0, "pruned": 0}
    t = read_index(spark, index)
    assert index_exists(spark, index) and t["documents"].count() == 2
    assert t["chunks"].where("embedding is null").count() == 0 and t["facts"].count() == 2
    os.remove(os.path.join(folder, "Rechnung_2024.csv"))
    write(folder, "c.txt", "neu")
    assert build_index(spark, folder, index) == {"new": 1, "unchanged": 1, "pruned": 1}
    t = read_index(spark, index)
    assert {r.source for r in t["documents"].collect()} <= {"b.md", "copy.md", "c.txt"} and t["documents"].count() == 2
    assert "facts" not in t or t["facts"].count() == 0
    with pytest.raises(FileNotFoundError):
        build_index(spark, folder + "-missing", index)
    files = spark.read.format("binaryFile").load(folder)
    docs = t["documents"].withColumn("facts_at", F.lit(None).cast("timestamp"))
    assert backfill_facts(docs, files)[0].where("facts_at is null").count() == 0


def test_streams(spark, tmp_path):
    folder, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    write(folder, "a.txt", "eins")
    ingest_stream(spark, folder, out, ck).awaitTermination()
    write(folder, "b.txt", "eins")
    write(folder, "c.txt", "zwei")
    ingest_stream(spark, folder, out, ck).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["eins", "zwei"]
    spark.range(3).selectExpr("1 user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id * 10 as int),0) ts").write.parquet(str(tmp_path / "ev"))
    s = session_stream(spark.readStream.schema("user_id int, ts timestamp_ntz").parquet(str(tmp_path / "ev")))
    q = s.writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n_events for r in spark.table("sessions_out").collect()] == [3]
