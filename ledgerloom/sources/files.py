"""Files of an archive into elements and table payloads.

A folder is read with ``binaryFile``; each file is parsed where it lies. A file
that cannot be read gives one notice instead of failing the job. CSV, Markdown,
text, XLSX and DOCX are read with the standard library; PDF needs pdfplumber
and gives a notice without it.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.archive import guess_lang, infer_doc_type, infer_year
from ..session import ship

SUFFIXES = (".pdf", ".xlsx", ".xlsm", ".docx", ".csv", ".md", ".txt")
ROWS_INDEXED, ROWS_TABULATED = 2_000, 200_000
BLOCK_CHARS = 1_200
TABLE = "struct<headers:array<string>,rows:array<struct<row:int,locator:string,cells:array<string>>>,n_rows_total:int,n_rows_seen:int,n_rows_indexed:int,sheet:string,page:int>"
ELEMENTS = f"doc_id string, element_id string, source string, path string, kind string, text string, locator string, page int, sheet string, row int, table_id string, reason string, payload {TABLE}"


class Unreadable(Exception):
    """A file that needs a library which is not there."""


def decode(raw: bytes) -> str:
    """Text of a file: UTF-8 if it is valid, a detected encoding for larger files, else the usual legacy ones."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if len(raw) >= 2048:
        try:
            from charset_normalizer import from_bytes

            if (best := from_bytes(raw).best()) is not None:
                return str(best)
        except ImportError:
            pass
    try:
        return raw.decode("cp1252")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def one_line(value) -> str:
    return "" if value is None else str(value).replace("\n", " ").strip()


def table_elements(source: str, table_id: str, headers: list[str], body: list[tuple[int, str, list[str]]], title: str, **place) -> list[dict]:
    """Summary with the whole table as payload, then a self-describing line per row up to the retrieval cap."""
    out = []
    if len(body) > ROWS_INDEXED:
        out.append({"kind": "notice", "reason": "row_cap", "text": f"[{source}] Nur die ersten {ROWS_INDEXED} von {len(body)} Zeilen indexiert. / Only the first {ROWS_INDEXED} of {len(body)} rows were indexed."})
    indexed = body[:ROWS_INDEXED]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    shown = [line(headers), "|" + "---|" * len(headers), *(line(c) for _, _, c in indexed[:40])]
    if len(indexed) > 40:
        shown.append(f"… {len(indexed) - 40} weitere Zeilen / more rows")
    kept = body[:ROWS_TABULATED]
    payload = {"headers": headers, "rows": [{"row": n, "locator": loc, "cells": cells} for n, loc, cells in kept], "n_rows_total": len(body), "n_rows_seen": len(kept), "n_rows_indexed": len(indexed), "sheet": place.get("sheet"), "page": place.get("page")}
    out.append({"kind": "table_summary", "text": f"{title} ({len(body)} Datenzeilen):\n" + "\n".join(shown), "table_id": table_id, "payload": payload, **place})
    for n, loc, cells in indexed:
        text = " | ".join(f"{headers[i] if i < len(headers) and headers[i] else f'Spalte {i + 1}'}: {c}" for i, c in enumerate(cells) if c)
        if text:
            out.append({"kind": "table_row", "text": text, "locator": loc, "row": n, "table_id": table_id, **place})
    return out


def blocks_of(rows: list[list[str]]) -> list[list[tuple[int, list[str]]]]:
    """Runs of filled rows with their line numbers, split at empty rows."""
    out: list[list[tuple[int, list[str]]]] = [[]]
    for n, r in enumerate(rows, 1):
        if any(c.strip() for c in r):
            out[-1].append((n, r))
        elif out[-1]:
            out.append([])
    return [b for b in out if b]


def read_csv(raw: bytes, source: str, doc: str) -> list[dict]:
    """Every block of a file is a table of its own; locators are the file's line numbers."""
    text = decode(raw)
    head = text[:4096]
    try:
        dialect = csv.Sniffer().sniff(head, delimiters=",;\t|")
        rows = list(csv.reader(io.StringIO(text), dialect))
    except csv.Error:
        rows = list(csv.reader(io.StringIO(text), delimiter=";" if head.count(";") > head.count(",") else ","))
    blocks = blocks_of(rows)
    out = []
    for k, block in enumerate(blocks, 1):
        many = len(blocks) > 1
        body = [(n, f"Zeile {n}", [one_line(c) for c in r]) for n, r in block[1:]]
        out += table_elements(source, f"{doc}:csv{k if many else ''}", [one_line(c) for c in block[0][1]], body, source + (f", Block {k}" if many else ""))
    return out


def paragraphs(text: str, limit: int = BLOCK_CHARS) -> list[str]:
    """Paragraphs put together up to the limit; a heading begins a new block."""
    out: list[list[str]] = [[]]
    for p in (x.strip() for x in text.split("\n\n")):
        if not p:
            continue
        if out[-1] and (p.startswith("#") or sum(map(len, out[-1])) + len(p) > limit):
            out.append([])
        out[-1].append(p)
    return ["\n\n".join(b) for b in out if b]


def read_text(raw: bytes, source: str, doc: str) -> list[dict]:
    return [{"kind": "text", "text": b, "locator": f"Abschnitt {n}"} for n, b in enumerate(paragraphs(decode(raw).strip().replace("\r\n", "\n")), 1)]


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def read_xlsx(raw: bytes, source: str, doc: str) -> list[dict]:
    """Every worksheet is a table; formulas without a stored value are announced."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    text_of = lambda e: "".join(t.text or "" for t in e.iter() if _local(t) == "t")
    shared = [text_of(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {e.get("Id"): e.get("Target").lstrip("/") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for k, sheet in enumerate((e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"), 1):
        name = sheet.get("name")
        ref = next(v for a, v in sheet.attrib.items() if a.endswith("}id"))
        path = targets[ref] if targets[ref].startswith("xl/") else "xl/" + targets[ref]
        rows, missing = [], 0
        for r in (e for e in ElementTree.fromstring(z.read(path)).iter() if _local(e) == "row"):
            cells: dict[int, str] = {}
            for c in r:
                col = 0
                for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                    col = col * 26 + ord(ch) - 64
                parts = {_local(x): x for x in c}
                value = (parts["v"].text or "") if "v" in parts else text_of(parts["is"]) if "is" in parts else ""
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                missing += "f" in parts and not value and len(rows) < 200
                cells[col or len(cells) + 1] = one_line(value)
            rows.append((int(r.get("r", len(rows) + 1)), [cells.get(i, "") for i in range(1, max(cells, default=0) + 1)]))
        filled = [x for x in rows if any(x[1])]
        if missing:
            out.append({"kind": "notice", "reason": "formula_cache_miss", "sheet": name, "text": f"[{source}] {name}: {missing} Formeln ohne gespeicherten Wert. / formulas without a stored value."})
        if filled:
            body = [(n, f"{name}!Z{n}", cells) for n, cells in filled[1:]]
            out += table_elements(source, f"{doc}:s{k}", filled[0][1], body, f"{source}, {name}", sheet=name)
    return out


def read_docx(raw: bytes, source: str, doc: str) -> list[dict]:
    """All paragraphs outside tables as one text; every table as a table."""
    body = next(e for e in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")) if _local(e) == "body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter() if _local(t) == "t")
    text = "\n".join(t for e in body if _local(e) == "p" and (t := text_of(e).strip()))
    out = [{"kind": "text", "text": text, "locator": "Dokument"}] if text else []
    for k, t in enumerate((e for e in body if _local(e) == "tbl"), 1):
        grid = [[one_line(text_of(c)) for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"]
        if grid:
            out += table_elements(source, f"{doc}:t{k}", grid[0], [(n, f"Tabelle {k}, Zeile {n}", g) for n, g in enumerate(grid[1:], 2)], f"{source}, Tabelle {k}")
    return out


def read_pdf(raw: bytes, source: str, doc: str) -> list[dict]:
    """Text per page without its tables, and the tables; a page without text layer is announced."""
    try:
        import pdfplumber
    except ImportError as e:
        raise Unreadable("pdfplumber is not installed") from e
    out = []
    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            tables = page.find_tables()
            rest = page
            for t in tables:
                rest = rest.outside_bbox(t.bbox)
            text = (rest.extract_text() or "").strip()
            if text:
                out.append({"kind": "text", "text": text, "locator": f"S. {n}", "page": n})
            for k, t in enumerate(tables, 1):
                grid = [[one_line(c) for c in r] for r in t.extract()]
                if grid:
                    out += table_elements(source, f"{doc}:p{n}t{k}", grid[0], [(i, f"S. {n}, Tabelle {k}, Zeile {i}", g) for i, g in enumerate(grid[1:], 2)], f"{source}, S. {n}", page=n)
            if len(text) < 20 and not tables:
                out.append({"kind": "notice", "reason": "no_text_layer", "page": n, "text": f"[{source}] Seite {n} ohne Textebene. / page {n} has no text layer."})
    return out


READERS = {".csv": read_csv, ".md": read_text, ".txt": read_text, ".xlsx": read_xlsx, ".xlsm": read_xlsx, ".docx": read_docx, ".pdf": read_pdf}


def parse(name: str, raw: bytes) -> tuple[str, list[dict]]:
    """(doc_id, elements) of one file; unknown formats and failures are notices."""
    doc_id = hashlib.sha256(raw).hexdigest()
    suffix = "." + name.rpartition(".")[2].lower() if "." in name else ""
    reader = READERS.get(suffix)
    if reader is None:
        return doc_id, [{"kind": "notice", "reason": "unsupported_format", "text": f"[{name}] Nicht unterstütztes Format '{suffix}'. / Unsupported format."}]
    try:
        return doc_id, reader(raw, name, doc_id[:16])
    except Exception as e:  # noqa: BLE001 - a bad file must not end the job
        return doc_id, [{"kind": "notice", "reason": "parse_error", "text": f"[{name}] Datei konnte nicht gelesen werden / could not be parsed: {type(e).__name__}: {e}"}]


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime, content of the supported files below a folder."""
    names = "|".join(s[1:] for s in SUFFIXES)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(rf"(?i)\.({names})$"))


def elements_of(files: DataFrame, content_col: str = "content", path_col: str = "path") -> DataFrame:
    """Elements of every file, in order: element_id is the document's hash and the ordinal."""
    names = ["kind", "text", "locator", "page", "sheet", "row", "table_id", "reason", "payload"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, raw in zip(b[path_col], b[content_col]):
                name = path.rpartition("/")[2]
                doc_id, found = parse(name, bytes(raw))
                for n, e in enumerate(found, 1):
                    rows.append({"doc_id": doc_id, "element_id": f"{doc_id[:16]}:{n:05d}", "source": name, "path": path, **{k: e.get(k) for k in names}})
            out = pd.DataFrame(rows, columns=["doc_id", "element_id", "source", "path", *names])
            for c in ("page", "row"):
                out[c] = out[c].astype("Int32")
            yield out

    ship(files.sparkSession)
    return files.select(path_col, content_col).mapInPandas(run, ELEMENTS)


def describe(elements: DataFrame) -> DataFrame:
    """doc_id, doc_type, year of every document, from its name and its first text."""
    first = elements.groupBy("doc_id").agg(F.min("source").alias("source"), F.coalesce(F.min_by(F.when(F.col("kind") != "notice", F.col("text")), F.when(F.col("kind") != "notice", F.col("element_id"))), F.lit("")).alias("sample"))
    return first.select("doc_id", infer_doc_type(F.col("source"), F.col("sample")).alias("doc_type"), infer_year(F.col("source"), F.col("sample")).alias("year"))


def payloads_of(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Table payloads with the type and year of their documents, as ``operators.extract`` takes them."""
    t = elements.where("payload is not null").join(documents.select("doc_id", "doc_type", "year"), "doc_id")
    return t.select(F.col("table_id").alias("table_uid"), "doc_id", "source", "table_id", "sheet", "page", "doc_type", "year", "payload.headers", "payload.rows", "payload.n_rows_total", "payload.n_rows_seen", "payload.n_rows_indexed")


def passages_of(elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Elements that can be retrieved, with a language guess, type and year."""
    p = elements.where((F.col("kind") != "notice") & (F.trim("text") != "")).join(documents.select("doc_id", "doc_type", "year"), "doc_id")
    return p.select(F.xxhash64("element_id").alias("id"), "doc_id", "element_id", "source", "kind", "text", "locator", "page", "sheet", F.col("row").alias("row_no"), "table_id", guess_lang(F.col("text")).alias("lang_hint"), "doc_type", "year")
