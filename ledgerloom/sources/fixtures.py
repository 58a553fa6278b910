"""A generated archive of any size with its ground truth, computed by rule on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.archive import format_amount

NAMES = [a + b for a in ("Al", "Be", "Co", "Da", "El") for b in ("mar", "nau", "rix", "sto", "ven")]
TRADES = ["Logistik", "Handel", "Papier", "Technik", "Energie", "Spedition", "Werke", "Kontor"]
TYPES = [("invoice", "Rechnung"), ("statement", "Kontoauszug"), ("ledger", "Hauptbuch"), ("budget", "Budget")]
YEARS, FIRST_YEAR = 5, 2021
SUPERSEDED_EVERY = 17


def scale_corpus(spark: SparkSession, n_docs: int, seed: int = 1) -> DataFrame:
    """source, content, doc_type, client, year, quarter, ref, amount, superseded: n_docs files of the archive.

    The grid is client x year x quarter x type, repeated if more are asked for.
    A file holds a property block, an empty line and a register of three to
    eight rows; every 17th document is the superseded first version of the one
    before it.
    """
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    h = lambda salt, n: F.pmod(F.xxhash64("grid", F.lit(f"{seed}/{salt}")), F.lit(n))
    d = spark.range(n_docs).withColumn("superseded", F.col("id") % SUPERSEDED_EVERY == SUPERSEDED_EVERY - 1)
    d = d.withColumn("grid", F.when(F.col("superseded"), F.col("id") - 1).otherwise(F.col("id")))
    g = F.col("grid")
    d = d.select(
        "id", "grid", "superseded", pick([t for t, _ in TYPES], g).alias("doc_type"), pick([t for _, t in TYPES], g).alias("title"), (g / 4).cast("long").alias("g"),
    )
    d = d.withColumn("quarter", (F.col("g") % 4 + 1).cast("int")).withColumn("year", ((F.col("g") / 4).cast("long") % YEARS + FIRST_YEAR).cast("int"))
    c = (F.col("g") / (4 * YEARS)).cast("long")
    d = d.withColumn("client", F.concat_ws(" ", pick(NAMES, c), pick(TRADES, (c / len(NAMES)).cast("long"))))
    d = d.withColumn("ref", F.format_string("%s-%d-%05d", F.upper(F.left("doc_type", F.lit(3))), "year", (F.col("grid") % 100000).cast("int")))
    rows = F.transform(F.sequence(F.lit(1), (h("rows", 6) + 3).cast("int")), lambda i: F.struct(i.alias("nr"), (F.pmod(F.xxhash64("grid", i, F.lit(seed)), F.lit(9_000_000)) / 100 + 10).alias("amount")))
    d = d.withColumn("rows", rows).withColumn("amount", F.round(F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["amount"]), 2))
    shown: Column = F.when(F.col("superseded"), F.round(F.col("amount") * 1.1, 2)).otherwise(F.col("amount"))
    version = F.when(F.col("superseded"), "1").otherwise("2")
    line = lambda k, v: F.concat(F.lit(f"{k};"), v.cast("string"))
    head = F.array(F.lit("Feld;Wert"), line("Dokumenttyp", F.col("title")), line("Kunde", F.col("client")), line("Geschaeftsjahr", F.col("year")), line("Quartal", F.concat(F.lit("Q"), F.col("quarter").cast("string"))), line("Belegnummer", F.col("ref")), line("Version", version), line("Nettobetrag (EUR)", format_amount(shown)), F.lit("Waehrung;EUR"), F.lit(""), F.lit("Position;Beschreibung;Betrag (EUR)"))
    body = F.transform("rows", lambda r: F.concat_ws(";", r["nr"].cast("string"), F.concat(F.lit("Posten "), r["nr"].cast("string")), format_amount(r["amount"])))
    name = F.concat(F.col("title"), F.lit("_"), F.replace("client", F.lit(" "), F.lit("_")), F.format_string("_%d_Q%d_%d", "year", "quarter", "grid"), F.when(F.col("superseded"), "_v1").otherwise(""), F.lit(".csv"))
    return d.select(name.alias("source"), F.array_join(F.concat(head, body), "\n").alias("content"), "doc_type", "client", "year", "quarter", "ref", shown.alias("amount"), "superseded")


def ground_truth(corpus: DataFrame, per_kind: int = 80) -> DataFrame:
    """query_id, kind, query, expect_source, expect_text: questions to the current documents of a corpus, at most per_kind of each kind."""
    d = corpus.where("not superseded")
    period = F.format_string("Q%d %d", "quarter", "year")
    asked = {
        "verbatim_control": F.concat_ws(" ", "doc_type", "client", period, "ref"), "exact_identifier": F.col("ref"), "paraphrase": F.concat(F.lit("Was wurde von "), F.col("client"), F.lit(" im "), period, F.lit(" verlangt?")),
        "type_synonym": F.concat_ws(" ", F.lit("Beleg"), "client", period), "amount_lookup": F.concat(F.lit("Wer hat "), format_amount(F.col("amount")), F.lit(" EUR?")),
    }
    out = None
    for kind, q in asked.items():
        part = d.orderBy(F.xxhash64("source", F.lit(kind)), "source").limit(per_kind if kind != "amount_lookup" else per_kind // 2)
        part = part.select(F.concat_ws(":", F.lit(kind), "source").alias("query_id"), F.lit(kind).alias("kind"), q.alias("query"), F.col("source").alias("expect_source"), F.col("ref").alias("expect_text"))
        out = part if out is None else out.unionByName(part)
    return out
