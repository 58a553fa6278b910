"""Result files, manifests, the append-only log and the rewriting of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.records import scrub


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of a ground-truth file: one JSON object with both lists."""
    m = spark.read.option("multiLine", "true").json(path)
    return m.select(F.inline("documents")), m.select(F.inline("queries"))


def write_results(results: DataFrame, folder: str, name: str, expected: int | None = None, kind: str = "csv") -> str:
    """Write results as CSV or JSON; a run with fewer rows than expected goes to a folder of its own.

    So a partial run never replaces a full one. Returns the folder written.
    """
    partial = expected is not None and results.count() < expected
    target = f"{folder}/{name}{'.partial' if partial else ''}"
    out = results.write.mode("overwrite")
    (out.option("header", "true").csv(target) if kind == "csv" else out.json(target))
    return target


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def append_audit(entries: DataFrame, path: str) -> int:
    """Append entries to a log of Parquet files under ids that follow the greatest one; returns how many.

    Entries are put in the order of created_at; nothing that is there is
    touched. They are what one request logs: a small frame.
    """
    spark = entries.sparkSession
    fs, p = _files(spark, path)
    last = (spark.read.parquet(path).agg(F.max("id").alias("m")).first().m or 0) if fs.exists(p) else 0
    nth = F.row_number().over(Window.orderBy("created_at"))
    numbered = entries.drop("id").withColumn("id", (nth + F.lit(last)).cast("bigint")).select("id", *[c for c in entries.columns if c != "id"])
    n = numbered.count()
    if n:
        numbered.write.mode("append").parquet(path)
    return n


def scrub_files(spark: SparkSession, paths: dict[str, str], thread_id: str) -> dict[str, int]:
    """Rewrite every table that has a thread_id without the rows of one thread; returns the rows removed per table.

    The new files are written beside the old ones and take their place by
    renaming; the old files are then deleted, so the rows are gone from disk. A
    table without such rows is left as it is.
    """
    out = {}
    for name, path in paths.items():
        df = spark.read.parquet(path)
        if "thread_id" not in df.columns:
            continue
        n = df.where(F.col("thread_id") == thread_id).count()
        out[name] = n
        if n:
            fs, old = _files(spark, path)
            Path = spark._jvm.org.apache.hadoop.fs.Path
            scrub({name: df}, thread_id)[name].write.mode("overwrite").parquet(f"{path}.scrubbed")
            fs.rename(old, Path(f"{path}.old"))
            fs.rename(Path(f"{path}.scrubbed"), old)
            fs.delete(Path(f"{path}.old"), True)
    return out
