"""Folder ingest as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import SUFFIXES, describe, elements_of, passages_of


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder as they arrive."""
    names = "|".join(s[1:] for s in SUFFIXES)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(rf"(?i)\.({names})$"))


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parse what is new and append its passages to a Parquet folder, then stop.

    A content that is already in the target is skipped, within a batch and
    across batches. A batch that is run again writes the same folder of its own
    and so replaces itself.
    """

    def merge(files: DataFrame, epoch: int) -> None:
        own = f"{target}/batch={epoch}"
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        known = spark.read.parquet(target).where(F.col("batch") != epoch) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
        one = files.withColumn("doc_id", F.sha2("content", 256)).dropDuplicates(["doc_id"])
        if known is not None:
            one = one.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
        parsed = elements_of(one).persist()
        passages_of(parsed, describe(parsed)).write.mode("overwrite").parquet(own)
        parsed.unpersist()

    return file_stream(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
