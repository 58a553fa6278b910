"""Session helpers: the shared folder, written cuts of the lineage, tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", cores: str | int = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-code-"), "ledgerloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ledgerloom", os.path.relpath(full, root)))
    sc.addPyFile(target)  # served by the driver
    sc._ledgerloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local, a temporary folder of this
    machine is taken; on a cluster without the setting this raises.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    kept = getattr(spark, "_ledgerloom_dir", None)
    if kept is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        kept = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark._ledgerloom_dir = kept
    return kept


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a written table, so a lost executor costs the reading
    of files and not the stages before them.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.__dict__.setdefault("_ledgerloom_cuts", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a table has fewer parts than these, before work that costs far more than moving them.

    A large table has parts enough and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


@contextmanager
def scratch(spark: SparkSession):
    """Delete what ``cut`` writes inside the block when it ends; frames built on it must be read inside."""
    before = spark.__dict__.pop("_ledgerloom_cuts", [])
    try:
        yield
    finally:
        drop_cuts(spark)
        spark.__dict__["_ledgerloom_cuts"] = before


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote in this session; frames built on them can no longer be read."""
    paths = spark.__dict__.pop("_ledgerloom_cuts", [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
