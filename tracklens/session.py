"""Session builder for tests, checks and the bench (a cluster brings its own session)."""

from __future__ import annotations

import gc
import os
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made = threading.local()  # open lists of ``passing``


def build_session(app: str = "tracklens", cpus: str | int | None = None) -> SparkSession:
    n = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where a local session names none."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        set_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """A repeatedly read intermediate as a Parquet table in the shared folder: later steps prune its columns, push
    filters into the scan and re-read files instead of recomputing the lineage, also after losing an executor.  It goes when the session ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    for made in getattr(_made, "open", []):
        made.append(out)
    return out


@contextmanager
def passing(spark: SparkSession):
    """Tables that ``cut`` writes for this thread inside the block go at its end, but for those put into the list it gives."""
    keep, made = [], []
    _made.open = [*getattr(_made, "open", []), made]
    try:
        yield keep
    finally:
        _made.open = _made.open[:-1]
        dropped(spark, *[df for df in made if not any(df is k for k in keep)])


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Removes tables that ``cut`` returned and that nothing reads any more, and lets Spark forget the shuffles and kept blocks of objects without a reference."""
    for df in frames:
        at = spark._jvm.org.apache.hadoop.fs.Path(df._cut)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()
