"""Sinks: parquet data sets, metric reports, ranked CSV, incremental merge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranks
from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> DataFrame:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(header: dict, metrics: DataFrame, path: str) -> DataFrame:
    """Metric rows with provenance columns as JSON; a header key that is also a metric column is refused."""
    clash = set(header) & set(metrics.columns)
    if clash:
        raise ValueError(f"report header collides with metric columns: {sorted(clash)}")
    out = metrics.select(*[F.lit(v).alias(k) for k, v in header.items()], *metrics.columns)
    out.write.mode("overwrite").json(path)
    return df_schema(out).json(path)


def df_schema(df: DataFrame):
    return df.sparkSession.read.schema(df.schema)


def write_ranked_csv(df: DataFrame, order: list, path: str) -> DataFrame:
    """Globally sorted CSV with header and quoting (range-partitioned sort, one file per range)."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return df_schema(df).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def missing(wanted: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Keys that still have to be computed."""
    return wanted.join(stored.select(*key), key, "left_anti")


def merge_latest(stored: DataFrame, fresh: DataFrame, key: list[str], version: str) -> DataFrame:
    """Union of stored and fresh rows, latest version per key."""
    return ranks.top_n(stored.unionByName(fresh), key, [F.desc(version)], 1, "_rn").drop("_rn")
