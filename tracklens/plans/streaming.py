"""Streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import epoch_seconds
from ..sources import sinks
from ..sources import tables as t
from ..streaming import first_play as fs
from . import sqlparts as S
from .registry import query


WEEKS = f"""WITH {S.LOG}, f AS (SELECT player, item, min(ts) AS ts FROM log GROUP BY 1, 2) SELECT strftime(date_trunc('week', make_timestamp(ts * 1000000)), '%Y-%m-%d') AS week, count(*) AS n FROM f GROUP BY 1"""
SLICES = 4
KEEP = "4000 days"  # longer than the log: no play of a known key may count again


def timed_log(spark, sf):
    return t.play_log(spark, sf).select("player", "item", "ts", F.timestamp_seconds("ts").alias("time"), "acc", "lamp")


@query("stm_first_play", WEEKS)
def stm_first_play(spark, sf):
    """The log arrives in time order, slice after slice; each is drained from where the last one ended.  First plays are kept in
    event-time state and counted in streaming weekly windows."""
    src, out, ck = (sinks.scratch(spark, n) for n in ("log", "weeks", "commit"))
    lo, hi = t.table(spark, sf, "orders", "o_orderdate").select(epoch_seconds("o_orderdate").alias("ts")).agg(F.min("ts"), F.max("ts")).first()
    ends = [] if lo is None else [lo + (hi + 1 - lo) * k // SLICES for k in range(1, SLICES)]
    sliced = sum(((F.col("ts") >= e).cast("int") for e in ends), F.lit(0)).alias("slice")
    timed_log(spark, sf).filter("ts is not null").select("*", sliced).write.partitionBy("slice").parquet(src)
    if spark.read.schema(fs.SCHEMA).parquet(src).isEmpty():
        return spark.createDataFrame([], "week string, n long")
    for i in range(SLICES):
        stream = fs.log_stream(spark, f"{src}/slice=[0-{i}]", 1_000_000)  # slice i has arrived
        with fs.settings(spark, fs.ON_DISK | fs.NO_EMPTY_BATCHES):
            fs.run_windows(fs.weekly_windows(fs.first_plays_in_order(stream, KEEP)), out, ck)
    return fs.latest_windows(spark, out).select(F.date_format("week", "yyyy-MM-dd").alias("week"), "n")


@query("stm_first_play_any_order", WEEKS)
def stm_first_play_any_order(spark, sf):
    """The log arrives as files in any order over several micro-batches; the streamed first plays give the batch answer."""
    src, out, ck = (sinks.scratch(spark, n) for n in ("log", "first", "commit"))
    timed_log(spark, sf).write.parquet(src)
    fs.run_updates(fs.first_plays(fs.log_stream(spark, src, 4)), out, ck)
    return fs.weekly(fs.compact(spark, out))
