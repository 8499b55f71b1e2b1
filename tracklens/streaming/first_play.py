"""Streaming first plays: play-log files in, one row per (player, item) out."""

from __future__ import annotations

import sys
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

SCHEMA = "player long, item long, ts long, time timestamp, acc double, lamp int"
KEY = ["player", "item"]
MERGE_ROWS = 50_000
ON_DISK = {  # state beyond the executors' memory: one entry for each key ever seen
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
NO_EMPTY_BATCHES = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}  # where nothing is ever forgotten, a batch without rows only writes all state again


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """The session with ``conf``, and as it was afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _least(rows):
    """(player, item, time) as an Arrow table: the least time of every key."""
    return rows.group_by(KEY, use_threads=False).aggregate([("time", "min")]).select([*KEY, "time_min"]).rename_columns([*KEY, "time"])


def earliest_rows(batches):
    """Earliest row of every key of Arrow batches.  New rows are merged once they are as many as those held, so a row is grouped a few times at most,
    however many batches there are."""
    import pyarrow as pa

    held, new, n = [], [], 0
    for b in batches:
        new.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n >= max(MERGE_ROWS, sum(h.num_rows for h in held)):
            held, new, n = [_least(pa.concat_tables([*held, *new], promote_options="default"))], [], 0
    if n:
        held = [_least(pa.concat_tables([*held, *new], promote_options="default"))]
    for h in held:
        yield from h.combine_chunks().to_batches(max_chunksize=MERGE_ROWS)


def earliest(stream: DataFrame) -> DataFrame:
    """(player, item, time): the earliest row of every key in a micro-batch.

    The rows of a key meet in one task, which holds one time for each of its keys."""
    return stream.select(*KEY, "time").repartition(*KEY).mapInArrow(earliest_rows, "player long, item long, time timestamp")


def first_plays_in_order(stream: DataFrame, keep: str) -> DataFrame:
    """For a feed in time order: one row per key passes, the earliest of the first micro-batch that has the key.

    Event time rules: a key is forgotten ``keep`` after its row, so a play later than that counts as a first one again, and a row
    more than ``keep`` behind the newest one is late: it is dropped, and ``run_windows`` counts it.  A key whose earliest row of
    a micro-batch is late is late there as a whole, and so are times up to 1970, where event time starts; feeds out of order by more than ``keep`` take ``first_plays``."""
    return earliest(stream).withWatermark("time", keep).dropDuplicatesWithinWatermark(KEY)


def weekly_windows(first: DataFrame) -> DataFrame:
    """Streaming tumbling windows over first plays: (week, n), a week again in each micro-batch that changes it."""
    return first.groupBy(week_of("time").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week"), "n")


def first_plays(stream: DataFrame) -> DataFrame:
    """For any feed order: earliest time per key, re-emitted only when it improves or first appears (update mode)."""
    return stream.groupBy(*KEY).agg(F.min("time").alias("time"))


def run_updates(agg: DataFrame, out: str, checkpoint: str) -> None:
    """Drain the available input.  Every micro-batch lands in its own folder, so a repeated batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_windows(windows: DataFrame, out: str, checkpoint: str) -> int:
    """Drain the available input into ``out`` (one folder a micro-batch) and return the number of late rows dropped."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators)


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """(week, n) as of the last micro-batch that changed the week."""
    rows = spark.read.schema("week timestamp, n long, batch long").parquet(out)
    return rows.groupBy("week").agg(F.max_by("n", "batch").alias("n"))


def compact(spark: SparkSession, out: str) -> DataFrame:
    """Latest state per key from the update folders."""
    return spark.read.parquet(out).groupBy(*KEY).agg(F.min("time").alias("time"))


def week_of(time: str):
    """The week (from Monday) of a time as a tumbling window."""
    return F.window(time, "7 days", startTime="4 days")  # the epoch was a Thursday


def weekly(fp: DataFrame) -> DataFrame:
    """Tumbling weekly counts of a table of first plays."""
    return fp.groupBy(week_of("time").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("week"), "n")
