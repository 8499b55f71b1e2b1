"""The earliest rows of a micro-batch, and the query's slices."""

import pyarrow as pa
from pyspark.sql import functions as F

from tracklens.plans import streaming
from tracklens.streaming import first_play as fs


def test_rows_are_grouped_a_few_times_whatever_the_number_of_batches(monkeypatch):
    grouped, real = [], fs._least
    monkeypatch.setattr(fs, "_least", lambda rows: grouped.append(rows.num_rows) or real(rows))
    monkeypatch.setattr(fs, "MERGE_ROWS", 100)
    batches = [pa.record_batch({"player": [k * 100 + i if i else None for i in range(100)], "item": [7] * 100, "time": pa.array([1000 - k] * 100, pa.timestamp("us", "UTC"))}) for k in range(200)]
    out = pa.Table.from_batches(list(fs.earliest_rows(batches)))
    assert out.num_rows == 200 * 99 + 1  # the null key is one key
    assert sum(grouped) < 4 * 200 * 100  # before: all rows so far with every batch, 2 million
    first = out.filter(pa.compute.is_null(out["player"]))["time"].cast("int64").to_pylist()
    assert first == [1000 - 199]
    assert list(fs.earliest_rows([])) == []


def test_no_slice_is_streamed_twice_and_settings_come_back(spark, tmp_path, monkeypatch):
    """Empty slices in between; the session is as it was."""
    spark.createDataFrame([(1, 5, 0), (2, 5, 1), (3, 6, 390), (4, 6, 400)], "o_orderkey long, o_custkey long, d int").select("o_orderkey", "o_custkey", F.expr("timestamp_ntz'2020-01-06 00:00:00' + make_dt_interval(d)").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    rows = [(o, p, n, 1.0, 2.0, 0.01) for o, p, n in ((2, 1, 1), (2, 2, 2), (3, 1, 1), (4, 1, 1))]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    batches, real = [], fs.run_windows
    monkeypatch.setattr(fs, "run_windows", lambda *a: batches.append(spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")) or real(*a))
    before = {k: spark.conf.get(k, None) for k in fs.ON_DISK | fs.NO_EMPTY_BATCHES}
    got = {r.week: r.n for r in streaming.stm_first_play(spark, str(tmp_path)).collect()}
    assert got == {"2020-01-06": 2, "2021-01-25": 1}  # (6, 1) once, at its first play
    assert batches == ["false"] * streaming.SLICES and {k: spark.conf.get(k, None) for k in before} == before
    lines.filter("l_orderkey < 0").write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    assert streaming.stm_first_play(spark, str(tmp_path)).collect() == []
