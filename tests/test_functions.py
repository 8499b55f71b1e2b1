import pytest
from pyspark.sql import functions as F

from tracklens.functions import columns as c, registry
from tracklens.operators import joins
from tracklens.sources import files, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_accuracy(spark):
    df = spark.createDataFrame([(1131, 374, 1530), (10, 0, 10), (5, 5, 0)], "p int, g int, n int")
    got = [r.v for r in df.select(c.acc_two_counter("p", "g", "n").alias("v")).collect()]
    assert abs(got[0] - 86.1438) < 1e-4 and got[1] == 100 and got[2] is None


def test_lamp_map(spark):
    df = spark.range(11).select(c.map_lamp(F.col("id")).alias("v"))
    assert [r.v for r in df.collect()] == [0, 1, 4, 5, 6, 7, 8, 9, 10, 2, 3]
    with pytest.raises(Exception, match="unknown lamp 99"):
        one(spark, c.map_lamp(F.lit(99)))


def test_index_decoding(spark):
    assert one(spark, c.decode_index(F.lit("zz"), F.lit(36))) == 1295
    assert one(spark, c.decode_index(F.lit("aa"), F.lit(62))) == 2268
    assert one(spark, c.decode_index(F.lit("-1"), F.lit(36))) == 0


def test_registry_guard():
    assert registry.block("h_", ["x1"]) == ["h_resp_x1", "h_slope_x1", "h_dev_x1"]
    with pytest.raises(ValueError):
        registry.guard(["x1", "level"])
    with pytest.raises(ValueError):
        registry.guard(["x1", "x1"])


def test_dimension_guard(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "item long, v string")
    with pytest.raises(ValueError, match="not 1:1"):
        joins.require_unique(d, ["item"])
    assert joins.require_unique(d.filter("v <> 'b'"), ["item"]).count() == 2


def test_report_refuses_collision(spark):
    m = spark.createDataFrame([("mae", 1.0)], "metric string, value double")
    with pytest.raises(ValueError, match="collides"):
        sinks.write_report({"value": 3}, m, sinks.scratch(spark, "r"))


def test_manifest_arity_guard(spark):
    df = spark.createDataFrame([([1.0] * 26,), ([1.0] * 27,)], "features array<double>")
    with pytest.raises(ValueError, match="1 of 2"):
        files.require_arity(df)


def test_incremental_merge_keeps_latest(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, version int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 2)], "k int, v string, version int")
    assert [r.k for r in sinks.missing(b, a, ["k"]).collect()] == [3]
    got = sorted((r.k, r.v) for r in sinks.merge_latest(a, b, ["k"], "version").collect())
    assert got == [(1, "x"), (2, "z"), (3, "w")]
