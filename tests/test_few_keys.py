"""Statistics of few large groups: no join deals the rows by the group."""

from pyspark.sql import functions as F

from tracklens.operators import models as M, ranks


def test_totals_of_few_keys_are_broadcast(spark):
    d = spark.range(300).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for auto, plain in ((ranks.spearman(d, ["g"], "x", "y", "auto"), ranks.spearman(d, ["g"], "x", "y")), (ranks.quantiles(d, ["g"], "x", {"m": 0.5}, "auto"), ranks.quantiles(d, ["g"], "x", {"m": 0.5}))):
            assert "BroadcastHashJoin" in auto._jdf.queryExecution().executedPlan().toString()
            assert sorted(auto.collect()) == sorted(plain.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_parts_of_a_fit_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "FIT_ROWS", 10)
    out = M.spread(spark.range(200))
    assert out.rdd.getNumPartitions() == 20 and out.count() == 200
