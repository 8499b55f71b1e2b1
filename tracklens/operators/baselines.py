"""Bias baselines: global / player / item / additive effects, optionally shrunk by n / (n + k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODELS = ["global_mean", "player_mean", "item_mean", "additive", "additive_shrunk"]


def effects(train: DataFrame, keys: list[str], target: str, by: list[str] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """Mean per ``by`` and (mean, n) per key; ``by`` separates independent runs such as seeds."""
    by = list(by)
    mu = train.groupBy(*by).agg(F.avg(target).alias("mu"))
    return mu, [train.groupBy(*by, k).agg(F.avg(target).alias(f"m_{k}"), F.count(target).alias(f"n_{k}")) for k in keys]


def predict(train: DataFrame, test: DataFrame, target: str = "acc", keys=("player", "item"), by: list[str] = (), shrink_k: float = 10.0) -> DataFrame:
    """Adds one prediction column per model; an unseen key contributes no effect."""
    by = list(by)
    mu, eff = effects(train, list(keys), target, by)
    out = test.join(mu, by) if by else test.withColumn("mu", mu.scalar())
    for k, e in zip(keys, eff):
        out = out.join(e, [*by, k], "left")

    def gain(k) -> Column:
        return F.coalesce(F.col(f"m_{k}") - F.col("mu"), F.lit(0.0))

    def shrunk(k) -> Column:
        n = F.coalesce(F.col(f"n_{k}"), F.lit(0))
        return gain(k) * (n / (n + F.lit(shrink_k)))

    a, b = keys
    return out.select(
        *test.columns, F.col("mu").alias("global_mean"), (F.col("mu") + gain(a)).alias("player_mean"), (F.col("mu") + gain(b)).alias("item_mean"),
        (F.col("mu") + gain(a) + gain(b)).alias("additive"), (F.col("mu") + shrunk(a) + shrunk(b)).alias("additive_shrunk"))
