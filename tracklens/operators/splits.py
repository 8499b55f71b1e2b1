"""Held-out splits from md5 draws: deterministic in (salt, seed, key), independent of row order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw_hex, draw_long
from . import ranks, skew


def below(frac: float) -> str:
    """Hex bound: a draw is below it with probability ``frac``."""
    return format(int(frac * 2**32), "08x")


def random_mask(df: DataFrame, seed, frac: float, salt: str = "ri", key=("player", "item")) -> DataFrame:
    return df.withColumn("is_test", draw_hex(salt, seed, *[F.col(k) for k in key]) < below(frac))


def leave_k_out(df: DataFrame, k: int, seed, group: str = "player", item: str = "item") -> DataFrame:
    """The k held-out items per player (test keys)."""
    return ranks.top_n(df.select(group, item, draw_hex(f"loo{k}", seed, F.col(group), F.col(item)).alias("_u")), [group], ["_u", item], k, "_rn").select(group, item)


def cold_groups(df: DataFrame, group: str, frac: float, seed, salt: str) -> DataFrame:
    """round(frac * n) whole groups, at least one, in draw order."""
    keys = df.select(group).distinct().withColumn("_u", draw_long(salt, seed, F.col(group)))
    ranked = skew.global_prefix(keys, ["_u", group], {"_rank": ("rank",)})
    quota = F.greatest(F.round(keys.agg(F.count(F.lit(1))).scalar() * F.lit(frac)), F.lit(1))
    return ranked.filter(F.col("_rank") <= quota).select(group)


def per_player_quota(df: DataFrame, frac: float, seed, salt: str, hot=None, order: Column | None = None) -> DataFrame:
    """max(1, round(frac * n)) random rows of every player."""
    d = df.withColumn("_u", draw_long(salt, seed, F.col("player"), F.col("item")))
    n = df.groupBy("player").agg(F.count(F.lit(1)).alias("_n"))
    by_draw = None if hot is None else hot.select("player", F.lit(0).alias("_lo"), F.lit(4294967296).alias("_hi"), "_n", "_parts")
    rk = skew.prefix(d, ["player"], ["_u", "item"], {"_rank": ("rank",)}, by_draw)
    return rk.join(n, "player").filter(F.col("_rank") <= F.greatest(F.round(F.col("_n") * frac), F.lit(1))).drop("_u", "_rank", "_n")


def group_assign(keys: DataFrame, key: str, seed, parts: list[tuple[str, float]], rest: str, salt: str = "song") -> DataFrame:
    """Whole groups to named parts by draw order: cumulative quotas, remaining groups to ``rest``."""
    k = keys.select(key).distinct()
    ranked = skew.global_prefix(k.withColumn("_u", draw_long(salt, seed, F.col(key))), ["_u", key], {"_rank": ("rank",)})
    n = k.agg(F.count(F.lit(1))).scalar()
    out, edge = F, F.lit(0)
    for name, frac in parts:
        edge = edge + F.round(n * F.lit(frac))
        out = out.when(F.col("_rank") <= edge, name)
    return ranked.select(key, out.otherwise(rest).alias("part"), F.col("_rank").alias("pos"))


def guard_swap(assigned: DataFrame, protected: DataFrame, key: str) -> DataFrame:
    """Protected groups leave train: the i-th one swaps sides with the i-th unprotected test group; movers without a donor go to val."""
    a = assigned.join(protected.select(key).distinct().withColumn("_p", F.lit(True)), key, "left").withColumn("_p", F.coalesce("_p", F.lit(False)))
    movers = skew.global_prefix(a.filter((F.col("part") == "train") & F.col("_p")).select(key, "pos"), ["pos"], {"_i": ("rank",)})
    donors = skew.global_prefix(a.filter((F.col("part") == "test") & ~F.col("_p")).select(F.col(key).alias("_d"), "pos"), ["pos"], {"_i": ("rank",)})
    pair = movers.select(key, "_i").join(donors.select("_d", "_i"), "_i", "left")
    change = pair.select(key, F.when(F.col("_d").isNull(), "val").otherwise("test").alias("_new")).unionByName(
        pair.filter("_d is not null").select(F.col("_d").alias(key), F.lit("train").alias("_new")))
    return a.join(change, key, "left").select(key, F.coalesce("_new", "part").alias("part"))


def fold(k: int, seed, *key: str, salt: str = "fold") -> Column:
    return draw_long(salt, seed, *[F.col(c) for c in key]) % k
