"""Joins of the engine: dimension lookups with guards, bridges, priority unions, overlap counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def duplicate_keys(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break the 1:1 rule of a dimension table."""
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_unique(dim: DataFrame, keys: list[str]) -> DataFrame:
    """``dim`` unchanged, or ValueError naming one offending key."""
    bad = duplicate_keys(dim, keys).head(1)
    if bad:
        raise ValueError(f"dimension is not 1:1 on {keys}: {bad[0].asDict()}")
    return dim


def dim_left(fact: DataFrame, dims: list[DataFrame], key: str) -> DataFrame:
    """fact left-joined to each dimension.  The physical join is left to the optimiser: it
    broadcasts by measured size and otherwise sorts, with skewed partitions split at run time."""
    return reduce(lambda f, d: f.join(d, key, "left"), dims, fact)


def with_indicator(left: DataFrame, right: DataFrame, keys: list[str], flag: str = "matched") -> DataFrame:
    return left.join(right.withColumn(flag, F.lit(True)), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def bridge(df: DataFrame, primary: DataFrame, fallback: DataFrame, key: str, alt_key: str, value: str) -> DataFrame:
    """``value`` by ``key`` first, by ``alt_key`` where the first lookup found nothing."""
    p = primary.select(F.col(key), F.col(value).alias("_by_key"))
    f = fallback.select(F.col(alt_key), F.col(value).alias("_by_alt"))
    return df.join(p, key, "left").join(f, alt_key, "left").withColumn(value, F.coalesce("_by_key", "_by_alt")).drop("_by_key", "_by_alt")


def priority_union(tables: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Stack tables in priority order; the first table that holds a key supplies its row."""
    tagged = [df.withColumn("table", F.lit(name)).withColumn("_prio", F.lit(i)) for i, (name, df) in enumerate(tables)]
    stacked = reduce(DataFrame.unionByName, tagged)
    return ranks.top_n(stacked, [key], ["_prio", "level"], 1, "_rn").drop("_rn", "_prio")


def roster_sets(df: DataFrame, item: str, member: str, extra: list[str] = ()) -> DataFrame:
    """(extra..., members, n_items): how many items were seen by exactly this set of roster members.

    The roster is a fixed dimension, so a set is a sorted array of at most its size; no pair is formed inside an item.
    """
    sets = df.groupBy(item, *extra).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.groupBy(*extra, "members").agg(F.count(F.lit(1)).alias("n_items"))


def pair_overlap(sets: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Co-seen item count for every pair of roster members, from the histogram of member sets."""
    first = sets.select(*extra, "n_items", "members", F.explode("members").alias("a"))
    both = first.select(*extra, "n_items", "a", F.explode(F.filter("members", lambda b: b > F.col("a"))).alias("b"))
    return both.groupBy(*extra, "a", "b").agg(F.sum("n_items").alias("n_both"))


def bit(pos: Column) -> Column:
    """1 << pos as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), pos)
