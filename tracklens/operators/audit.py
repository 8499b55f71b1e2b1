"""Audit aggregates: duplicates, coverage, saturation, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks, skew


def long_form(df: DataFrame, keys: list[str], measures: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide -> (keys, measure, value)."""
    rows = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(value)) for m in measures])
    return df.select(*keys, F.explode(rows).alias("_s")).select(*keys, f"_s.{name}", f"_s.{value}")


def metrics_long(agg_row: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One-row-per-key aggregates -> (keys, metric, value)."""
    return long_form(agg_row, list(keys), [c for c in agg_row.columns if c not in keys], "metric", "value")


def canonical(df: DataFrame, key: str, order: str, flag: Column) -> DataFrame:
    """Duplicate groups of ``key``: size, rank inside the group, OR-ed flag, canonical row."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.bool_or(flag).alias("any_flag"), F.min(order).alias("canonical"))
    ranked = skew.prefix(df, [key], [order], {"group_rank": ("rank",)}, skew.probe(df, [key], order))
    return ranked.join(groups, key)


def duplicate_report(df: DataFrame, key: str, order: str, top: int) -> DataFrame:
    """Largest duplicate groups with their extra copies and first / last member."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id"))
    return g.filter("n > 1").withColumn("extra", F.col("n") - 1).orderBy(F.desc("n"), key).limit(top)


def profile(df: DataFrame, keys: list[str], value: str, hot=None) -> DataFrame:
    """min / p10 / p25 / median / p75 / p90 / max / mean / std / n."""
    q = ranks.quantiles(df, keys, value, {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}, hot)
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return m.join(q, keys)


def adjusted_skew(x) -> Column:
    """Bias-adjusted skewness (Spark's own is the population form)."""
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def stratified_probe(df: DataFrame, stratum: str, draw: str, frac: float, keep_below: int) -> DataFrame:
    """Proportional sample per stratum in draw order; strata of at most ``keep_below`` rows are kept whole."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    quota = F.when(F.col("_size") <= keep_below, F.col("_size")).otherwise(F.greatest(F.round(F.col("_size") * frac), F.lit(1)))
    ranked = skew.prefix(df, [stratum], [draw], {"_rank": ("rank",)}, ranks.lazy_hot(df, [stratum], draw))
    return ranked.join(sizes, stratum).filter(F.col("_rank") <= quota).drop("_rank", "_size")


def coverage(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Share of rows where every column of a family is present, and of all families together."""
    def full(cols):
        cond = F.lit(True)
        for c in cols:
            cond = cond & F.col(c).isNotNull()
        return cond

    every = [c for cols in families.values() for c in cols]
    aggs = [F.avg(full(cols).cast("double")).alias(n) for n, cols in families.items()] + [F.avg(full(every).cast("double")).alias("common")]
    return metrics_long(df.agg(*aggs))


def version_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Changed rows, largest absolute delta and maxima per column between two versions of a table."""
    j = old.select(key, *[F.col(c).alias(f"o_{c}") for c in cols]).join(new.select(key, *[F.col(c).alias(f"n_{c}") for c in cols]), key)
    per = [F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").cast("double").alias("o"), F.col(f"n_{c}").cast("double").alias("v")) for c in cols]
    x = j.select(F.explode(F.array(*per)).alias("s")).select("s.*")
    return x.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o") != F.col("v"), 1)).alias("changed"),
                                   F.max(F.abs(F.col("o") - F.col("v"))).alias("max_delta"), F.max("o").alias("max_old"), F.max("v").alias("max_new"))
