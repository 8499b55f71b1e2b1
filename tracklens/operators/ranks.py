"""Exact distribution statistics without pulling a group into one task.

Values are first compressed to (key, value, count) rows - a map-side combined
aggregate - and positions come from a running count over those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import skew


def _running(df: DataFrame, keys: list[str], value: str, hot: DataFrame | None) -> DataFrame:
    aggs = {"_before": ("sum", F.col("_n"))}
    if keys and hot is not None:
        df = cut(df)  # compressed counts are read three times below
    if keys:
        # a hot key may still have few distinct values: decide on the compressed rows
        by_value = None if hot is None else skew.hot_keys(df, keys, value)
        out = skew.prefix(df, keys, [value], aggs, by_value)
    else:
        out = skew.global_prefix(df, [value], aggs)
    return out.withColumn("_before", F.coalesce("_before", F.lit(0)))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], hot: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles per key; one row per key with a column per entry of ``probs``
    (a level, or a function from the group size to a level)."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, probs, hot)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, probs: dict[str, float], hot: DataFrame | None = None) -> DataFrame:
    """``quantiles`` of (keys, value, _n) rows, e.g. with implied zeros added as one row."""
    run = _running(counts, keys, value, hot)
    total = run.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if isinstance(hot, str):  # few keys: a join must not deal the rows by them
        total = F.broadcast(total)
    j = run.join(total, keys) if keys else run.withColumn("_total", total.scalar())

    def level(p):
        return p(F.col("_total")) if callable(p) else F.lit(p)

    def at(p, edge):  # value at position floor / ceil of p * (n - 1)
        k = edge(level(p) * (F.col("_total") - 1))
        hit = (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
        return F.max(F.when(hit, F.col(value)))

    parts = []
    for name, p in probs.items():
        parts += [at(p, F.floor).alias(f"_lo_{name}"), at(p, F.ceil).alias(f"_hi_{name}")]
    agg = j.groupBy(*keys).agg(F.first("_total").alias("_total"), *parts)
    cols = []
    for name, p in probs.items():
        pos = level(p) * (F.col("_total") - 1)
        frac = pos - F.floor(pos)
        cols.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac).cast("double").alias(name))
    return agg.select(*keys, *cols)


def mid_ranks(df: DataFrame, keys: list[str], value: str, out: str, hot: DataFrame | None = None) -> DataFrame:
    """(keys, value, average rank) - one row per distinct value."""
    run = _running(value_counts(df, keys, value), keys, value, hot)
    return run.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))


def _corr_from_counts(j: DataFrame, keys: list[str], rx: str, ry: str, n: str, min_n: int) -> DataFrame:
    # ranks are scaled to about [0, 1] by the group size so that sums stay well conditioned
    w = F.col(n).cast("double")
    x, y = F.col(rx), F.col(ry)
    s = j.groupBy(*keys).agg(
        F.sum(w).alias("_w"), F.sum(w * x).alias("_x"), F.sum(w * y).alias("_y"),
        F.sum(w * x * y).alias("_xy"), F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"),
    )
    cov = F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_w")
    vx = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_w")
    vy = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_w")
    ok = (F.col("_w") >= min_n) & (vx > 1e-12) & (vy > 1e-12)
    return s.select(*keys, F.col("_w").cast("long").alias("n"), F.when(ok, cov / F.sqrt(vx * vy)).alias("rho"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, hot: DataFrame | None = None, min_n: int = 3) -> DataFrame:
    """Average-rank correlation per key: (keys, n, rho); rho is NULL below ``min_n`` or for a constant side.

    Works on the (x, y) contingency table, so repeated values are joined once, not per row.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return spearman_of_counts(both.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n")), keys, x, y, hot, min_n)


def spearman_of_counts(cells: DataFrame, keys: list[str], x: str, y: str, hot: DataFrame | None = None, min_n: int = 3) -> DataFrame:
    """``spearman`` of (keys, x, y, _n) rows of known values."""
    ks = keys or ["_g"]
    if not keys:
        cells = cells.withColumn("_g", F.lit(0))
    if keys and hot is not None:
        cells = cut(cells)
    def marg(v, out):
        m = cells.groupBy(*ks, v).agg(F.sum("_n").alias("_n"))
        if keys:
            r = _running(m, keys, v, hot)
        else:
            r = _running(m.drop("_g"), [], v, None).withColumn("_g", F.lit(0))
        return r.select(*ks, v, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    tot = cells.groupBy(*ks).agg(F.sum("_n").alias("_tot"))
    if isinstance(hot, str):  # few keys: a join must not deal the rows by them
        tot = F.broadcast(tot)
    j = (
        cells.join(marg(x, "_rx"), [*ks, x]).join(marg(y, "_ry"), [*ks, y]).join(tot, ks)
        .withColumn("_rx", F.col("_rx") / F.col("_tot") - 0.5)
        .withColumn("_ry", F.col("_ry") / F.col("_tot") - 0.5)
    )
    out = _corr_from_counts(j, ks, "_rx", "_ry", "_n", min_n)
    return out if keys else out.drop("_g")


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  The rank filter sits directly on the window, so Spark prunes each
    map task to ``n`` rows per key before the shuffle (window group limit)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def upper_median(df: DataFrame, keys: list[str], value: str, hot: DataFrame | None = None) -> DataFrame:
    """min, sorted[n // 2] and max per key."""
    run = _running(value_counts(df, keys, value), keys, value, hot)
    total = run.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    k = F.floor(F.col("_total") / 2)
    hit = (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
    return run.join(total, keys).groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(F.when(hit, F.col(value))).alias("median_hi"), F.max(value).alias("max"))


def pearson(x, y):
    """corr, NULL for a constant side."""
    from pyspark.sql import functions as F

    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y))


def lazy_hot(df: DataFrame, keys: list[str], lead: str) -> DataFrame:
    """Hot keys without a look-ahead job: for keys of low cardinality, where hot groups are the rule."""
    return skew.hot_keys(df, keys, lead)
