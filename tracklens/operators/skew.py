"""Ordered per-key computations that survive a key holding a large share of all rows.

A plain window puts one key into one task.  Every causal operator here goes through
``prefix`` / ``trailing`` instead: keys above ``HOT_ROWS`` rows are cut into
order-preserving chunks of about equal size over all order columns, each chunk is scanned by its own task, and a small
per-chunk carry table (one row per chunk) links the chunks.  Keys below the limit
keep the ordinary one-shuffle window plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut

HOT_ROWS = 1_000_000
CHUNK = "_chunk"
_UNTIL_PREV = (W.unboundedPreceding, -1)


def hot_keys(df: DataFrame, keys: list[str], lead: str, hot_rows: int | None = None) -> DataFrame:
    """Keys with more than ``hot_rows`` rows plus the range of their leading order column.

    One map-side combined aggregate of exact values, so a re-run after a lost executor
    yields the same chunks.  At most rows / hot_rows keys can qualify, which bounds the
    broadcast of the result.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(lead).alias("_lo"), F.max(lead).alias("_hi"))
        .filter(F.col("_n") > hot_rows)
        .withColumn("_parts", F.ceil(F.col("_n") / max(hot_rows, 1)) * 8)
    )


def probe(df: DataFrame, keys: list[str], lead: str, hot_rows: int | None = None) -> DataFrame | None:
    """``hot_keys`` or None when no key is hot (decided by a one-row look)."""
    hot = hot_keys(df, keys, lead, hot_rows)
    return None if hot.isEmpty() else hot


def _with_chunk(df: DataFrame, keys: list[str], lead: str, hot: DataFrame, span=None) -> DataFrame:
    width = (F.col("_hi") - F.col("_lo") + 1) / F.col("_parts")
    if span is not None:  # a chunk must not be narrower than the frame that looks back
        width = F.greatest(width, F.lit(span + 1))
    pos = F.floor((F.col(lead) - F.col("_lo")) / F.col("_w")).cast("long")
    slim = hot.select(*keys, F.col("_lo"), width.alias("_w"))
    return (
        df.join(F.broadcast(slim), keys, "left")
        .withColumn("_hot", F.col("_w").isNotNull())
        .withColumn(CHUNK, F.coalesce(pos, F.lit(0).cast("long")))
    )


def _equi_depth(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame) -> DataFrame | None:
    """All rows, those of hot keys in chunks of about equal size; None where no key is hot.  The chunks are range partitions over the keys and all order columns, so many rows of one
    leading value, or one far outlier, make no large chunk.  They are written once: every later step sees the same chunks."""
    parts = int(hot.agg(F.sum("_parts")).first()[0] or 0)
    if not parts:
        return None
    marked = df.join(F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True))), keys, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False))).select(*df.columns, "_hot")
    own = cut(marked.filter("_hot").repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id().cast("long")))
    return marked.filter("not _hot").withColumn(CHUNK, F.lit(0).cast("long")).unionByName(own)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local + carry, local, carry)
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def prefix(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple],
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add columns computed from the strictly earlier rows of the same key.

    ``aggs`` maps an output name to ``(kind, expr)`` with kind one of sum, count, min,
    max (over all earlier rows), rank (1-based position), prev / next (neighbour value)
    and first (value of the key's first row).  All columns share one sort.
    """
    if hot is None:
        w = W.partitionBy(*keys).orderBy(*order)
        wp = w.rowsBetween(*_UNTIL_PREV)
        cols = []
        for name, (kind, *rest) in aggs.items():
            if kind == "rank":
                c = F.row_number().over(w).cast("long")
            elif kind == "prev":
                c = F.lag(rest[0]).over(w)
            elif kind == "next":
                c = F.lead(rest[0]).over(w)
            elif kind == "first":
                c = F.first(rest[0]).over(w.rowsBetween(W.unboundedPreceding, 0))
            elif kind == "count":
                c = F.count(rest[0]).over(wp)
            else:
                c = _AGG[kind](rest[0]).over(wp)
            cols.append(c.alias(name))
        return df.select("*", *cols)

    # hot keys present: per-chunk scan + carry
    c = df.withColumn("_hot", F.lit(True)) if CHUNK in df.columns else _equi_depth(df, keys, order, hot)
    if c is None:
        return prefix(df, keys, order, aggs)
    w = W.partitionBy(*keys, CHUNK).orderBy(*order)
    wp = w.rowsBetween(*_UNTIL_PREV)
    ordering = F.struct(*order)
    local, totals, carries, finals = [], [], [], {}
    wc = W.partitionBy(*keys).orderBy(CHUNK)
    wcp = wc.rowsBetween(*_UNTIL_PREV)
    local.append(F.row_number().over(w).cast("long").alias("_rn"))
    local.append(F.lead(F.lit(1)).over(w).alias("_more"))
    totals.append(F.count(F.lit(1)).alias("_t_n"))
    carries.append(F.sum("_t_n").over(wcp).alias("_c_n"))
    for name, (kind, *rest) in aggs.items():
        l, t, k = f"_l_{name}", f"_t_{name}", f"_c_{name}"
        if kind == "rank":
            finals[name] = F.col("_rn") + F.coalesce(F.col("_c_n"), F.lit(0))
            continue
        expr = rest[0]
        if kind == "prev":
            local.append(F.lag(expr).over(w).alias(l))
            totals.append(F.max_by(F.struct(F.col("_v_" + name)), ordering).alias(t))
            carries.append(F.lag(t).over(wc)[f"_v_{name}"].alias(k))
            finals[name] = F.when(F.col("_rn") == 1, F.col(k)).otherwise(F.col(l))
        elif kind == "next":
            local.append(F.lead(expr).over(w).alias(l))
            totals.append(F.min_by(F.struct(F.col("_v_" + name)), ordering).alias(t))
            carries.append(F.lead(t).over(wc)[f"_v_{name}"].alias(k))
            finals[name] = F.when(F.col("_more").isNull(), F.col(k)).otherwise(F.col(l))
        elif kind == "first":
            local.append(F.first(expr).over(w.rowsBetween(W.unboundedPreceding, 0)).alias(l))
            totals.append(F.min_by(F.struct(F.col("_v_" + name)), ordering).alias(t))
            carries.append(F.first(t).over(wc.rowsBetween(W.unboundedPreceding, 0))[f"_v_{name}"].alias(k))
            finals[name] = F.when(F.col("_c_n").isNotNull(), F.col(k)).otherwise(F.col(l))
        else:
            fn = _AGG[kind]
            local.append(fn(expr).over(wp).alias(l))
            totals.append(fn(F.col("_v_" + name)).alias(t))
            carries.append((F.sum if kind == "count" else fn)(t).over(wcp).alias(k))
            finals[name] = _combine(kind, F.col(l), F.col(k))
    values = [r[0].alias("_v_" + n) for n, (kd, *r) in aggs.items() if r]
    per_chunk = (
        c.filter("_hot").select(*keys, CHUNK, *order_cols(order, keys), *values)
        .groupBy(*keys, CHUNK).agg(*totals)
    )
    carry = per_chunk.select(*keys, CHUNK, *carries)
    out = c.select("*", *local).join(carry, [*keys, CHUNK], "left")
    return out.select(*[x for x in df.columns if x != CHUNK], *[e.alias(n) for n, e in finals.items()])


def order_cols(order: list[str], keys: list[str]) -> list[str]:
    return [o for o in order if o not in keys]


def trailing(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    span: int,
    aggs: dict[str, Column],
    hot: DataFrame | None = None,
    by: str = "range",
    upto: int = -1,
) -> DataFrame:
    """Aggregates over a bounded trailing frame: ``[x - span, x + upto]`` on the leading order
    column (``by='range'``) or the last ``span`` rows (``by='rows'``).

    Hot keys are chunked with a halo: rows within ``span`` of the next chunk are repeated
    there, so every frame is complete inside one chunk.
    """
    def frame(w):
        return w.rowsBetween(-span, upto) if by == "rows" else w.rangeBetween(-span, upto)

    sort = order if by == "rows" else order[:1]
    if hot is None:
        w = frame(W.partitionBy(*keys).orderBy(*sort))
        return df.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    lead = order[0]
    base = df
    if by == "rows":
        lead = "_pos"
        base = prefix(df, keys, order, {lead: ("rank",)}, hot)
        hot = hot.select(*keys, F.lit(1).alias("_lo"), F.col("_n").alias("_hi"), "_parts", "_n")
    c = _with_chunk(base, keys, lead, hot, span)
    start_next = F.col("_lo") + (F.col(CHUNK) + 1) * F.col("_w")
    copies = F.when(
        F.col("_hot") & (start_next - F.col(lead) <= span + 1),
        F.array(F.col(CHUNK), F.col(CHUNK) + 1),
    ).otherwise(F.array(CHUNK))
    c = c.withColumn("_to", F.explode(copies))
    w = frame(W.partitionBy(*keys, "_to").orderBy(*([lead] if by == "range" else ["_pos"])))
    out = c.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.filter(F.col("_to") == F.col(CHUNK)).select(*df.columns, *aggs.keys())


def global_prefix(df: DataFrame, order: list[str], aggs: dict[str, tuple], chunk_rows: int | None = None) -> DataFrame:
    """``prefix`` over the whole frame without a single-task sort.

    The chunks are range partitions over all order columns, so many rows of one leading value are split as well.  They are
    written once: every later step, also of a lost executor, sees the same chunks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if chunk_rows is not None:
        df = cut(df)
        parts = max(1, -(-df.count() // chunk_rows))
    chunked = cut(df.repartitionByRange(parts, *order).withColumn(CHUNK, F.spark_partition_id()))
    return prefix(chunked.withColumn("_g", F.lit(0)), ["_g"], order, aggs, chunked).drop("_g")
