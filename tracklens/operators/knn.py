"""Mean outcome of the k nearest strictly-prior items of the same player.

The distance is the squared Euclidean one over axes in units of their spread, in doubles: the sum of ((a - b) / s)^2 in axis
order.  A missing axis value counts as the mean, an axis without spread as no difference; equal distances go to the earlier row.
Two exact plans:

* players with at most ``BLOCK`` rows: sorted streaming over partitions; the rows of a player meet earlier ones a tile at
  a time, and a table of the k best so far is merged with each tile;
* larger players: search over cells whose sides are powers of two, from fine to coarse.  A target only meets candidates of
  the 3^A cells around it.  What lies outside them is at least ``reach`` away: a cell side plus the way to the nearest wall of the
  target's own cell, less a margin for rounding.  A target whose k-th distance is within reach is settled, the others go on with cells
  twice as wide.  Targets and candidates also join on the epoch (power of two of the row number), which keeps later rows
  out of the join.  Of equal points only the first k rows can ever matter, so they are the only ones kept as candidates.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import ranks, skew

BLOCK = 4096
TILE = 128  # earlier rows that are merged at once
FINEST = -10  # cells of the first search: 2^-10 of the spread


def standardise(df: DataFrame, axes: list[str]) -> DataFrame:
    """Adds ``_x0.._xA`` (axis values, the mean where missing) and ``_s0.._sA`` (their spread, NULL without any)."""
    stats = df.agg(F.struct(*[f(F.col(a).cast("double")).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).alias("st")).scalar()
    out = df.withColumn("_st", stats)
    for i, a in enumerate(axes):
        out = out.withColumn(f"_x{i}", F.coalesce(F.col(a).cast("double"), F.col(f"_st.m{i}"), F.lit(0.0)))
        out = out.withColumn(f"_s{i}", F.nullif(F.col(f"_st.s{i}"), F.lit(0.0))).withColumn(f"_m{i}", F.col(f"_st.m{i}"))
    return out.drop("_st")


def _small(df: DataFrame, na: int, ks: list[int]) -> DataFrame:
    import numpy as np
    import pandas as pd

    kmax = max(ks)
    cols = [c for k in ks for c in (f"n_{k}", f"knn_{k}")]
    schema = "player long, item long, " + ", ".join(f"n_{k} long, knn_{k} double" for k in ks)

    def nearest(x, s):
        """(distance, row) of the kmax nearest earlier rows of every row, nearest first; inf where there are fewer."""
        n = len(x)
        far, who = np.full((n, kmax), np.inf), np.zeros((n, kmax), np.int64)
        for first in range(0, n - 1, TILE):
            last = min(first + TILE, n)
            later = np.arange(first + 1, n)  # rows with an earlier one in this tile
            d = np.zeros((len(later), last - first))
            for i in range(na):
                if s[i] > 0:
                    d += np.square((x[later, None, i] - x[None, first:last, i]) / s[i])
            d[np.arange(first, last)[None, :] >= later[:, None]] = np.inf
            both = np.concatenate([far[later], d], axis=1)
            rows = np.concatenate([who[later], np.broadcast_to(np.arange(first, last), d.shape)], axis=1)
            best = np.argsort(both, axis=1, kind="stable")[:, :kmax]  # rows of a tile are later than those of tiles before it
            far[later], who[later] = np.take_along_axis(both, best, 1), np.take_along_axis(rows, best, 1)
        return far, who

    def means(x, s, acc):
        far, who = nearest(x, s)
        value = np.where(np.isfinite(far), acc[who], np.nan)
        known = ~np.isnan(value)
        total, count = np.cumsum(np.where(known, value, 0.0), axis=1), np.cumsum(known, axis=1)
        at = [k - 1 for k in ks]
        return np.where(count[:, at] > 0, total[:, at] / np.maximum(count[:, at], 1), np.nan)

    def solve(pdf, edges):
        x = pdf[[f"_x{i}" for i in range(na)]].to_numpy(float)
        s = pdf[[f"_s{i}" for i in range(na)]].iloc[0].astype(float).fillna(0.0).to_numpy()
        acc = pdf["acc"].to_numpy(float)
        pos = pdf["_idx"].to_numpy(np.int64) - 1
        res = np.concatenate([means(x[a:b], s, acc[a:b]) for a, b in zip(edges, edges[1:])])
        out = {"player": pdf["player"].to_numpy(), "item": pdf["item"].to_numpy()}
        for q, k in enumerate(ks):
            out[f"n_{k}"] = np.minimum(pos, k)
            out[f"knn_{k}"] = pd.Series(res[:, q]).astype("Float64").where(~np.isnan(res[:, q]), pd.NA)
        return pd.DataFrame(out)

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cuts = np.flatnonzero(np.diff(pdf["player"].to_numpy())) + 1
            if len(cuts):  # the last player of a batch may continue in the next one
                yield solve(pdf.iloc[: cuts[-1]], [0, *cuts])
                pdf = pdf.iloc[cuts[-1]:].reset_index(drop=True)
            rest = pdf
        if rest is not None and len(rest):
            yield solve(rest, [0, len(rest)])

    src = df.select("player", "item", "_idx", "acc", *[f"_{n}{i}" for n in "xs" for i in range(na)])
    return src.repartition("player").sortWithinPartitions("player", "_idx").mapInPandas(run, schema).select("player", "item", *cols)


def _large(df: DataFrame, na: int, ks: list[int], finest: int) -> DataFrame:
    kmax = max(ks)
    xs, zs, ss = ([f"_{n}{i}" for i in range(na)] for n in "xzs")
    z = {f"_z{i}": F.coalesce((F.col(f"_x{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}"), F.lit(0.0)) for i in range(na)}
    rows = cut(df.withColumns(z).select("player", "item", "_idx", "acc", *xs, *zs, *ss))
    points = cut(ranks.top_n(rows.select("player", "_idx", "acc", *xs, *zs), ["player", *xs], ["_idx"], kmax, "_pt").drop("_pt"))
    span = rows.groupBy("player").agg(F.greatest(F.lit(0.0), *[F.max(z) - F.min(z) for z in zs]).alias("_span"))
    todo = cut(rows.join(span, "player").withColumn("_ep", F.ceil(F.log2(F.col("_idx"))).cast("int")))
    offsets = F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(t)]) for t in itertools.product((-1, 0, 1), repeat=na)])
    done, level = None, finest
    while not todo.isEmpty():
        side = float(2.0**level)  # a power of two: the number of a cell is exact

        def cell(z):
            return F.floor(F.col(z) / side).cast("long")

        # a candidate serves every epoch that still has open targets and ends after it: at most log2(rows) of them
        open_ = todo.groupBy("player", "_ep").agg(F.max("_idx").alias("_upto"))
        cand = points.join(open_, "player").filter(F.col("_idx") < F.col("_upto"))
        cand = cand.select("player", "_ep", F.col("_idx").alias("_ci"), F.col("acc").alias("_ca"), *[F.col(x).alias("c" + x) for x in xs], *[cell(z).alias(f"_g{i}") for i, z in enumerate(zs)])
        tg = todo.withColumn("_o", F.explode(offsets))
        tg = tg.withColumns({f"_g{i}": cell(z) + F.col(f"_o.o{i}") for i, z in enumerate(zs)})
        pairs = tg.join(cand, ["player", "_ep", *[f"_g{i}" for i in range(na)]]).filter(F.col("_ci") < F.col("_idx"))
        apart = [F.coalesce((F.col(x) - F.col("c" + x)) / F.col(s), F.lit(0.0)) for x, s in zip(xs, ss)]
        near = ranks.top_n(pairs.select("player", "item", "_ci", "_ca", sum((a * a for a in apart), F.lit(0.0)).alias("_d")), ["player", "item"], ["_d", "_ci"], kmax, "_r")
        agg = near.groupBy("player", "item").agg(
            F.max("_d").alias("_far"), F.count(F.lit(1)).alias("_found"),
            *[F.count(F.when(F.col("_r") <= k, 1)).alias(f"n_{k}") for k in ks],
            *[F.avg(F.when(F.col("_r") <= k, F.col("_ca"))).alias(f"knn_{k}") for k in ks])
        walls = [w for z in zs for w in (F.col(z) - cell(z) * side, (cell(z) + 1) * side - F.col(z))]
        size = F.greatest(F.lit(1.0), *[F.abs(z) for z in zs])
        reach = (F.least(*walls) + side) * (1 - 1e-9) - size * 1e-12
        need = F.least(F.lit(kmax), F.col("_idx") - 1)
        enough = (F.coalesce("_found", F.lit(0)) >= need) & (reach > 0) & (F.coalesce("_far", F.lit(0.0)) < reach * reach)
        settled = (need == 0) | (F.col("_span") < side) | enough
        step = cut(todo.join(agg, ["player", "item"], "left").withColumn("_ok", settled))
        hit = step.filter("_ok").select("player", "item", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ks], *[f"knn_{k}" for k in ks])
        done = hit if done is None else done.unionByName(hit)
        todo = step.filter(~F.col("_ok")).select(*todo.columns)
        level += 1
    return done


def prior_neighbours(fp: DataFrame, order: list[str], axes: list[str], ks: list[int], hot=None, block: int = BLOCK, finest: int = FINEST) -> DataFrame:
    """(player, item, n_k, knn_k ...) for every row; n_k is how many neighbours were available, those without an outcome included."""
    z = skew.prefix(standardise(fp, axes), ["player"], order, {"_idx": ("rank",)}, hot)
    big = fp.groupBy("player").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > block).select("player")
    if big.isEmpty():
        return _small(z, len(axes), ks)
    z, big = cut(z), cut(big)
    cols = ["player", "item", *[c for k in ks for c in (f"n_{k}", f"knn_{k}")]]
    return _small(z.join(big, "player", "left_anti"), len(axes), ks).unionByName(_large(z.join(big, "player", "left_semi"), len(axes), ks, finest).select(*cols))
