"""Note-sequence statistics.  Notes: (item, event_id, tick, lane, type, dur); lane 0 is scratch.

Ticks are integers, ``ticks`` of them per second, so gaps and bins are exact.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import draw_long
from . import ranks, skew
from .joins import bit

ORDER = ["tick", "event_id"]
SEQ = ["tick", "lane", "event_id"]


def hot_for(hot, df: DataFrame, keys: list[str], lead: str):
    """Hot finer keys; there are none unless the item itself is hot."""
    return None if hot is None else skew.hot_keys(df, keys, lead)


def gaps(notes: DataFrame, keys: list[str], hot=None) -> DataFrame:
    """Positive gaps between consecutive onsets of the same key."""
    p = skew.prefix(notes, keys, ORDER, {"_prev": ("prev", F.col("tick"))}, hot_for(hot, notes, keys, "tick"))
    return p.withColumn("gap", F.col("tick") - F.col("_prev")).filter(F.col("gap") > 0).drop("_prev")


def gap_stats(notes: DataFrame, by: list[str], probs: dict[str, float], hot=None, mean: str | None = None) -> DataFrame:
    g = gaps(notes, by, hot)
    out = ranks.quantiles(g, ["item"], "gap", probs, hot)
    if mean:
        out = out.join(g.groupBy("item").agg(F.avg("gap").alias(mean)), "item")
    return out


def per_second(notes: DataFrame, ticks: int) -> DataFrame:
    return notes.groupBy("item", F.floor(F.col("tick") / ticks).alias("sec")).agg(F.count(F.lit(1)).alias("c"))


def nps(notes: DataFrame, ticks: int, hot=None) -> DataFrame:
    """Population std and p90 of per-second counts; empty seconds enter as one weighted zero row, not as a spine."""
    sec = per_second(notes, ticks)
    bins = notes.groupBy("item").agg((F.floor(F.max("tick") / ticks) + 1).alias("bins"))
    agg = sec.groupBy("item").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"), F.count(F.lit(1)).alias("filled")).join(bins, "item").filter("bins >= 3")
    m = F.col("s") / F.col("bins")
    std = agg.select("item", F.sqrt(F.greatest(F.col("ss") / F.col("bins") - m * m, F.lit(0.0))).alias("nps_std"))
    zeros = agg.filter("bins > filled").select("item", F.lit(0).cast("long").alias("c"), (F.col("bins") - F.col("filled")).alias("_n"))
    counts = sec.join(agg.select("item"), "item", "left_semi").groupBy("item", "c").agg(F.count(F.lit(1)).alias("_n")).unionByName(zeros)
    return std.join(ranks.quantiles_of_counts(counts, ["item"], "c", {"nps_p90": 0.9}, hot), "item")


def simultaneity(notes: DataFrame) -> DataFrame:
    return notes.groupBy("item", "tick").agg(F.count(F.lit(1)).alias("c")).groupBy("item").agg(F.max("c").alias("simul_max"), F.stddev_pop("c").alias("simul_std"))


def lane_shares(notes: DataFrame) -> DataFrame:
    return notes.groupBy("item", "lane").agg(F.count(F.lit(1)).alias("c"))


def entropy(notes: DataFrame) -> DataFrame:
    # -sum p ln p = ln N - (sum c ln c) / N, so one aggregate is enough
    n = F.sum("c")
    return lane_shares(notes).groupBy("item").agg((F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n).alias("lane_entropy"))


def balance(notes: DataFrame, ticks: int) -> DataFrame:
    left = F.count(F.when(F.col("lane").between(1, 3), 1))
    right = F.count(F.when(F.col("lane").between(5, 7), 1))
    dur = (F.max("tick") - F.min("tick")) / float(ticks)
    return notes.groupBy("item").agg(
        F.when(left + right > 0, F.abs(left - right) / (left + right)).alias("hand_balance"),
        F.when(dur > 0, F.try_divide(F.count(F.when(F.col("lane") == 0, 1)), dur)).alias("scratch_nps"))


def density17(notes: DataFrame, ticks: int, high: int = 25, tiny_sec: float = 0.06, repeat_sec: float = 0.005, hot=None) -> DataFrame:
    """The 17 density / gap / lane-move / chord quantities of one item."""
    # A. per-second density; changes against empty seconds are added arithmetically
    last = notes.groupBy("item").agg(F.greatest(F.ceil(F.max("tick") / ticks), F.lit(1)).alias("n_win"))
    c = notes.join(last, "item").groupBy("item", "n_win", F.least(F.floor(F.col("tick") / ticks), F.col("n_win") - 1).alias("sec")).agg(F.count(F.lit(1)).alias("c"))
    pc = skew.prefix(c, ["item"], ["sec"], {"pc": ("prev", F.col("c")), "ps": ("prev", F.col("sec")), "ns": ("next", F.col("sec"))}, hot_for(hot, c, ["item"], "sec"))
    near = F.col("sec") == F.col("ps") + 1
    rise = F.when(F.col("ps").isNull(), F.when(F.col("sec") > 0, F.col("c")).otherwise(0)).when(near, F.abs(F.col("c") - F.col("pc"))).otherwise(F.col("c") + F.col("pc"))
    rise_max = F.when(F.col("ps").isNull(), F.when(F.col("sec") > 0, F.col("c")).otherwise(0)).when(near, F.abs(F.col("c") - F.col("pc"))).otherwise(F.greatest("c", "pc"))
    tail = F.when(F.col("ns").isNull() & (F.col("sec") < F.col("n_win") - 1), F.col("c")).otherwise(0)
    n = F.first("n_win")
    m = F.sum("c") / n
    a = pc.groupBy("item").agg(
        F.sqrt(F.greatest(F.sum(F.col("c") * F.col("c")) / n - m * m, F.lit(0.0))).alias("density_std"), (F.count(F.when(F.col("c") >= high, 1)) / n).alias("high_density_frac"),
        F.when(n > 1, F.try_divide(F.sum(rise + tail), n - 1)).otherwise(0.0).alias("density_change_mean"), F.when(n > 1, F.greatest(F.max(rise_max), F.max(tail))).otherwise(0).cast("double").alias("density_change_max"))
    # B. gaps
    g = gaps(notes, ["item"], hot)
    g = skew.prefix(g, ["item"], ["tick"], {"pg": ("prev", F.col("gap"))}, hot_for(hot, g, ["item"], "tick"))
    sec = F.col("gap") / float(ticks)
    same = F.abs(F.col("gap") - F.col("pg")) / float(ticks) < repeat_sec
    b = g.groupBy("item").agg(F.avg(sec).alias("gap_mean"), F.stddev_pop(sec).alias("gap_std"), (F.stddev_pop(sec) / F.avg(sec)).alias("gap_cv"), F.avg((sec < tiny_sec).cast("int")).alias("tiny_gap_frac"),
                              F.coalesce(F.avg(same.cast("int")), F.lit(0.0)).alias("rhythm_repeat_frac"))
    # C. lane moves and the longest same-lane run (islands numbered by the running count of changes)
    mv = skew.prefix(notes, ["item"], SEQ, {"pl": ("prev", F.col("lane"))}, hot_for(hot, notes, ["item"], "tick"))
    mv = mv.withColumn("chg", (F.col("lane") != F.coalesce("pl", F.lit(-1))).cast("long"))
    isl = skew.prefix(mv, ["item"], SEQ, {"before": ("sum", F.col("chg"))}, hot_for(hot, mv, ["item"], "tick")).withColumn("island", F.coalesce("before", F.lit(0)) + F.col("chg"))
    run = isl.groupBy("item", "island").agg(F.count(F.lit(1)).alias("len")).groupBy("item").agg(F.max("len").cast("double").alias("max_same_lane_run"))
    d = F.abs(F.col("lane") - F.col("pl"))
    mvs = mv.groupBy("item").agg(F.coalesce(F.avg(d), F.lit(0.0)).alias("lane_move_mean"), F.coalesce(F.stddev_pop(d), F.lit(0.0)).alias("lane_move_std"), F.coalesce(F.avg((d >= 4).cast("int")), F.lit(0.0)).alias("large_move_frac"))
    # D. chords
    ch = notes.groupBy("item", "tick").agg(F.count(F.lit(1)).alias("size"), F.max("lane").alias("hi"), F.min("lane").alias("lo"), F.avg("lane").alias("cent"))
    big = ch.filter("size >= 2")
    big = skew.prefix(big, ["item"], ["tick"], {"pcent": ("prev", F.col("cent"))}, hot_for(hot, big, ["item"], "tick"))
    shape = big.groupBy("item").agg(F.avg(F.col("hi") - F.col("lo")).alias("chord_span_mean"), F.avg((F.col("lo") == 0).cast("int")).alias("scratch_chord_frac"), F.coalesce(F.avg(F.abs(F.col("cent") - F.col("pcent"))), F.lit(0.0)).alias("chord_centroid_move"))
    size = ch.groupBy("item").agg(F.avg("size").alias("chord_size_mean"))
    out = a.join(b, "item", "left").join(mvs, "item").join(run, "item").join(size, "item").join(shape, "item", "left")
    return out.fillna(0.0, subset=["gap_mean", "gap_std", "gap_cv", "tiny_gap_frac", "rhythm_repeat_frac", "chord_span_mean", "scratch_chord_frac", "chord_centroid_move"])


QUANTITIES = ["density_std", "high_density_frac", "density_change_mean", "density_change_max", "gap_mean", "gap_std", "gap_cv", "tiny_gap_frac", "rhythm_repeat_frac",
              "lane_move_mean", "lane_move_std", "large_move_frac", "max_same_lane_run", "chord_size_mean", "chord_span_mean", "scratch_chord_frac", "chord_centroid_move"]


def mask_rows(notes: DataFrame) -> DataFrame:
    """Simultaneous notes as one lane bit mask per tick."""
    return notes.groupBy("item", "tick").agg(F.bit_or(bit(F.col("lane"))).alias("mask"))


def positions(notes: DataFrame, hot=None) -> DataFrame:
    """Key mask, scratch flag and gap weight min(min_gap / gap, 1) per position; last weight 0; x = 0-based position."""
    keyed = F.when(F.col("lane") >= 1, bit(F.col("lane") - 1))
    p = notes.groupBy("item", "tick").agg(F.coalesce(F.bit_or(keyed), F.lit(0).cast("long")).alias("mask"), F.bool_or(F.col("lane") == 0).alias("scratch"))
    q = skew.prefix(p, ["item"], ["tick"], {"rk": ("rank",), "nt": ("next", F.col("tick")), "prev_mask": ("prev", F.col("mask"))}, hot_for(hot, p, ["item"], "tick"))
    q = q.withColumn("gap", F.col("nt") - F.col("tick"))
    mn = q.groupBy("item").agg(F.min("gap").alias("min_gap"))
    w = F.when(F.col("gap").isNull(), 0.0).otherwise(F.least(F.col("min_gap") / F.col("gap"), F.lit(1.0)))
    return q.join(mn, "item").select("item", "tick", "mask", "scratch", w.alias("w"), (F.col("rk") - 1).alias("x"), "prev_mask")


class LaneOrders:
    """All orders of the key lanes: for each order and key mask, the mean lane and the span of the pressed keys."""

    SLICE = 256

    def __init__(self, keys: int):
        import numpy as np

        orders = np.array(list(itertools.permutations(range(keys))))
        self.lane_of = np.argsort(orders, axis=1) + 1.0  # lane of each key
        pressed = ((np.arange(1 << keys)[:, None] >> np.arange(keys)) & 1).astype(float)
        self.mean = self.lane_of @ (pressed / np.maximum(pressed.sum(1, keepdims=True), 1)).T
        self.span = np.zeros_like(self.mean)
        for m in range(1, 1 << keys):
            own = self.lane_of[:, pressed[m] > 0]
            self.span[:, m] = own.max(1) - own.min(1)
        self.names = ["".join(str(int(v)) for v in row) for row in self.lane_of]

    def travel(self, before, mask, weight):
        """Weighted way of the hand between following positions, in slices of mask pairs."""
        import numpy as np

        out = np.zeros(len(self.mean))
        for s in range(0, len(mask), self.SLICE):
            part = slice(s, s + self.SLICE)
            out += np.abs(self.mean[:, mask[part]] - self.mean[:, before[part]]) @ weight[part]
        return out

    def by_mask(self, mask, *values):
        """Values added up by mask, one array of all masks for each."""
        import numpy as np

        return [np.bincount(mask, v, self.mean.shape[1]) for v in values]


SPREADS = ["smooth", "tight", "base", "spread"]


def perm_space(notes: DataFrame, keys: int = 7, hot=None) -> DataFrame:
    """smooth / tight / base / spread over all key-lane orders: mean, std, min, max and the written order's percentile.

    Positions fold into (item, previous mask, mask) histograms, at most 4^keys rows an item.  All moments are products of
    the order table (orders x masks) with one vector by mask; only the hand's way needs mask pairs, in slices.
    """
    import numpy as np
    import pandas as pd

    pos = positions(notes, hot)
    x = F.col("x").cast("double")
    pairs = pos.groupBy("item", F.coalesce("prev_mask", F.lit(-1)).alias("before"), "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * x).alias("wx"), F.sum(F.col("w") * x * x).alias("wxx"))
    per_item = pairs.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("before", "mask", "n", "w", "wx", "wxx"))).alias("pairs"))
    names = [f"ps_{m}_{s}" for m in SPREADS for s in ("mean", "std", "min", "max", "base_pct")]

    def measure(orders: LaneOrders, pairs) -> list[float] | None:
        before, mask, n, w, wx, wxx = (np.array([p[k] for p in pairs]) for k in ("before", "mask", "n", "w", "wx", "wxx"))
        total = w.sum()
        if n.sum() < 3 or total <= 0:
            return None
        centre = wx.sum() / total
        x_spread = wxx.sum() - total * centre * centre
        weight, tilt = orders.by_mask(mask, w, wx - centre * w)
        mean_lane = orders.mean @ weight / total
        y_spread = (orders.mean**2) @ weight - total * mean_lane**2
        slope_part = (orders.mean @ tilt) ** 2 / x_spread if x_spread > 1e-9 else y_spread  # what a straight line over time explains
        reach = orders.span @ weight / total
        moved = before >= 0
        values = {
            "smooth": np.sqrt(np.maximum(y_spread - slope_part, 0) / total), "tight": reach,
            "base": reach + orders.travel(before[moved], mask[moved], w[moved]) / total, "spread": np.sqrt(np.maximum(y_spread, 0) / total),
        }
        return [f(values[m]) for m in SPREADS for f in (np.mean, np.std, np.min, np.max, lambda v: np.mean(v < v[0] - 1e-9))]

    def run(batches):
        orders = LaneOrders(keys)
        for pdf in batches:
            got = [(item, measure(orders, p)) for item, p in zip(pdf["item"], pdf["pairs"])]
            yield pd.DataFrame([(i, *map(float, v)) for i, v in got if v is not None], columns=["item", *names])

    return per_item.mapInPandas(run, "item long, " + ", ".join(f"{c} double" for c in names))


def mean_lanes(notes: DataFrame, keys: int = 7, hot=None) -> DataFrame:
    """(item, perm, mean_lane): weighted mean lane of every item under every order of the key lanes."""
    import numpy as np
    import pandas as pd

    h = positions(notes, hot).groupBy("item", "mask").agg(F.sum("w").alias("w"))
    per_item = h.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("mask", "w"))).alias("masks"))

    def run(batches):
        orders = LaneOrders(keys)
        for pdf in batches:
            for item, masks in zip(pdf["item"], pdf["masks"]):
                mask, w = np.array([m["mask"] for m in masks]), np.array([m["w"] for m in masks])
                if w.sum() > 0:
                    yield pd.DataFrame({"item": item, "perm": orders.names, "mean_lane": orders.mean @ orders.by_mask(mask, w)[0] / w.sum()})

    return per_item.mapInPandas(run, "item long, perm string, mean_lane double")


def windows(notes: DataFrame, size: int, hot=None) -> DataFrame:
    """Consecutive windows of ``size`` events; the incomplete tail is dropped."""
    rk = skew.prefix(notes, ["item"], SEQ, {"_rk": ("rank",)}, hot)
    n = notes.groupBy("item").agg(F.count(F.lit(1)).alias("_cnt"))
    w = rk.join(n, "item").withColumn("win", F.floor((F.col("_rk") - 1) / size)).withColumn("pos", ((F.col("_rk") - 1) % size).cast("int"))
    return w.filter((F.col("win") + 1) * size <= F.col("_cnt")).drop("_rk", "_cnt")


def window_delta(win: DataFrame) -> DataFrame:
    """log1p of the gap (seconds) to the previous event of the window, 0 at its start."""
    prev = F.lag("tick").over(W.partitionBy("item", "win").orderBy("pos"))  # a window is a fixed number of rows
    return win.withColumn("gap", F.coalesce(F.col("tick") - prev, F.lit(0)))


def timepoints(notes: DataFrame, hot=None) -> DataFrame:
    """One row per timestamp: gap to the previous one, lane presence mask, held-note flag."""
    p = notes.groupBy("item", "tick").agg(F.bit_or(bit(F.col("lane"))).alias("mask"), F.max("type").alias("has_ln"))
    q = skew.prefix(p, ["item"], ["tick"], {"_pt": ("prev", F.col("tick"))}, hot_for(hot, p, ["item"], "tick"))
    return q.withColumn("gap", F.coalesce(F.col("tick") - F.col("_pt"), F.lit(0))).drop("_pt")


def shuffle_lanes(notes: DataFrame, keys: list[str], seed: str, hot=None) -> DataFrame:
    """Permute lanes inside ``keys``: the i-th note takes the lane of the i-th note by draw; lane counts stay."""
    a = skew.prefix(notes, keys, ORDER, {"_i": ("rank",)}, hot_for(hot, notes, keys, "tick"))
    d = notes.select(*keys, "event_id", "lane", draw_long(seed, F.col("event_id")).alias("_u"))
    b = skew.prefix(d, keys, ["_u", "event_id"], {"_i": ("rank",)}, hot_for(hot, d, keys, "_u")).select(*keys, "_i", F.col("lane").alias("new_lane"))
    return a.join(b, [*keys, "_i"]).drop("_i")


def pool_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean vector per key as (key, dim, value); dimensions aggregate independently, map-side first."""
    x = df.select(key, F.posexplode(vec).alias("dim", "_v"))
    return x.groupBy(key, "dim").agg(F.avg("_v").alias("value"))


def vector_drift(a, b):
    """(cosine, l2) columns between two vector columns."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    l2 = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return F.try_divide(dot, na * nb), l2
