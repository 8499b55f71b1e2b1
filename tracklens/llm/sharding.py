"""Minimax contiguous partition of rows into shards.

Rows with equal text form one atomic group; groups stand in the order of their smallest key.  The smallest capacity for
which a greedy scan needs no more than ``shards`` shards is found by binary search, so no contiguous partition has a smaller
largest shard.  A greedy scan with that capacity would fill the first shards and leave the last ones empty where one group is larger
than a fair share; so of all cuts within that capacity those are made that leave the smallest shard as large as can be.

The scan never sees all groups on the driver.  Groups get running totals on Spark; a group's end is its running total
with itself.  A greedy step asks for the last end at or below a bound.  From a histogram of the ends (one row a bucket: smallest
and largest end) that question has a lower and an upper answer, hence every capacity is surely feasible, surely
infeasible or open.  Where some stay open, only the buckets on which the scans depend get a finer histogram, until no
answer is open.  Each histogram has about ``BUCKETS`` rows, whatever the input.  The even cuts are among the ends
that the histograms name.

Null text counts as empty.  A shard stays empty only when there are fewer groups than shards.  Rows that are equal in
all columns are told apart by nothing but their slot.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, running_totals, stage

BUCKETS = 8192


def greedy(last_end, total: int, capacity: int, shards: int) -> list[int] | None:
    """Cuts of a greedy scan, or None where it needs more shards; ``last_end(x)`` is the last end at or below x."""
    cuts, at = [], 0
    for _ in range(shards):
        if at >= total:
            break
        end = last_end(min(total, at + capacity))
        if end <= at:
            return None
        cuts.append(at := end)
    return cuts if at >= total else None


class Ends:
    """What is known of the ends: buckets [smallest, largest] that hold some, in order."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high

    def at_least(self, x: int) -> int:
        """An end that exists and is at most x: a lower answer."""
        k = int(np.searchsorted(self.low, x, "right")) - 1
        if k < 0:
            return 0
        return int(self.high[k]) if self.high[k] <= x else int(self.low[k])

    def at_most(self, x: int) -> int:
        """No end at most x is larger than this: an upper answer."""
        k = int(np.searchsorted(self.low, x, "right")) - 1
        return 0 if k < 0 else min(int(self.high[k]), x)


def least(total: int, low: int, high: int, ok) -> int:
    """Smallest value in (low, high] for which ``ok`` holds; it holds for high."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts among ``ends`` (ascending, the last is the total) that make no shard larger than ``capacity`` and the smallest one as large
    as that allows; of several such cuts those closest to even shares.  Some cuts within the capacity must exist."""
    at = np.concatenate([[0], ends]).astype(np.int64)
    n = min(shards, len(ends))
    first = np.searchsorted(at, at - capacity, "left")

    def reached(floor: int) -> list[np.ndarray]:
        """[j]: the places that j shards of floor to capacity can end at."""
        last = np.searchsorted(at, at - floor, "right")
        out = [at == 0]
        for _ in range(n):
            before = np.concatenate([[0], np.cumsum(out[-1])])
            out.append(before[np.maximum(last, first)] > before[first])
        return out

    low, high = 1, int(at[-1]) // n + 1  # every shard can hold something; none can hold more than a share
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if reached(mid)[n][-1] else (low, mid)
    places, k, cuts = reached(low), len(at) - 1, []
    for j in range(n, 0, -1):
        cuts.append(int(at[k]))
        from_, to = first[k], np.searchsorted(at, at[k] - low, "right")
        open_ = from_ + np.flatnonzero(places[j - 1][from_:to])
        k = int(open_[np.abs(at[open_] - at[k] * (j - 1) / j).argmin()])
    return cuts[::-1]


def histogram(groups: DataFrame, end: str, edges: np.ndarray, wanted: np.ndarray) -> list:
    """(smallest, largest) end in each wanted interval (edges[k], edges[k + 1]] that holds one; one row for each."""
    ddl = "b int, lo long, hi long"
    schema = arrow_schema(groups, ddl)

    def run(batches):
        for batch in batches:
            x = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
            k = np.searchsorted(edges, x, "left") - 1
            ok = (k >= 0) & (k < len(wanted))
            ok[ok] = wanted[k[ok]]
            x, k = x[ok], k[ok]
            if len(x):
                at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(k[at].astype(np.int32)), pa.array(x[at]), pa.array(x[np.append(at[1:], len(x)) - 1])], schema=schema)

    found = groups.select(F.col(end).cast("long")).mapInArrow(run, ddl)
    return found.groupBy("b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()


def minimax_cuts(groups: DataFrame, end: str, shards: int, buckets: int = BUCKETS, probes: int = 16) -> tuple[int, list[int]]:
    """(capacity, cuts): the smallest capacity and the ends at which shards of about equal size within it are cut.

    ``groups`` has one row a group with its end (running total with itself, all different and above 0).  Each round
    searches with what is known; where it stays open, greedy scans of ``probes`` capacities of the open interval tell which
    buckets they depend on, and only these get a finer histogram.
    """
    total = groups.agg(F.max(end)).first()[0]
    if not total:
        return 0, []
    total = int(total)
    edges = np.unique(np.linspace(0, total, buckets + 1).astype(np.int64))
    known = Ends(np.zeros(0, np.int64), np.zeros(0, np.int64))
    wanted, replaced = np.ones(len(edges) - 1, bool), np.zeros(0, bool)
    while True:
        rows = histogram(groups, end, edges, wanted)
        lo = np.concatenate([known.low[~replaced], np.array([r.lo for r in rows], np.int64)])
        hi = np.concatenate([known.high[~replaced], np.array([r.hi for r in rows], np.int64)])
        order = np.argsort(lo)
        known = Ends(lo[order], hi[order])
        floor = -(-total // shards)
        sure = least(total, floor - 1, total, lambda c: greedy(known.at_least, total, c, shards) is not None)
        open_from = least(total, floor - 1, sure, lambda c: greedy(known.at_most, total, c, shards) is not None)
        tried = {open_from, sure, *np.linspace(open_from, sure, probes).astype(np.int64).tolist()}
        touched = np.zeros(len(known.low), bool)
        for c in tried:
            for answer in (known.at_least, known.at_most):
                at = 0
                for _ in range(shards):
                    x = min(total, at + c)
                    k = int(np.searchsorted(known.low, x, "right")) - 1
                    if k >= 0 and known.low[k] < known.high[k] and x < known.high[k]:
                        touched[k] = True  # the answer depends on ends inside this bucket
                    at = max(at, answer(x))
        if not touched.any():
            return sure, even_cuts(np.unique(np.concatenate([known.low, known.high])), sure, shards)
        replaced, each = touched, max(2, buckets // int(touched.sum()))
        parts, want = [], []
        for a, b in zip(known.low[touched] - 1, known.high[touched]):
            inner = np.unique(np.linspace(a, b, each + 1).astype(np.int64))
            parts.append(inner)
            want += [True] * (len(inner) - 1) + [False]  # the gap to the next bucket is of no interest
        edges, wanted = np.concatenate(parts), np.array(want[:-1])


def minimax_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Per row: key, size (UTF-8 bytes + 1), text_crc32, shard and slot (gapless inside the shard, in group order)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body, 256).alias("_text"))
    rows = stage(rows.withColumn("_text", F.unhex(F.substring("_text", 1, 32))), "shard-rows")
    groups = rows.groupBy("_text").agg(F.min("_key").alias("_first"), F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    ordered = stage(running_totals(groups, ["_first", "_text"], {"_before": F.col("_bytes"), "_rank": F.col("_rows")}, "shard-order").withColumn("_end", F.col("_before") + F.col("_bytes")), "shard-ends")
    capacity, cuts = minimax_cuts(ordered.select("_end"), "_end", shards)
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + F.when(F.col("_end") > c, 1).otherwise(0)
    placed = ordered.withColumn("shard", shard.cast("int"))
    starts = placed.groupBy("shard").agg(F.min("_rank").alias("_start"))  # one row a shard
    placed = placed.join(F.broadcast(starts), "shard").select("_text", "shard", (F.col("_rank") - F.col("_start")).alias("_slot"), "_rows")
    # Rows of a group follow each other.  Most groups have one row; the rest are numbered over the whole table,
    # dealt by range of (group, key), so a group of any size spreads over many tasks.
    single = rows.join(placed.filter("_rows = 1"), "_text").select("_key", "size", "text_crc32", "shard", F.col("_slot").alias("slot"))
    many = placed.filter("_rows > 1")
    copies = running_totals(rows.join(many.select("_text", "shard", "_slot"), "_text"), ["shard", "_slot", "_key"], {"_n": F.lit(1)}, "shard-copies")
    base = copies.groupBy("shard", "_slot").agg(F.min("_n").alias("_n0"))
    copies = copies.join(base, ["shard", "_slot"]).select("_key", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_n") - F.col("_n0")).alias("slot"))
    return single.union(copies).select(F.col("_key").alias(key), "size", "text_crc32", "shard", "slot")
