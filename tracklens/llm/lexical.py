"""Ranked lexical search with deduplicated bags.

Terms are the maximal runs of letters and digits of ASCII and of all other characters beyond it, only A-Z lower-cased.  N is the number of
documents with a term, L the number of all terms, n those of one document, df the documents that hold a term, tf its occurrences
in one.  With w = floor(1000 ln((2N + 2) / (2df + 1))) and m = 100 - 25 + 25 n N div L, a document scores the sum of
w * (1000000000 tf div (1000 tf + 12 m)) over an item's terms, repeats included; everything but w is 64-bit integer arithmetic.

1. Documents are restricted to the items' vocabulary: each becomes n and its vector of (term, tf).
2. Documents with the same vector and the same m score alike for every item.  They are hashed into classes, and the whole vectors
   are compared, not only their hashes.  Tasks gather the classes of their own rows first, so a class leaves a task as one row, with the
   smallest keys of its members: no item can use more than ``top`` of them.
3. Each class is scored once, against the postings of the items.  Tasks keep the best ``top`` documents of every item, where a
   class stands for its members by ascending key, and the best of these are ranked over all tasks.

Items are read in blocks of at most ``BLOCK`` bytes, each a pass over the documents; only one block is on the driver at a time.
Every row of the items is an item of its own, also where ids repeat; an item without terms, or that no document matches, has no rows.
Null texts have no terms.  Rows without a key rank behind all others of their score (as does the largest possible key, which is
returned as null); repeated rows rank one behind the other.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, running_totals, stage, unstage

TOP = 20
BLOCK = 16 << 20  # bytes of item texts in one block; an item counts 800 more
CELLS = 2_000_000  # scores that a task holds at a time
HELD = 64 << 20  # bytes of vectors that a task gathers into classes at a time
LAST = (1 << 63) - 1
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def vectors(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, n, vec): terms of the whole text, and its sorted (number of the term << 32 | tf) as bytes."""
    ddl = "key long, n long, vec binary"
    slim = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("key"), F.col(f"`{text}`").cast("binary").alias("body"))
    schema = arrow_schema(slim, ddl)

    def run(batches):
        known = vocabulary.get
        for batch in batches:
            n, vec = [], []
            for body in batch.column(1):
                found = TERM.findall((body.as_py() or b"").lower())
                n.append(len(found))
                held = Counter(map(known, found))
                held.pop(None, None)
                vec.append(np.sort(np.fromiter((t << 32 | c for t, c in held.items()), np.int64, len(held))).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(vec, pa.binary())], schema=schema)

    return slim.mapInArrow(run, ddl)


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """df of every term of the vocabulary (terms 1 to ``size``)."""
    ddl = "term int, n long"
    schema = arrow_schema(rows, ddl)

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for vec in batch.column(0):
                total[np.frombuffer(vec.as_py(), np.int64) >> 32] += 1  # a term stands once in a vector
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    out = np.zeros(size + 1, np.int64)
    for r in rows.select("vec").mapInArrow(run, ddl).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the block
        out[r.term] = r.n
    return out


def classes(rows: DataFrame, top: int) -> DataFrame:
    """(m, vec, keys): every distinct vector and m, with the smallest ``top`` keys of its members.  ``rows``: key, m, vec."""
    ddl = "m long, vec binary, keys array<long>"
    schema = arrow_schema(rows, ddl)

    def flushed(held: dict) -> pa.RecordBatch:
        keys = [sorted(k)[:top] for k in held.values()]
        return pa.RecordBatch.from_arrays([pa.array([m for m, _ in held], pa.int64()), pa.array([v for _, v in held], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        held: dict[tuple[int, bytes], list[int]] = {}
        size = 0
        for batch in batches:
            for key, m, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = held.get((m, vec))
                if own is None:
                    own = held[m, vec] = []
                    size += len(vec) + 300
                own.append(key)
                if len(own) > 4 * top + 64:
                    own[:] = sorted(own)[:top]
            if size > HELD:
                yield flushed(held)
                held, size = {}, 0
        yield flushed(held)

    own = rows.select("key", "m", "vec").mapInArrow(run, ddl).withColumn("h", F.xxhash64("vec", "m"))
    whole = own.groupBy("h", "m", "vec").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    return whole.select("m", "vec", F.slice(F.array_sort("keys"), 1, top).alias("keys"))


class Best:
    """The best ``top`` (score, key) of every item; larger scores first, then smaller keys."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.item, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        item, score, key = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        new = np.append(True, item[1:] != item[:-1]) if len(item) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        full = place == self.top - 1
        self.least[item[full]] = score[full]  # equal scores may still win by their keys
        kept = place < self.top
        self.item, self.score, self.key = item[kept], score[kept], key[kept]


def scored(found: DataFrame, weights: np.ndarray, first: np.ndarray, items: np.ndarray, repeats: np.ndarray, n_items: int, top: int) -> DataFrame:
    """(item, key, score): each task's best documents of every item.

    Term t has the postings first[t] to first[t + 1]: ``items`` that hold it, and how often.
    """
    ddl = "item int, key long, score long"
    schema = arrow_schema(found, ddl)

    def run(batches):
        best = Best(n_items, top)
        step = max(1, CELLS // max(1, n_items))
        for batch in batches:
            for s in range(0, len(batch), step):
                part = batch.slice(s, step)
                vec = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                size = np.array([len(x) for x in vec])
                both = np.concatenate(vec)
                term, tf = both >> 32, both & 0xFFFFFFFF
                m = np.repeat(part.column(0).to_numpy(zero_copy_only=False), size)
                points = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
                n = first[term + 1] - first[term]
                at = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())  # postings of each (class, term)
                cell = np.repeat(np.repeat(np.arange(len(part)), size) * n_items, n) + items[at]
                score = np.zeros(len(part) * n_items, np.int64)
                np.add.at(score, cell, np.repeat(points, n) * repeats[at])
                score = score.reshape(len(part), n_items)
                row, item = np.nonzero(score >= best.least)
                if not len(row):
                    continue
                lists = part.column(2)
                keys, ends = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)))
                n = ends[row + 1] - ends[row]
                at = np.repeat(ends[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                best.add(np.repeat(item, n), np.repeat(score[row, item], n), keys[at])
        yield pa.RecordBatch.from_arrays([pa.array(best.item.astype(np.int32)), pa.array(best.key), pa.array(best.score)], schema=schema)

    return found.mapInArrow(run, ddl)


def blocks(items: DataFrame, item: str, text: str) -> Iterator[list]:
    """(item id, text) of all rows of the items, in blocks of bounded size."""
    slim = items.select(F.col(f"`{item}`").alias("item"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("body"))
    sized = running_totals(slim.withColumn("size", (F.octet_length("body") + 800).cast("long")), ["item", "body"], {"before": F.col("size")}, "items")
    numbered = stage(sized.select("item", "body", F.floor(F.col("before") / BLOCK).alias("block")), "items")
    last = numbered.agg(F.max("block")).first()[0]
    for b in range(-1 if last is None else last + 1):
        if rows := numbered.filter(F.col("block") == b).select("item", "body").collect():  # BLOCK bytes and one item at most
            yield rows
    unstage(numbered)


def ranked_block(docs: DataFrame, rows: list, key: str, text: str, top: int, kind) -> DataFrame:
    """(item_id, rank, key, score, item) for the items of one block; staged."""
    bags = [Counter(TERM.findall(bytes(r.body).lower())) for r in rows]
    vocabulary = {t: i + 1 for i, t in enumerate(sorted(set().union(*bags)))}
    pairs = sorted((vocabulary[t], q, c) for q, bag in enumerate(bags) for t, c in bag.items())
    term, items, repeats = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [], [])))
    first = np.searchsorted(term, np.arange(len(vocabulary) + 2))
    held = stage(vectors(docs, key, text, vocabulary), "vectors")
    total = held.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = document_counts(held.filter(F.octet_length("vec") > 0), len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    m = F.expr(f"75L + (25L * n * {total.n}L) div {max(total.l, 1)}L")
    found = classes(held.filter(F.octet_length("vec") > 0).select("key", m.alias("m"), "vec"), top)
    best = scored(found, weights, first, items, repeats, len(rows), top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))
    ids = docs.sparkSession.createDataFrame([(q, r.item) for q, r in enumerate(rows)], f"item int, item_id {kind}")
    out = best.withColumn("rank", rank).filter(F.col("rank") <= top).join(F.broadcast(ids), "item")  # ids: a row an item of the block
    done = stage(out.select("item_id", "rank", F.when(F.col("key") < LAST, F.col("key")).alias("key"), "score"), "ranked")
    unstage(held)
    return done


def ranked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, key, score): the ``top`` best documents of each item with a score above 0, equal scores by ascending key."""
    kind = items.schema[item].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, key long, score long")
    for rows in blocks(items, item, item_text):
        out = out.union(ranked_block(docs, rows, key, text, top, kind))
    return out.select(F.col("item_id").alias(item), "rank", F.col("key").alias(key), "score")
