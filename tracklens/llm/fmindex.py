"""Substring deduplication with a compressed FM-index for each shard.

A window is 13 consecutive words of one document.  A word goes when a window over it also starts in a document with a
smaller key.  Shards are made so that equal windows always meet in one shard:

1. Every window has an anchor, the smallest hash among its five-word runs; equal windows have equal anchors, and neighbouring
   windows mostly share one.  Anchors that only one text has cannot repeat and end here.
2. Runs of windows with the same surviving anchor go to the shard of that anchor as a passage.  For an anchor with very many texts
   (``HOT``) each window goes by its own hash, so no shard gets all passages of a common line.
3. Equal passages collapse to one with the smallest key.  Each shard builds an FM-index over its passages: suffixes sorted
   by their first 16 words, the Burrows-Wheeler transform in a wavelet matrix of packed bits with rank samples.  All passages are
   streamed against it by backward search, right to left; after each step the match is cut back to 13 words, which are the matching
   statistics at the threshold.  Each interval gives the smallest key of any document where the window starts.
4. Passages with an interval of a smaller key go back to their documents, which drop the covered words.

Texts that are equal collapse first: the one with the smallest key is judged, its copies with larger keys lose all words that are in any window.
Null and empty texts have no words.  Rows without a key come after all others; rows with the same key do not remove
each other's words.  Texts of fewer than 13 words lose nothing as they have no window.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_schema, shingles, stage, tasks_for, unstage, words_of

WINDOW = 13
GRAM = 5
HOT = 50_000
LAST = (1 << 63) - 1


class WaveletMatrix:
    """Ranks of symbols in a sequence; one bit vector for each bit of a symbol, with a count every 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n, self.levels = len(symbols), max(1, int(size - 1).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            b = ((s >> level) & 1).astype(bool)
            packed = np.packbits(b, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int32)])[:-1].astype(np.int32))
            self.zeros.append(int(self.n - b.sum()))
            s = np.concatenate([s[~b], s[b]])
        self.base = self.follow(np.arange(size), np.zeros(size, np.int64))

    def follow(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        for k in range(self.levels):
            w = i >> 6
            ones = self.before[k][w] + np.bitwise_count(self.bits[k][w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i."""
        return self.follow(c, i) - self.base[c]


class FMIndex:
    """Index of passages (runs of word hashes), each with a label; answers for windows of ``width`` words.

    Symbol 0 ends a passage.  Suffixes are sorted by their first 16 symbols, enough for patterns of up to 16.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, labels: np.ndarray, width: int = WINDOW):
        assert width <= 15
        size = np.diff(first)
        self.width, self.starts = width, first[:-1] + np.arange(len(size))
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        n = len(hashes) + len(size)
        text = np.zeros(n, np.int64)
        owner = np.repeat(np.arange(len(size)), size + 1)
        inside = np.ones(n, bool)
        inside[first[1:] + np.arange(len(size))] = False
        text[inside] = ids.reshape(-1) + 1
        self.text, self.sizes = text, size
        rank, by_length = text, {1: text}
        for k in (1, 2, 4, 8):
            shifted = np.zeros(n, np.int64)
            shifted[: n - k] = rank[k:] + 1
            rank = np.unique(rank * (n + 2) + shifted, return_inverse=True)[1].reshape(-1)
            by_length[2 * k] = rank
        order = np.argsort(rank, kind="stable")
        self.symbols = len(self.vocabulary) + 1
        self.bwt = WaveletMatrix(text[order - 1], self.symbols)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        # classes of suffixes that agree in ``width`` symbols: neighbours in the order
        new = np.zeros(n, bool)
        new[:1] = True
        at = 0
        for k in (8, 4, 2, 1):
            if width & k:
                moved = np.zeros(n, np.int64)
                moved[: n - at] = by_length[k][at:] + 1
                m = moved[order]
                new[1:] |= m[1:] != m[:-1]
                at += k
        self.class_start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(labels[owner[order]], starts)
        self.class_least = least[np.cumsum(new) - 1]

    def extend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Backward search: one bound of the interval of a pattern with ``c`` put before it."""
        return self.count[c] + self.bwt.rank(c, i)

    def least_labels(self) -> tuple[np.ndarray, np.ndarray]:
        """(label, first): for every window of every passage, the smallest label in its interval; passage k has
        labels first[k]:first[k+1], in order.

        Passages are searched from their ends, all at once.  They are part of the index, so no interval is empty.
        """
        windows = np.maximum(0, self.sizes - self.width + 1)
        first = np.concatenate([[0], np.cumsum(windows)])
        out = np.empty(first[-1], np.int64)
        lanes = np.flatnonzero(windows)
        lanes = lanes[np.argsort(-windows[lanes], kind="stable")]  # long ones first, so the running lanes are a prefix
        if not len(lanes):
            return out, first
        end = self.starts[lanes] + self.sizes[lanes]
        lo, hi = np.zeros(len(lanes), np.int64), np.full(len(lanes), len(self.text), np.int64)
        for k in range(1, self.width + 1):
            c = self.text[end - k]
            lo, hi = self.extend(c, lo), self.extend(c, hi)
        assert (hi > lo).all()
        out[first[lanes] + windows[lanes] - 1] = self.class_least[lo]
        active = len(lanes)
        for k in range(1, int(windows.max())):
            while active and windows[lanes[active - 1]] <= k:
                active -= 1
            lo = lo[:active]
            c = self.text[end[:active] - self.width - k]
            lo = self.class_start[self.extend(c, lo)]  # a match of width + 1 words, cut back to width
            out[first[lanes[:active]] + windows[lanes[:active]] - 1 - k] = self.class_least[lo]
        return out, first


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash of each window, its place) for the words of one document or several laid end to end."""
    g = shingles(h, GRAM)
    span = WINDOW - GRAM + 1
    n = len(g) - span + 1
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, span):
        less = g[k : k + n] < best
        best[less] = g[k : k + n][less]
        at[less] = k
    return best, at + np.arange(n)


def whole_windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of all windows that lie in one document."""
    size = np.diff(words.first)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :]) if len(doc) >= WINDOW else np.zeros(0, np.int64)
    return (doc[at] if len(at) else at), at


def document_anchors(rows: DataFrame) -> DataFrame:
    """(u, anchors): the distinct anchors of each text."""
    ddl = "u long, anchors array<long>"
    schema = arrow_schema(rows, ddl)

    def run(batches):
        for batch in batches:
            for words in words_of(batch.column(1), size=1_000_000):
                doc, at = whole_windows(words)
                n = len(words.rows)
                if not len(at):
                    continue
                key = anchors(words.hashes)[0][at]
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[new], doc[new]
                cut = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.rows.start, n), pa.ListArray.from_arrays(pa.array(cut), pa.array(key.view(np.int64)))], schema=schema)

    return rows.select("u", "text").mapInArrow(run, ddl)


def passages(rows: DataFrame) -> DataFrame:
    """(u, k, start, shard, passage) of runs of windows whose anchor is among the text's shared ones.

    ``rows`` has u, k, text, shared (anchors) and hot (those of them with very many texts).
    """
    ddl = "u long, k long, start int, shard long, passage string"
    schema = arrow_schema(rows, ddl)

    def run(batches):
        for batch in batches:
            u, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for words in words_of(batch.column(2), size=1_000_000):
                doc, at = whole_windows(words)
                if not len(at):
                    continue
                key, place = (x[at] for x in anchors(words.hashes))
                keep, hot = np.zeros(len(at), bool), np.zeros(len(at), bool)
                cut = np.searchsorted(doc, np.arange(len(words.rows) + 1))
                for d, row in enumerate(words.rows):
                    own = slice(cut[d], cut[d + 1])
                    for mask, column in ((keep, 3), (hot, 4)):
                        some = batch.column(column)[row].values
                        if some is not None and len(some):
                            mask[own] = np.isin(key[own], some.to_numpy(zero_copy_only=False).view(np.uint64))
                at, doc, key, place, hot = at[keep], doc[keep], key[keep], place[keep], hot[keep]
                if not len(at):
                    continue
                key = np.where(hot, shingles(words.hashes, WINDOW)[at], key)
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | hot[1:]
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                a, b = words.starts[at[first]], words.ends[at[last] + WINDOW - 1]
                size = b - a
                total = np.concatenate([[0], np.cumsum(size)])
                body = words.data[np.arange(total[-1]) + np.repeat(a - total[:-1], size)]
                text = pa.Array.from_buffers(pa.large_string(), len(a), [None, pa.py_buffer(total.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.string())
                row = words.rows.start + doc[first]
                yield pa.RecordBatch.from_arrays([pa.array(u[row]), pa.array(k[row]), pa.array((at[first] - words.first[doc[first]]).astype(np.int32)), pa.array(key[first].view(np.int64)), text], schema=schema)

    return rows.select("u", "k", "text", "shared", "hot").mapInArrow(run, ddl)


def smallest_keys(distinct: DataFrame) -> DataFrame:
    """(c, least): for every distinct passage that a smaller key reaches, the smallest key at each of its windows.

    One task is one shard: its passages are read, indexed and streamed against the index.
    """
    ddl = "c long, n int, least array<long>"
    schema = arrow_schema(distinct, ddl)

    def run(batches):
        ids, sizes, low, high, hashes, count = [], [], [], [], [], []
        for batch in batches:
            for words in words_of(batch.column(2)):
                part = batch.slice(words.rows.start, len(words.rows))
                for to, column in ((ids, 0), (sizes, 1), (low, 3), (high, 4)):
                    to.append(part.column(column).to_numpy(zero_copy_only=False))
                hashes.append(words.hashes)
                count.append(np.diff(words.first))
        if not ids:
            return
        ids, sizes, low, high, hashes, count = (np.concatenate(x) for x in (ids, sizes, low, high, hashes, count))
        index = FMIndex(hashes, np.concatenate([[0], np.cumsum(count)]), low)
        least, first = index.least_labels()
        for s in range(0, len(ids), 20_000):
            e = min(len(ids), s + 20_000)
            own = least[first[s] : first[e]]
            below = np.minimum.reduceat(own, first[s:e] - first[s]) < high[s:e]
            at = np.flatnonzero(below)
            size = np.diff(first[s : e + 1])[at]
            take = np.repeat(first[s:e][at] - first[s], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][at]), pa.array(sizes[s:e][at]), pa.ListArray.from_arrays(pa.array(cut), pa.array(own[take]))], schema=schema)

    return distinct.mapInArrow(run, ddl)


def kept_words(rows: DataFrame, with_text: bool) -> DataFrame:
    """Counts, digest and (if wanted) text of what is left.  ``rows``: key, text, copy, spans (first and one past the last word)."""
    kind = dict(rows.dtypes)["key"]
    ddl = f"key {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    schema = arrow_schema(rows, ddl)

    def run(batches):
        for batch in batches:
            copies, spans = batch.column(2).to_pylist(), batch.column(3)
            for words in words_of(batch.column(1)):
                n, gone, digest, texts = [], [], [], []
                for d, row in enumerate(words.rows):
                    own = words.bytes_of(d)
                    n.append(len(own))
                    if copies[row]:
                        left = [] if len(own) >= WINDOW else own
                    elif (s := spans[row].values) is not None and len(s):
                        s = s.to_numpy(zero_copy_only=False)
                        step = np.zeros(len(own) + 1, np.int64)
                        np.add.at(step, s & 0xFFFFFFFF, 1)
                        np.add.at(step, s >> 32, -1)
                        left = [w for w, c in zip(own, np.cumsum(step)) if c == 0]
                    else:
                        left = own
                    gone.append(len(own) - len(left))
                    body = b" ".join(left)
                    digest.append(hashlib.sha256(body).hexdigest())
                    texts.append(body.decode("utf-8", "replace"))
                columns = [batch.column(0).slice(words.rows.start, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), schema=schema)

    return rows.select("key", "text", "copy", "spans").mapInArrow(run, ddl)


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` written once as a table bucketed by u in the shared warehouse, so the joins on u move only their small sides.

    The files go when the session ends.
    """
    spark = rows.sparkSession
    name = f"substring_rows_{uuid.uuid4().hex}"
    rows.write.bucketBy(tasks_for(rows), "u").option("compression", "zstd").saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.table(name)


def repeated_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row for each row: key, n_words, n_removed, kept_sha256 (and kept_text)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.col(f"`{key}`")
    rows = docs.select(own.alias("key"), F.coalesce(own.cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(F.sha2(body, 256)).alias("h"), body.alias("text")).withColumn("u", F.xxhash64("k", "h"))
    rows = bucketed(rows)
    copies = rows.groupBy("h").agg(F.min("k").alias("m"))
    first = stage(copies.select(F.xxhash64("m", "h").alias("u")), "first-texts")
    judged = rows.join(first, "u", "left_semi")
    table = stage(document_anchors(judged), "anchors")
    pairs = table.select("u", F.explode("anchors").alias("anchor"))
    shared = pairs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot).alias("is_hot"))
    survivors = pairs.join(shared, "anchor").groupBy("u").agg(F.collect_list("anchor").alias("shared"), F.collect_list(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot"))
    # repeated rows (same u) give the same passages twice; they collapse below
    found = stage(passages(rows.join(survivors, "u")).withColumn("c", F.xxhash64("passage", "shard")).withColumn("n", F.length("passage")), "passages")
    unstage(table)
    distinct = found.groupBy("c", "n", "shard").agg(F.first("passage").alias("passage"), F.min("k").alias("low"), F.max("k").alias("high"))
    shards = distinct.select("c", "n", "passage", "low", "high", "shard").repartition(tasks_for(distinct), "shard").select("c", "n", "passage", "low", "high")
    least = smallest_keys(shards)
    place = F.transform("least", lambda x, i: F.when(x < F.col("k"), F.shiftleft((F.col("start") + i + WINDOW).cast("long"), 32) + F.col("start") + i))
    covered = found.select("u", "k", "start", "c", "n").join(least, ["c", "n"]).select("u", F.explode(F.filter(place, lambda x: x.isNotNull())).alias("span"))
    spans = covered.groupBy("u").agg(F.collect_set("span").alias("spans"))
    out = rows.join(spans, "u", "left").join(first.withColumn("judged", F.lit(True)), "u", "left")
    out = out.select("key", "text", F.col("judged").isNull().alias("copy"), "spans")
    return kept_words(out, with_text).withColumnRenamed("key", key)
