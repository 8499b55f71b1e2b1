"""Benchmark decontamination by the CGK embedding and bit-sampling LSH.

The CGK embedding reads a word sequence with a random walk: at step j it outputs the word under its cursor, and a random
bit that depends on j and that word tells whether the cursor moves on.  Two sequences at a small edit distance fall
into step again after an edit, so their outputs differ in few places: edit distance becomes Hamming distance.  A hash of some
sampled output places is a key of an LSH; several walks with own bits and places are repeated until the target recall.

Items are classed by their size, rounded down to a power of two; windows have that size, but at most ``WIDEST`` words (``w``), so a
long item is looked for by several windows of its own.  Documents give one window every ``w / 2`` words, items give windows at
every offset, so a copied item always meets its own window in step.  The number of walks of a class is found from the
items themselves: windows with random edits are embedded until ``recall`` is reached.  Where ``MOST_WALKS`` do not reach it, the
items of the class are looked for exactly: of ``k + 1`` pieces of an item, ``k`` edits leave one piece as it is.
Every candidate is verified by the exact word edit distance between the item and the part of the document around it; it counts
when the distance is at most ``(1 - similarity)`` of the item's words.

Words are compared without case and outer punctuation.  Null and empty texts and items without words match nothing.  Items with
fewer than ``least_words`` words count only where their words stand in a row without any edit.  Repeated rows are judged one by one, also rows without a key.  The benchmark is the stated
query set: equal items count once; it is read in blocks of bounded size, each against all documents; documents are never shuffled.  Where there are
several blocks, each one's results are written before the next index is built.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, mix, stage, to_batch, unstage, word_hashes, words_of

BLOCK_ITEMS = 20_000  # items of one pass
BLOCK_BYTES = 32 << 20  # and their text
RUN_BYTES = 600_000  # text embedded at once: its arrays stay in the processor's cache
PLACES = 4  # sampled places of a key
WIDEST = 64  # words of a window: the sampled places of a wider one seldom all escape the edits
MOST_WALKS = 24  # a class that needs more is searched exactly
TABLE_BITS = 18


def walk_keys(h: np.ndarray, starts: np.ndarray, seed: int, places: tuple[int, ...]) -> np.ndarray:
    """Keys of the windows at ``starts``; ``h`` is padded by at least the last place + 1 zeros."""
    bits = h * np.uint64(seed)  # the upper half of a product with an odd number is well mixed
    at = starts.astype(np.int32)
    key = np.zeros(len(starts), np.uint64)
    chosen = set(places)
    for j in range(places[-1] + 1):
        if j in chosen:
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[at]
        if j < places[-1]:
            at += ((bits[at] >> np.uint64(63 - j % 32)) & np.uint64(1)).astype(np.int32)
        if j % 32 == 31:
            bits = mix(bits)
    return mix(key)


def run_keys(h: np.ndarray, length: int) -> np.ndarray:
    """Keys of the ``length`` words from each place of ``h`` on."""
    n = max(0, len(h) - length + 1)
    key = np.zeros(n, np.uint64)
    for j in range(length):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(key)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits between the whole item and any part of ``text``, and the end of such a part."""
    m = len(text)
    ramp = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty(m + 1, np.int64)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp  # insertions
    end = int(row.argmin())
    return int(row[end]), end


@dataclass
class SizeClass:
    width: int
    step: int
    walks: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)  # sorted, one array a walk
    where: list[np.ndarray] = field(default_factory=list)  # (item, offset) in that order
    tables: list[np.ndarray] = field(default_factory=list)


class BenchmarkIndex:
    def __init__(self, items: list[tuple[object, bytes]], similarity: float, recall: float, least_words: int, seed: int = 11):
        if similarity <= 0:
            raise ValueError("at similarity 0 every document holds every item")
        self.ids, self.words = [], []
        for i, text in items:
            w = word_hashes(text, plain=True)
            if len(w):
                self.ids.append(i)
                self.words.append(w)
        self.sets = [frozenset(w.tolist()) for w in self.words]
        self.allowed = [int((1 - similarity) * len(w) + 1e-9) if len(w) >= least_words else 0 for w in self.words]
        self.classes = []
        by_size: dict[int, list[int]] = {}
        exactly = []
        for k, w in enumerate(self.words):
            if len(w) < least_words:
                exactly.append(k)
            else:
                by_size.setdefault(1 << (len(w).bit_length() - 1), []).append(k)
        rng = random.Random(seed)
        for size, members in sorted(by_size.items()):
            width = min(size, WIDEST)
            c = SizeClass(width, max(1, width // 2))
            for _ in range(MOST_WALKS):
                reach = max(1, width)
                places = tuple(sorted(rng.sample(range(reach), min(PLACES, reach))))
                c.walks.append((rng.getrandbits(63) | 1, places))
            walks = self._walks_for(c, members, recall, rng)
            if walks is None:
                exactly += members
                continue
            c.walks = c.walks[:walks]
            self._fill(c, members)
            self.classes.append(c)
        self.runs = self._runs(exactly)

    def _runs(self, members: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(words of a piece, sorted keys, (item, offset) in that order): one piece more than an item has edits."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in members:
            length = len(self.words[k]) // (self.allowed[k] + 1)
            keys = run_keys(self.words[k], length)
            found.setdefault(length, []).extend((int(keys[o]), k, o) for o in range(0, length * (self.allowed[k] + 1), length))
        out = []
        for length, rows in sorted(found.items()):
            rows.sort()
            out.append((length, np.array([x for x, *_ in rows], np.uint64), np.array([x for _, *x in rows], np.int64)))
        return out

    def _offsets(self, c: SizeClass, n: int) -> int:
        return n - c.width + c.step  # a window keeps at least width - step words

    def _walks_for(self, c: SizeClass, members: list[int], recall: float, rng: random.Random) -> int | None:
        """Walks until the share ``recall`` of edited items meets a window of its own, on 300 trials; None where all are too few."""
        trials = []
        for _ in range(300):
            k = rng.choice(members)
            w = list(self.words[k])
            for _ in range(self.allowed[k]):
                x, at = rng.randrange(3), rng.randrange(len(w))
                if x == 0:
                    w[at] = rng.getrandbits(62)
                elif x == 1:
                    w.insert(at, rng.getrandbits(62))
                elif len(w) > 1:
                    del w[at]
            trials.append((k, np.array([rng.getrandbits(62) for _ in range(rng.randrange(c.step + 1))] + w, np.uint64)))
        open_ = set(range(len(trials)))
        for r, (seed, places) in enumerate(c.walks, 1):
            for t in list(open_):
                k, text = trials[t]
                own = self._padded(self.words[k], c)
                mine = walk_keys(own, np.arange(self._offsets(c, len(self.words[k]))), seed, places)
                got = walk_keys(self._padded(text, c), np.arange(0, len(text), c.step), seed, places)
                if np.isin(got, mine).any():
                    open_.discard(t)
            if len(open_) <= (1 - recall) * len(trials):
                return r
        return None

    def _padded(self, w: np.ndarray, c: SizeClass) -> np.ndarray:
        return np.concatenate([w, np.zeros(c.width + 1, np.uint64)])

    def _fill(self, c: SizeClass, members: list[int]) -> None:
        for seed, places in c.walks:
            keys, where = [], []
            for k in members:
                n = self._offsets(c, len(self.words[k]))
                keys.append(walk_keys(self._padded(self.words[k], c), np.arange(n), seed, places))
                where.append(np.stack([np.full(n, k), np.arange(n)], 1))
            key = np.concatenate(keys)
            order = np.argsort(key)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(key & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
            c.keys.append(key[order])
            c.where.append(np.concatenate(where)[order])
            c.tables.append(table)

    def matches(self, hashes: np.ndarray, begin: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, word position, distance) of verified matches, the best one for each document and item.

        ``hashes`` holds the words of several documents, ``begin`` where each starts and the last one ends.
        """
        if not self.words or not len(hashes):
            return []
        size = np.diff(begin)
        h = np.concatenate([hashes, np.zeros(max((c.width for c in self.classes), default=0) + 2, np.uint64)])
        local = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        doc = np.repeat(np.arange(len(size)), size)
        found: set[tuple[int, int, int]] = set()  # (item, where it would start, document of the window)
        for c in self.classes:
            starts = np.flatnonzero(local % c.step == 0)
            for (seed, places), keys, where, table in zip(c.walks, c.keys, c.where, c.tables):
                got = walk_keys(h, starts, seed, places)
                hit = np.flatnonzero(table[(got & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
                if not len(hit):
                    continue
                a, b = np.searchsorted(keys, got[hit], "left"), np.searchsorted(keys, got[hit], "right")
                for at, x, y in zip(starts[hit[b > a]], a[b > a], b[b > a]):
                    for k, o in where[x:y]:
                        found.add((int(k), int(at - o), int(doc[at])))
        for length, keys, where in self.runs:
            got = run_keys(hashes, length)
            a = np.searchsorted(keys, got, "left")
            hit = np.flatnonzero(keys[np.minimum(a, len(keys) - 1)] == got)
            hit = hit[doc[hit] == doc[hit + length - 1]]
            for at, x, y in zip(hit, a[hit], np.searchsorted(keys, got[hit], "right")):
                for k, o in where[x:y]:
                    found.add((int(k), int(at - o), int(doc[at])))
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for k, at, d in sorted(found):
            item, slack = self.words[k], self.allowed[k]
            if (d, k) in out and out[d, k][0] == 0:
                continue
            lo, hi = max(begin[d], at - slack), min(begin[d + 1], at + len(item) + slack)
            if hi - lo < len(item) - slack:
                continue
            if len(self.sets[k].intersection(h[lo:hi].tolist())) < len(self.sets[k]) - slack:
                continue  # too few of its words are there
            exact = at >= begin[d] and at + len(item) <= begin[d + 1] and np.array_equal(h[at : at + len(item)], item)
            distance = 0 if exact else edit_distance(item, h[lo:hi])[0] if slack else 1
            if distance <= slack and ((d, k) not in out or distance < out[d, k][0]):
                out[d, k] = (distance, max(0, int(at - begin[d])))
        return [(d, k, at, distance) for (d, k), (distance, at) in sorted(out.items())]


def blocks_of(benchmark: DataFrame, item: str | None, text: str, size: int):
    """(number of blocks, the blocks one after the other): distinct items, about ``size`` and BLOCK_BYTES a block, each read by the driver when its turn comes."""
    own = F.col(f"`{item}`") if item else F.lit(None).cast("string")
    slim = benchmark.select(own.alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("x")).distinct()
    found = slim.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("x")).alias("b")).first()
    n = max(1, -(-found.n // size), -(-(found.b or 0) // BLOCK_BYTES))

    def block(b):
        part = slim if n == 1 else slim.filter(F.pmod(F.xxhash64("i", "x"), F.lit(n)) == b)
        return [(r.i, r.x.encode()) for r in sorted(part.collect(), key=lambda r: (r.i is not None, r.i if r.i is not None else 0, r.x))]

    return n, (block(b) for b in range(n))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.95, least_words: int = 8) -> DataFrame:
    """One row for each document and item in it: key, item, word position, distance in words and the item's words."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | {"_item": dict(benchmark.dtypes)[item]}
    ddl = f"`{key}` {kinds[key]}, `{item}` {kinds['_item']}, word_at long, distance long, item_words long"
    slim = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    schema = arrow_schema(slim, ddl)
    out = None
    n_blocks, blocks = blocks_of(benchmark, item, item_text, BLOCK_ITEMS)
    for items in blocks:
        index = BenchmarkIndex(items, similarity, recall, least_words)

        def run(batches, index=index):
            for batch in batches:
                keys = batch.column(0)
                for words in words_of(batch.column(1), True, RUN_BYTES):
                    rows = [(keys[words.rows[d]].as_py(), index.ids[k], at, distance, len(index.words[k])) for d, k, at, distance in index.matches(words.hashes, words.first)]
                    if rows:
                        yield to_batch(rows, schema)

        part = slim.mapInArrow(run, ddl)
        if n_blocks > 1:
            part = stage(part, "contaminated")  # done with this block's index before the next one is built
        out = part if out is None else out.union(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.95, least_words: int = 8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    out = docs
    at = docs.columns.index(text)
    n_blocks, blocks = blocks_of(benchmark, None, item_text, BLOCK_ITEMS)
    for items in blocks:
        index = BenchmarkIndex(items, similarity, recall, least_words)

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for words in words_of(batch.column(at), True, RUN_BYTES):
                    for d, *_ in index.matches(words.hashes, words.first):
                        keep[words.rows[d]] = False
                yield batch.filter(pa.array(keep))

        before, out = out, out.mapInArrow(run, docs.schema)
        if n_blocks > 1:
            out = stage(out, "decontaminated")
            if before is not docs:
                unstage(before)
    return out
