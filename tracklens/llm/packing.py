"""Packing along a space-filling curve.

Each document's token counts are hashed into a short vector, projected to few dimensions by a fixed random matrix and put
on a grid by the normal distribution's quantiles; its Hilbert key is its place on the curve, so documents with like
words are neighbours.  Tokenised documents are range-partitioned and sorted by that key, and each partition lays its
documents end to end and cuts the stream into sequences.  What is left at the end of a partition is cut at powers of two, which need no padding.

Tokenising happens once, into a table in the shared folder; the range sort reads only the key for its bounds.  Equal keys are told
apart by a hash of the document's key, so copies spread over partitions.  The number of ranges follows from the size of that table, so a task's
sort does not grow with the input.  Memory holds one document and one open sequence.

Null keys are packed like any other; pieces of several rows without a key can be told apart by their place only.  Null texts count as empty: such a document has its end token alone.  Repeated rows are packed one by one.  An empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, stage, stored_bytes, tasks_for, texts, to_batch

SEQUENCE = 2048
END = 1
DIMENSIONS, BITS, BUCKETS = 4, 8, 256
RANGE_BYTES = 64 << 20  # stored ids of one range of the curve


_LETTERS, _NUMBERS = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", "0-9²³¹¼½¾"


class WordIds(dict):
    """Packed ids of the pieces that the tokenizer's pattern makes of a text, remembered up to a fixed number.

    Texts of Latin letters and signs are split by the tokenizer's own pattern, and each new piece goes to its BPE model;
    words with other characters go through the whole tokenizer.  Both give the ids that a word has inside a text.
    """

    LIMIT = 1_000_000
    PLAIN = re.compile(r"[\t-\r -~¡-¬®-ÿ]*")
    PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # texts that may hold one of the tokenizer's added tokens go through it whole
        self.added = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.width = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.packed = [i.tobytes() for i in np.arange(self.whole.get_vocab_size(), dtype=self.width)]
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level models
        rest = [b for b in range(256) if b not in keep]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(rest)}
        # the shortcut holds only for a model of this form; any other takes the whole tokenizer
        probe = "Straße, d'été n°12 can't <b>ÑANDÚ</b> $5.00!!"
        self.plain_model = True
        self.plain_model = np.frombuffer(self.of(probe.encode()), self.width).tolist() == self.whole.encode(probe, add_special_tokens=False).ids
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        value = self[piece] = b"".join([self.packed[t.id] for t in self.model.tokenize(mapped)])
        return value

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.PIECE.findall(text.lower())))

    def of(self, raw: bytes) -> bytes:
        text, low = raw.decode("utf-8", "replace"), raw.lower()
        if not self.plain_model or any(t in low for t in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        if self.PLAIN.fullmatch(text):
            return self.plain(text)
        words = (w.decode("utf-8", "replace") for w in raw.split())
        return b"".join([self.plain(w) if self.PLAIN.fullmatch(w) else np.array(self.whole.encode(w, add_special_tokens=False).ids, self.width).tobytes() for w in words])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker: what a task has learnt serves the next one."""
    return WordIds(path)


def projection(vocabulary: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, BUCKETS, vocabulary), r.choice([-1.0, 1.0], vocabulary), r.normal(size=(BUCKETS, DIMENSIONS))


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid points (rows), as whole numbers."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the cells, from the largest to the smallest
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


_EDGES = np.array([NormalDist().inv_cdf(k / (1 << BITS)) for k in range(1, 1 << BITS)])


def tokenised(docs: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """key, packed ids with the end token, and the Hilbert key of every row."""
    ddl = f"`{key}` {dict(docs.dtypes)[key]}, ids binary, curve long"
    schema = arrow_schema(docs, ddl)

    def run(batches):
        ids = word_ids(path)
        size = ids.whole.get_vocab_size()
        bucket, sign, matrix = projection(size)
        end = np.array([END], ids.width).tobytes()
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                packed = [ids.of(t) + end for t in texts(part.column(1))]
                v = np.empty((len(packed), BUCKETS))
                for k, p in enumerate(packed):
                    a = np.frombuffer(p, ids.width)
                    v[k] = np.bincount(bucket[a], sign[a], BUCKETS)
                v = np.sign(v) * np.sqrt(np.abs(v))
                v /= np.maximum(1e-9, np.sqrt((v * v).sum(1, keepdims=True)))
                grid = np.searchsorted(_EDGES, v @ matrix)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(hilbert(grid))], schema=schema)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, ddl)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids themselves)."""
    from tokenizers import Tokenizer

    width = np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.uint32
    table = stage(tokenised(docs, path, key, text), "packing")
    order = table.withColumn("_tie", F.xxhash64(F.col(f"`{key}`"))).select(F.col(f"`{key}`"), "ids", "curve", "_tie")
    sort = ["curve", "_tie", f"`{key}`"]
    order = order.repartitionByRange(tasks_for(order, -(-stored_bytes(table) // RANGE_BYTES)), *sort).sortWithinPartitions(*sort, "ids").select(F.col(f"`{key}`"), "ids")
    ddl = f"`{key}` {dict(docs.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(docs, ddl)

    def run(batches):
        out, number, filled, waiting = [], TaskContext.get().partitionId() << 32, 0, []

        def row(piece, sequence, offset):
            k, start, a, total = piece
            return (k, start, len(a), zlib.crc32(a.astype("<u4").tobytes()), total, sequence, offset) + ((a.tolist(),) if with_ids else ())

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = np.frombuffer(raw.as_py(), width)
                at = 0
                while at < len(a):
                    take = min(len(a) - at, SEQUENCE - filled)
                    waiting.append((k, at, a[at : at + take], len(a)))
                    filled, at = filled + take, at + take
                    if filled == SEQUENCE:
                        offset = 0
                        for p in waiting:
                            out.append(row(p, number, offset))
                            offset += len(p[2])
                        number, filled, waiting = number + 1, 0, []
                if len(out) >= 5000:
                    yield to_batch(out, schema)
                    out = []
        room = offset = 0
        for k, start, a, total in waiting:  # the rest, at powers of two
            while len(a):
                if not room:
                    room, offset = 1 << (filled.bit_length() - 1), 0
                    filled -= room
                    number += 1
                take = min(room, len(a))
                out.append(row((k, start, a[:take], total), number, offset))
                room, offset, start, a = room - take, offset + take, start + take, a[take:]
        if out:
            yield to_batch(out, schema)

    return order.mapInArrow(run, ddl)
