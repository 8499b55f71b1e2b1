"""Helpers of the operators: staged tables in the shared folder, words, Arrow batches, ordered running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 9 to 13, as in ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps are column-pruned, re-read files
    instead of recomputing Python work, and survive lost executors.  The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of a staged table's files; nothing is read."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29)))
    return mix(out)


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def map_rows(df: DataFrame, ddl: str, start: Callable[[], Callable[..., Iterable[tuple]]], rows: int = 2000) -> DataFrame:
    """``mapInArrow`` for a function that yields output tuples for one row.

    ``start`` is called once a task and returns the function; it gets the row's values (strings as UTF-8 bytes,
    null strings as None).  Output goes out in batches of ``rows``.
    """
    schema = arrow_schema(df, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out = start(), []
        for batch in batches:
            columns = [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c) for c in batch.columns]
            for row in zip(*columns):
                out.extend(one(*[x.as_py() for x in row]))
                if len(out) >= rows:
                    yield to_batch(out, schema)
                    out = []
        if out:
            yield to_batch(out, schema)

    return df.mapInArrow(run, ddl)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def tasks_for(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_totals(df: DataFrame, order: list[str], sums: dict[str, Column], name: str = "ordered") -> DataFrame:
    """Adds, for each of ``sums``, the total over all rows that come earlier in the order of the whole table.

    The rows are dealt by range over *all* order columns, so ties on the first of them are split too; each part is
    scanned on its own and a table with one row for each part carries the totals over.  ``order`` should tell all
    rows apart; rows that it cannot tell apart are interchangeable only if they are equal in every column.
    """
    n = tasks_for(df)
    parts = stage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    whole = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in sums])
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_l_{k}") for k, c in sums.items()])
    return local.join(F.broadcast(carry), "_part").select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_c_{k}")).alias(k) for k in sums])


# ---- word hashes of whole batches

_Z = np.random.default_rng(20240229).integers(0, 2**64, (32, 256), np.uint64, endpoint=False).reshape(-1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DROP = np.zeros(256, bool)  # ASCII punctuation
_DROP[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
CHUNK_BYTES = 3_000_000


class Words:
    """The words of some documents: hashes, byte ranges, and the documents' first words."""

    __slots__ = ("hashes", "starts", "ends", "first", "data", "rows", "prefixes")

    def __init__(self, data: np.ndarray, splits: np.ndarray, rows: range, plain: bool, prefixes: tuple[int, ...] = ()):
        """``splits``: byte offsets of the documents; ``plain``: without case and ASCII punctuation; ``prefixes``: also hashes of the words' first so many bytes."""
        self.data, self.rows, self.prefixes = data, rows, [np.zeros(0, np.uint64) for _ in prefixes]
        space = _SPACE[data]
        begin = ~space
        begin[1:] &= space[:-1]
        firsts = splits[:-1][splits[:-1] < len(data)]
        begin[firsts] = ~space[firsts]
        self.starts = np.flatnonzero(begin)
        if not len(self.starts):
            self.hashes, self.ends = np.zeros(0, np.uint64), self.starts
            self.first = np.zeros(len(splits), np.int64)
            return
        word = np.cumsum(begin, dtype=np.int32) - 1
        np.maximum(word, 0, out=word)
        used = data
        if plain:
            used = _LOWER[data]
            after = np.zeros(len(data), bool)
            after[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            used = used + (after * np.uint8(0x20))
            skipped = np.cumsum(_DROP[data] | space, dtype=np.int32)
            at = np.arange(len(data), dtype=np.int32) - skipped
            position = at - (at[self.starts] + _DROP[data[self.starts]])[word]
        else:
            position = np.arange(len(data), dtype=np.int32) - self.starts.astype(np.int32)[word]
        value = _Z[(position & 31) * 256 + used]
        far = np.flatnonzero(position > 31)  # bytes beyond the table's places: mixed with the number of their 32 bytes
        value[far] = mix(value[far] + (position[far] >> 5).astype(np.uint64) * _ODD[0])
        value[space | _DROP[data] if plain else space] = 0
        total = np.add.reduceat(value, self.starts)
        # a word ends at the next separator or at the end of its document
        stop = np.append(self.starts[1:], len(data))
        spaces = np.add.reduceat(space.view(np.int8).astype(np.int32), self.starts)
        self.ends = stop - spaces
        if plain:
            kept = np.add.reduceat((~(space | _DROP[data])).view(np.int8).astype(np.int32), self.starts)
            raw = mix(total + (self.ends - self.starts).astype(np.uint64))
            self.hashes = np.where(kept > 0, mix(total ^ kept.astype(np.uint64)), raw)
        else:
            self.hashes = mix(total ^ (self.ends - self.starts).astype(np.uint64))
        self.prefixes = [mix(np.add.reduceat(np.where(position < k, value, np.uint64(0)), self.starts) + np.uint64(k)) for k in prefixes]
        self.first = np.searchsorted(self.starts, splits)

    def of(self, k: int) -> np.ndarray:
        """Hashes of the words of the k-th document."""
        return self.hashes[self.first[k] : self.first[k + 1]]

    def part(self, a: int, b: int) -> "Words":
        """Documents a to b of this run."""
        out = Words.__new__(Words)
        i, j = self.first[a], self.first[b]
        out.hashes, out.starts, out.ends, out.prefixes = self.hashes[i:j], self.starts[i:j], self.ends[i:j], [p[i:j] for p in self.prefixes]
        out.first, out.data, out.rows = self.first[a : b + 1] - i, self.data, self.rows[a:b]
        return out

    def bytes_of(self, k: int) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[self.first[k] : self.first[k + 1]], self.ends[self.first[k] : self.first[k + 1]])]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def words_of(column: pa.Array, plain: bool = False, size: int = CHUNK_BYTES, prefixes: tuple[int, ...] = ()) -> Iterator[Words]:
    """The words of a string column, in runs of whole documents of about ``size`` bytes."""
    if not len(column):
        return
    data, at = column_bytes(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield Words(data[at[first] : at[last]], at[first : last + 1] - at[first], range(first, last), plain, prefixes)
        first = last


def word_hashes(text: bytes, plain: bool = False) -> np.ndarray:
    return Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), range(1), plain).hashes
