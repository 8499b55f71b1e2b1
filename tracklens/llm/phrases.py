"""Collocations: frequent phrases by multikey three-way quicksort of suffix pointers, scored by their weakest cut.

Texts are lower-cased (A-Z only) and split into pieces at ``[.,;:!?`` and line ends ``]``; words of a piece are runs without space and tab.  A phrase
is a run of words of one piece; everything is counted for each language.

1. Tasks write chunks: the words of some texts of one language as numbers of a list of the chunk's own words.
2. Word counts are summed over all chunks.  Words below the least count are in no candidate: they become breaks.
3. For each depth d from 2 on, suffix pointers of d words are gathered in each chunk (equal ones as one pointer with a weight) and routed by
   their leading words, all d of them: equal suffixes meet in one task, and no word or pair, however common, is more than one pointer a
   chunk.  A task sorts its pointers by multikey three-way quicksort down to depth d; the sizes of the partitions of equal pointers are the
   counts, and partitions below the least count are abandoned on the way.
4. Each chunk hears which of its pointers were abandoned.  Only suffixes whose runs of d - 1 words were all kept go one deeper.

With f the counts, a candidate of count a and words w1..wd has for each cut the value floor(1000000 a a / (l r)), l and r being the counts of both
parts, in decimals of 38 digits; the lowest value counts.  A candidate is dropped where a longer one contains it and has at least half its count.

Null texts are empty, null languages are ``und``.  Repeated rows count each time.  An empty table gives an empty result; so does a table without
phrases of the least count.  A text is never cut: a chunk holds at least one whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, mix, stage, tasks_for, unstage

LEAST, WORDS, TOP = 10, 3, 2000
CHUNK = 8 << 20  # bytes of text in a chunk
HELD = 4 * CHUNK  # bytes of text that a task holds before it writes its chunks
SORTED = 4_000_000  # words of the corpus for each sorting task
TOKEN = re.compile(rb"[^ \n]+|\n+")
PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    """Numbers of words by first appearance, from 1 on; breaks are 0."""

    def __missing__(self, word: bytes) -> int:
        if word[0] == 10:
            self[word] = 0
            return 0
        self.n = getattr(self, "n", 0) + 1
        self[word] = self.n
        return self.n


def chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(chunk, lang, ids, words, counts): numbers of the words in order as int32 bytes, 0 for breaks."""
    ddl = "chunk long, lang string, ids binary, words array<binary>, counts array<long>"
    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("body")).filter(F.octet_length("body") > 0)
    schema = arrow_schema(slim, ddl)

    def written(number: int, lang: str, bodies: list[bytes]) -> pa.RecordBatch:
        numbers = Numbers()
        tokens = TOKEN.findall(b"\n".join(bodies).translate(PLAIN))
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        words = [w for w, i in numbers.items() if i]
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([ids.tobytes()], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                held.setdefault(own, []).append(body)
                size[own] = size.get(own, 0) + len(body) + 200
                full = [own] if size[own] > CHUNK else sorted(held) if sum(size.values()) > HELD else []
                for x in full:
                    yield written(number, x, held.pop(x))
                    size.pop(x)
                    number += 1
        for x in sorted(held):
            yield written(number, x, held[x])
            number += 1

    return slim.mapInArrow(run, ddl)


def numbered_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, gids, seq): numbers of the chunk's frequent words (sorted), and its words as places in them from 1 on, 0 for breaks.  ``rows``: chunk, ids, at, gid (arrays)."""
    ddl = "chunk long, gids binary, seq binary"
    schema = arrow_schema(rows, ddl)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids = np.frombuffer(batch.column(1)[i].as_py(), np.int32)
                at, gid = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                order = np.argsort(gid)
                to = np.zeros(max(int(ids.max(initial=0)), int(at.max(initial=0))) + 1, np.int32)
                to[at[order]] = np.arange(1, len(order) + 1)
                seq = to[ids]
                seq = seq[(seq > 0) | np.append(True, seq[:-1] > 0)]  # one break for several
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([gid[order].tobytes()], pa.binary()), pa.array([seq.tobytes()], pa.binary())], schema=schema)

    return rows.select("chunk", "ids", "at", "gid").mapInArrow(run, ddl)


class Grams:
    """The distinct runs of ``depth`` words of a chunk, with their counts and routes; ``place`` has the number of the run at each word, -1 for none."""

    def __init__(self, seq: np.ndarray, gids: np.ndarray, routes: int, last: "Grams | None" = None, kept: np.ndarray | None = None):
        """``last``: the runs of one word less, and which of them were ``kept``."""
        self.seq, self.gids = seq, gids
        if last is None:
            before, self.depth = np.where(seq > 0, seq - 1, -1).astype(np.int64), 2
            heads = np.arange(len(gids))[:, None]
        else:
            before, self.depth = np.where((last.place >= 0) & kept[last.place], last.place, -1), last.depth + 1
            heads = last.runs
        d = self.depth
        n = max(0, len(seq) - d + 1)
        # both runs of d - 1 words, that from the first and that from the second word, have to be there
        ok = np.flatnonzero((before[:n] >= 0) & (before[1 : n + 1] >= 0)) if last is not None else np.flatnonzero((seq[:n] > 0) & (seq[1 : n + 1] > 0))
        key = before[ok] * (len(gids) + 1) + seq[ok + d - 1]
        key, number, self.count = np.unique(key, return_inverse=True, return_counts=True)
        self.place = np.full(len(seq), -1, np.int64)
        self.place[ok] = number.reshape(-1)
        self.runs = np.concatenate([heads[key // (len(gids) + 1)], (key % (len(gids) + 1) - 1)[:, None]], axis=1).astype(np.int64)
        h = np.zeros(len(key), np.uint64)
        for k in range(d):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + gids[self.runs[:, k]].astype(np.uint64) + np.uint64(k + 1))
        self.route = (h % np.uint64(routes)).astype(np.int64)

    def by_route(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, routes, starts): runs in the order of their routes, and where each route starts."""
        order = np.argsort(self.route, kind="stable")
        routes, starts = np.unique(self.route[order], return_index=True)
        return order, routes, np.append(starts, len(order))


def deepest(seq: bytes, gids: bytes, routes: int, heard: list[tuple[int, int, bytes]], depth: int) -> Grams:
    """The runs of ``depth`` words of a chunk, after what it has heard of shorter ones: (depth, route, bits)."""
    seq, gids = np.frombuffer(seq, np.int32), np.frombuffer(gids, np.int64)
    now = Grams(seq, gids, routes)
    while now.depth < depth:
        told = {r: bits for d, r, bits in heard if d == now.depth}
        order, own, starts = now.by_route()
        kept = np.zeros(len(order) + 1, bool)  # the last place is for words without a run
        for r, a, b in zip(own.tolist(), starts[:-1], starts[1:]):
            if r in told:
                kept[order[a:b]] = np.unpackbits(np.frombuffer(told[r], np.uint8), count=b - a).astype(bool)
        now = Grams(seq, gids, routes, now, kept)
    return now


def routed(rows: DataFrame, depth: int, routes: int) -> DataFrame:
    """(route, chunk, grams, counts): the chunk's runs for a route, word by word as int64 bytes.  ``rows``: chunk, gids, seq, heard."""
    ddl = "route int, chunk long, grams binary, counts binary"
    schema = arrow_schema(rows, ddl)

    def run(batches):
        for batch in batches:
            for chunk, gids, seq, heard in zip(*(c.to_pylist() for c in batch.columns)):
                found = deepest(seq, gids, routes, [(x["depth"], x["route"], x["bits"]) for x in heard or []], depth)
                order, own, starts = found.by_route()
                if not len(order):
                    continue
                words = found.gids[found.runs[order]]
                counts = found.count[order]
                parts = [(words[a:b].T.tobytes(), counts[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([chunk] * len(own), pa.int64()), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], schema=schema)

    return rows.select("chunk", "gids", "seq", "heard").mapInArrow(run, ddl)


def three_way(symbols: np.ndarray, weight: np.ndarray, least: int) -> np.ndarray:
    """Multikey three-way quicksort of pointers; symbols[k] has their k-th symbols.  For each pointer the weight of all pointers
    that are equal in all symbols, 0 where that is below ``least``.

    All open partitions are split at once, each around the median of three of its symbols at its own depth: smaller and larger
    symbols stay at the depth, equal ones go one deeper.  Partitions below ``least`` are abandoned.
    """
    depth, n = symbols.shape
    out = np.zeros(n, np.int64)
    if not n or weight.sum() < least:
        return out
    flat = symbols.reshape(-1)
    pointers, size, level = np.arange(n), np.array([n]), np.array([0])
    while len(size):
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        s = flat[level[part] * n + pointers]
        a, b, c = s[start], s[start + size // 2], s[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = np.sign(np.subtract(s > pivot, s < pivot, dtype=np.int8)).astype(np.int8)
        nexts = []
        for which in (-1, 0, 1):
            at = np.flatnonzero(side == which)
            p, owner = pointers[at], part[at]
            total = np.zeros(len(size), np.int64)
            np.add.at(total, owner, weight[p])
            ok = total >= least
            if which == 0:
                done = ok & (level == depth - 1)
                ended = done[owner]
                out[p[ended]] = total[owner[ended]]
                ok &= ~done
            kept = ok[owner]
            members = np.bincount(owner[kept], minlength=len(size))[ok]
            nexts.append((p[kept], members, level[ok] + (which == 0)))
        pointers, size, level = (np.concatenate(x) for x in zip(*nexts))
    return out


def counted(dealt: DataFrame, depth: int, least: int) -> DataFrame:
    """Of every route, sorted in one task: (g, f) of the runs that are kept, and (chunk, route, bits) for each chunk that sent some."""
    ddl = "g array<long>, f long, chunk long, route int, bits binary"
    schema = arrow_schema(dealt, ddl)

    def run(batches):
        route, chunk, grams, weights = [], [], [], []
        for batch in batches:
            route += batch.column(0).to_pylist()
            chunk += batch.column(1).to_pylist()
            grams += [np.frombuffer(x, np.int64).reshape(depth, -1) for x in batch.column(2).to_pylist()]
            weights += [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        if not route:
            return
        ends = np.cumsum([len(w) for w in weights])
        symbols, weight = np.concatenate(grams, axis=1), np.concatenate(weights)
        f = three_way(symbols, weight, least)
        bits = [np.packbits(x > 0).tobytes() for x in np.split(f, ends[:-1])]
        none = [None] * len(route)
        yield to_rows(none, none, chunk, route, bits)
        at = np.flatnonzero(f)
        if not len(at):
            return
        found = symbols[:, at]
        order = np.lexsort(found[::-1])
        found, f = found[:, order], f[at][order]
        new = np.append(True, (found[:, 1:] != found[:, :-1]).any(axis=0))
        found, f = np.ascontiguousarray(found[:, new].T), f[new]
        for s in range(0, len(f), 100_000):
            own = found[s : s + 100_000]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * depth), pa.array(own.reshape(-1)))
            none = [None] * len(own)
            yield to_rows(lists, f[s : s + 100_000], none, none, none)

    def to_rows(g, f, chunk, route, bits) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip((g, f, chunk, route, bits), schema)], schema=schema)

    return dealt.mapInArrow(run, ddl)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): (lang, word, f, gid) of frequent words, (lang, n), and (g, f) of all frequent runs of 1 to ``most`` words as arrays of gids."""
    own = stage(chunks(docs, text, lang), "phrase-chunks")
    each = own.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", "lang", (F.col("at") + 1).alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    sums = stage(each.groupBy("lang", "word").agg(F.sum("c").alias("f")), "phrase-words")
    totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stage(sums.filter(F.col("f") >= least).withColumn("gid", F.monotonically_increasing_id()), "phrase-words")
    maps = each.join(words.select("lang", "word", "gid"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "gid")).alias("m"))
    rows = own.select("chunk", "ids").join(maps, "chunk").select("chunk", "ids", F.col("m.at").alias("at"), F.col("m.gid").alias("gid"))
    held = stage(numbered_chunks(rows), "phrase-chunks")
    unstage(own)
    size = words.agg(F.sum("f")).first()[0] or 0
    routes = int(max(tasks_for(docs), -(-size // SORTED)))
    phrases = words.select(F.array("gid").alias("g"), "f")
    heard = None
    for depth in range(2, most + 1):
        told = held.withColumn("heard", F.lit(None).cast("array<struct<depth:int,route:int,bits:binary>>")) if heard is None else held.join(heard.groupBy("chunk").agg(F.collect_list(F.struct("depth", "route", "bits")).alias("heard")), "chunk")
        dealt = routed(told, depth, routes).repartitionById(routes, F.col("route"))
        out = stage(counted(dealt, depth, least), "phrase-counts")
        phrases = phrases.union(out.filter("g is not null").select("g", "f"))
        bits = out.filter("bits is not null").select("chunk", F.lit(depth).alias("depth"), "route", "bits")
        heard = bits if heard is None else heard.union(bits)
    return words, totals, phrases


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of 2 to ``most`` words of each language."""
    words, totals, phrases = phrase_counts(docs, text, lang, most, least)
    phrases = stage(phrases, "phrases")
    found = phrases.filter(F.size("g") > 1).withColumnRenamed("f", "a")
    cuts = found.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k")).select("*", F.expr("slice(g, 1, k)").alias("gl"), F.expr("slice(g, k + 1, size(g) - k)").alias("gr"))
    cuts = cuts.join(phrases.select(F.col("g").alias("gl"), F.col("f").alias("l")), "gl").join(phrases.select(F.col("g").alias("gr"), F.col("f").alias("r")), "gr")
    value = F.expr("(1000000 * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scores = cuts.withColumn("score", value).groupBy("g", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("g", "a", "c.score", "c.l", "c.r")
    # the largest count of a longer candidate that contains a phrase
    inner = found.filter(F.size("g") > 2).select("a", F.explode(F.expr("flatten(transform(sequence(2, size(g) - 1), n -> transform(sequence(1, size(g) - n + 1), i -> slice(g, i, n))))")).alias("g"))
    covered = inner.groupBy("g").agg(F.max("a").alias("longer"))
    left = scores.join(covered, "g", "left").filter("longer is null or 100 * longer < 50 * a")
    langs = words.select(F.col("gid").alias("g0"), "lang")
    placed = left.withColumn("g0", F.col("g")[0]).join(langs, "g0")
    first = placed.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top).drop("place")
    first = stage(first.select("lang", "g", "a", "l", "r", "score"), "phrase-ranks")  # all that tie with the last one, too
    spelt = first.select("lang", "g", F.posexplode("g").alias("i", "gid")).join(words.select("gid", "word"), "gid").groupBy("lang", "g").agg(F.array_sort(F.collect_list(F.struct("i", F.col("word").cast("string").alias("word")))).alias("w"))
    named = first.join(spelt, ["lang", "g"]).select("lang", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", "l", "r", "score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
