"""Near duplicates by BagMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles (a shorter text is one shingle).  BagMinHash draws a Poisson process for
every shingle over time and weight: dyadic weight levels [0,1), [1,2), [2,4), ... are processes of their own, and each
point has a weight coordinate, so a point counts for a shingle of weight w only when it lies below w.  Every point falls
into one of the signature's places; a place keeps the earliest point.  Two multisets agree at a place with probability equal
to their weighted Jaccard similarity.  Only points before the time by which all places are surely filled are made: about
``m log m`` of them however long the text; the time is doubled where a place stays empty.

Equal texts collapse first.  Signatures are banded; a bucket (band, key) links all members to one leader
(no pairs inside a bucket).  Linked pairs are verified by exact multiset overlap.  Buckets whose members are then still in different
classes are cut into blocks; a task gets two blocks and compares their members exactly, without rows of pairs: only pairs of different
classes, and each pair only in the first band whose bucket it shares.  It returns the links that join classes, at most one less than
its members.  Classes are connected components, found by pointer jumping on tables.

Null and empty texts hold no shingle: they are never near anything and each has a class of its own, while equal ones collapse
like all other equal texts.  The class id is the smallest key of the class; where one key stands on unrelated texts, their
classes have the same id and are told apart by their root.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_schema, mix, shingles, stage, to_batch, unstage, words_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5  # a pair at 0.8 shares a bucket with probability 1 - (1 - 0.8 ** 5) ** 30 > 0.99999
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def bag(h: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    return np.unique(shingles(h, min(k, len(h))), return_counts=True)


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signature(elements: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
    """BagMinHash signature of one bag: at each place the hash of the earliest point."""
    return signatures(np.zeros(len(elements), np.int64), elements, weights, 1, m)[0]


def signatures(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, m: int, slack: float = 2.0) -> np.ndarray:
    """Signatures of ``n`` bags at once; element i of weight weights[i] belongs to bag doc[i].  Empty bags have zeros."""
    out = np.zeros(n * m, np.uint64)
    if not len(doc):
        return out.reshape(n, m)
    total = np.bincount(doc, weights, n)
    limit = m * (np.log(m) + slack) / np.maximum(total, 1)
    # levels: element i has level 0 for [0,1) and level j for [2^(j-1), 2^j) as far as its weight reaches
    who, level, j = [np.arange(len(doc))], [np.zeros(len(doc), np.int64)], 1
    while (reach := np.flatnonzero(weights > 2 ** (j - 1))).size:
        who.append(reach)
        level.append(np.full(len(reach), j))
        j += 1
    who, level = np.concatenate(who), np.concatenate(level)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    rate = np.where(level == 0, 1.0, low)
    state = mix(elements[who] + level.astype(np.uint64) * _C1)
    at, until = -np.log(unit(state)) / rate, limit[doc[who]]
    places, times, points = [], [], []
    while True:
        ok = at <= until
        who, low, rate, at, until, state = (x[ok] for x in (who, low, rate, at, until, state))
        if not len(who):
            break
        point = mix(state + _C2)
        inside = np.flatnonzero(low + unit(mix(point + _C3)) * rate <= weights[who])
        p = point[inside]
        places.append(doc[who[inside]] * m + ((p >> np.uint64(32)) % np.uint64(m)).astype(np.int64))
        times.append(at[inside])
        points.append(p)
        state = mix(state + _C1)
        at = at - np.log(unit(state)) / rate
    if not places:
        return signatures(doc, elements, weights, n, m, slack * 2 + np.log(m))
    place, time, point = np.concatenate(places), np.concatenate(times), np.concatenate(points)
    best = np.full(n * m, np.inf)
    np.minimum.at(best, place, time)
    won = time == best[place]
    out[place[won]] = point[won]
    out = out.reshape(n, m)
    open_ = np.flatnonzero((total > 0) & ~np.isfinite(best.reshape(n, m)).all(1))
    if len(open_):  # bags with a place that no point has reached: more time
        number = np.full(n, -1)
        number[open_] = np.arange(len(open_))
        own = number[doc] >= 0
        out[open_] = signatures(number[doc[own]], elements[own], weights[own], len(open_), m, slack * 2 + np.log(m))
    return out


def batch_bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) over all documents of a run of words; shingles keep 64 - 14 bits here."""
    size = np.diff(words.first)
    doc = np.repeat(np.arange(len(size)), size)
    parts = [np.zeros(0, np.uint64)]
    h, keep = words.hashes, np.uint64((1 << 50) - 1)
    if len(h) >= SHINGLE:
        d = doc[: len(h) - SHINGLE + 1]
        whole = d == doc[SHINGLE - 1 :]
        parts.append((d[whole].astype(np.uint64) << np.uint64(50)) | (shingles(h, SHINGLE)[whole] & keep))
    for k in np.flatnonzero((size > 0) & (size < SHINGLE)):  # a shorter text is one shingle
        parts.append((np.uint64(k) << np.uint64(50)) | (shingles(words.of(k), int(size[k])) & keep))
    both, count = np.unique(np.concatenate(parts), return_counts=True)
    return (both >> np.uint64(50)).astype(np.int64), both & keep, count


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    n = a[1].sum() + b[1].sum()
    if not n:
        return 0.0
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][x], b[1][y]).sum()
    return both / (n - both)


def band_keys(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, hash of the text, its band keys, none for a text without words, and its number of shingles) of every row."""
    ddl = "key long, h string, keys array<long>, w long"
    m = bands * rows
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.sha2(body, 256).alias("h"), body.alias("text"))
    schema = arrow_schema(slim, ddl)

    def run(batches):
        for batch in batches:
            for words in words_of(batch.column(2)):
                n = len(words.rows)
                keys = np.empty((n, bands), np.uint64)
                for s in range(0, n, 1 << 13):  # as many bags at once as their number has bits in batch_bags
                    part = words.part(s, min(n, s + (1 << 13)))
                    c = len(part.first) - 1
                    sig = signatures(*batch_bags(part), c, m).reshape(c, rows, bands)
                    value = np.tile(np.arange(bands, dtype=np.uint64), (c, 1))
                    for r in range(rows):
                        value = mix(value * _C1 + sig[:, r])
                    keys[s : s + c] = value
                size = np.diff(words.first)
                out = [k if x else None for k, x in zip(keys.view(np.int64), size > 0)]
                at = words.rows.start
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(out, pa.list_(pa.int64())), pa.array(np.maximum(size - SHINGLE + 1, size > 0))], schema=schema)

    return slim.mapInArrow(run, ddl)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with their exact similarity, where it is at least ``least``.

    Pairs meet the text of ``a`` and then of ``b`` in two joins; the texts are only of documents that are in a pair.
    """
    ddl = "a long, b long, similarity double"
    schema = arrow_schema(pairs, ddl)

    def run(batches):
        last, known = None, None
        for batch in batches:
            out = []
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            right = (x for words in words_of(batch.column(3)) for x in (words.of(k) for k in range(len(words.rows))))
            left = batch.column(2)
            for i, hb in enumerate(right):
                if a[i] != last:
                    last = a[i]
                    known = bag(next(iter(words_of(left.slice(i, 1)))).of(0))
                s = overlap(known, bag(hb))
                if s >= least:
                    out.append((a[i], b[i], float(s)))
            yield to_batch(out, schema)

    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b")
    return joined.select("a", "b", "_ta", "_tb").mapInArrow(run, ddl)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of an edge: root is the smallest id of the connected component.

    Large-star and small-star steps: every node links its larger neighbours, then all its smaller ones, to the smallest neighbour.
    Both are aggregations and joins on node ids; the number of rounds grows with the logarithm of the size.  It ends when
    every node but the roots has one link, to a root.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x != y").distinct(), "links")
    while True:
        several = now.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x")
        inner = now.select("x").join(now.select(F.col("y").alias("x")), "x", "left_semi")
        if several.union(inner).isEmpty():
            return now.select(F.col("x").alias("id"), F.col("y").alias("root"))
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").distinct()
        low2 = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low2, "x")
        small = small.select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x != y").union(low2.select("x", F.col("m").alias("y"))).distinct()
        new = stage(small, "links")
        unstage(now)
        now = new


BLOCK = 512  # members of a bucket in one block; a task holds two blocks of one bucket


def overlaps(bags: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 22) -> np.ndarray:
    """Sizes of the multiset intersections of all pairs of bags.

    The j-th occurrence of a shingle is an element of its own, so multisets become sets; those that only one bag has are left out,
    and the others' incidence matrix is multiplied with itself, some columns at a time.
    """
    n = len(bags)
    times = np.concatenate([c for _, c in bags])
    element = np.repeat(np.concatenate([e for e, _ in bags]), times)
    nth = np.arange(len(element)) - np.repeat(np.cumsum(times) - times, times)
    element = np.where(nth > 0, mix(element + nth.astype(np.uint64) * _C2), element)
    owner = np.repeat(np.arange(n), [int(c.sum()) for _, c in bags])
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    column = column.reshape(-1)
    several = count[column] > 1
    owner, column = owner[several], (np.cumsum(count > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, step = np.zeros((n, n)), max(256, cells // max(1, n))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (first, first + step))
        part = np.zeros((n, min(step, int(column[b - 1]) - first + 1)), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def runs_of_groups(batches, n_keys: int):
    """(key, table) of every run of rows with equal values in the first ``n_keys`` columns; rows come sorted by them."""
    last, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.zeros(len(batch), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), np.append(first[1:], len(batch)).tolist()):
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def joining_links(ids: np.ndarray, root: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: np.ndarray) -> list[tuple]:
    """Those of the pairs (places a, b) that join classes: a spanning forest of the roots."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out, left = [], len(np.unique(root[np.concatenate([a, b])])) - 1
    for i, j, s in zip(a.tolist(), b.tolist(), similarity.tolist()):
        if left == 0:
            break
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y:
            up[max(x, y)] = min(x, y)
            left -= 1
            out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j])), s))
    return out


def compared(members: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b, similarity): links between members of one bucket that are in different classes.

    ``members`` has (band, bucket, id, w, root, n), n being the members of the bucket; ``texts`` has (id, keys, text).
    """
    ddl = "a long, b long, similarity double"
    key = ["band", "bucket", "low", "high"]
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = own.select("band", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "w", "root").join(texts, "id")
    rows = rows.select(*key, "own", "id", "w", "root", "keys", "text")
    schema = arrow_schema(rows, ddl)

    def run(batches):
        for (band, _, low, high), table in runs_of_groups(batches, len(key)):
            side, ids, w, root = (table.column(c).to_numpy() for c in ("own", "id", "w", "root"))
            keys = table.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            ok = root[:, None] != root[None, :]
            ok &= (side[:, None] == low) & (side[None, :] == high) if low != high else np.triu(np.ones_like(ok), 1)
            ok &= np.minimum(w[:, None], w[None, :]) >= least * np.maximum(w[:, None], w[None, :]) - 1e-9
            for before in range(band):
                ok &= keys[:, before][:, None] != keys[:, before][None, :]
            a, b = np.nonzero(ok)
            if not len(a):
                continue
            used = np.unique(np.concatenate([a, b]))
            hashes = [words.of(k) for words in words_of(table.column("text").combine_chunks().take(pa.array(used))) for k in range(len(words.rows))]
            bags = [bag(h) for h in hashes]
            i, j = np.searchsorted(used, a), np.searchsorted(used, b)
            if len(a) < 4 * len(used):
                similarity = np.array([overlap(bags[x], bags[y]) for x, y in zip(i.tolist(), j.tolist())])
            else:
                size = np.array([c.sum() for _, c in bags])
                both = overlaps(bags)[i, j]
                similarity = both / (size[i] + size[j] - both)
            found = np.flatnonzero(similarity >= least)
            if len(found):
                yield to_batch(joining_links(ids, root, a[found], b[found], similarity[found]), schema)

    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, ddl)


def near_classes(table: DataFrame, texts_of, least: float = SIMILARITY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links, classes): verified links (a, b, similarity), and (id, root) of linked ids.

    ``table`` has (id, band, bucket, w) of distinct texts, w being the shingles in a text; ``texts_of`` gives (id, keys, text) for a
    table of ids.  A pair whose sizes alone rule the similarity out is never verified.
    """
    bucket = ["band", "bucket"]
    several = table.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(table.join(several, bucket), "buckets")  # members of buckets with two texts or more
    # the leader of a bucket is its member with the most company in all bands: of copies with own changes, that is the text they come from
    company = shared.groupBy("id").agg(F.sum("n").alias("n_all"))
    first = shared.join(company, "id").groupBy(*bucket).agg(F.max(F.struct("n_all", "id", "w")).alias("_a")).select(*bucket, F.col("_a.id").alias("a"), F.col("_a.w").alias("wa"))
    led = shared.join(first, bucket).filter("id != a").filter(F.least("w", "wa") >= least * F.greatest("w", "wa") - 1e-9)
    fresh = stage(led.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "pairs")
    involved = stage(texts_of(shared.select("id").distinct()), "near-texts")
    links = stage(verified(fresh, involved, least), "near-links")
    classes = stage(components(links), "near-classes")
    members = shared.join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = members.groupBy(*bucket).agg(F.min("root").alias("_r"), F.max("root").alias("_s")).filter("_r != _s").select(*bucket)
    more = stage(compared(members.join(mixed, bucket), involved, least, block), "near-links")
    unstage(shared, fresh, involved)
    if more.isEmpty():
        return links, classes
    links = links.union(more)
    return links, stage(components(links), "near-classes")


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): (key, h) of every row, and (h, root, rep, class_id, n_links) of every distinct text.

    ``root`` tells classes apart, ``rep`` is the smallest key of the text, and ``class_id`` that of its class.
    """
    rows = stage(band_keys(docs, key, text), "bands")
    groups = stage(rows.groupBy("h").agg(F.min("key").alias("rep"), F.first("keys").alias("keys"), F.first("w").alias("w")).withColumn("id", F.xxhash64("h")), "texts")
    table = groups.select("id", "w", F.posexplode("keys").alias("band", "bucket"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def texts_of(ids: DataFrame) -> DataFrame:
        """One row's text for each id: the row with the smallest key, so copies of a text do not meet in one task."""
        wanted = groups.join(ids, "id").select("id", "keys", F.coalesce("rep", F.lit(0)).alias("_k"))
        own = docs.select(F.xxhash64(F.sha2(body, 256)).alias("id"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("_k"), body.alias("text"))
        return own.join(wanted, ["id", "_k"]).dropDuplicates(["id"]).select("id", "keys", "text")

    links, classes = near_classes(table, texts_of, least)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    known = groups.select("id", "h", "rep").join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least_key = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    return rows.select("key", "h"), known.join(least_key, "root").join(degree, "id", "left").select("h", "root", "rep", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row for each row: key, class_id (smallest key of its class) and n_links (verified links of its text to other texts)."""
    rows, texts = text_classes(docs, key, text, least)
    return rows.join(texts, "h").select(F.col("key").alias(key), "class_id", "n_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of every class: the one with the smallest key, of several texts with that key the text with the smallest hash.

    A row without a key stays only when no row of its class has one.  A key that stands on texts of several classes stays once for each.
    """
    _, texts = text_classes(docs, key, text, least)
    mark = uuid.uuid4().hex  # names that no column of the table has
    by = [f"_none{mark}", f"_k{mark}", f"_h{mark}"]
    own = texts.select("root", F.col("rep").isNull().alias(by[0]), F.coalesce("rep", F.lit(0)).alias(by[1]), F.col("h").alias(by[2]))
    keep = own.groupBy("root").agg(F.min(F.struct(*by)).alias("_c")).select("_c.*")
    k = F.col(f"`{key}`").cast("long")
    hashed = docs.withColumns({by[0]: k.isNull(), by[1]: F.coalesce(k, F.lit(0)), by[2]: F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)})
    return hashed.join(keep, by, "left_semi").dropDuplicates(by).select(*[F.col(f"`{c}`") for c in docs.columns])
