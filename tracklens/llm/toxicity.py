"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``fit_rows``, outside the held-out fold) tells which words and word beginnings are
   far more frequent in toxic texts; with a fixed list of insults they make the lexicon.
2. Many voters look at a text: each part of the lexicon, counts and densities of its words, shouting, and the absence of any
   lexicon word.  A voter says toxic, clean or nothing.
3. A generative label model gives each text of the sample a posterior.  For each class it holds a tree of voters: every
   voter's accuracy given one other voter, the one with which it is most correlated, so correlated voters aren't counted
   twice.  Parameters and tree come from expectation maximisation without labels.
4. A linear classifier over lexicon words is trained on the posteriors and scores every text.

Only the text enters a score.  Null and empty texts have the score of a text without lexicon words.  Repeated rows
score alike.  Without labelled rows the fixed list alone decides.  The whole text counts, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_schema, stage, word_hashes, words_of

# Insults that need no context.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile bastard bitch asshole dumbass retard scumbag vermin crap shit fuck fucking idiota imbécil estúpido connard salope idiote arschloch dummkopf idiotisch"
PREFIXES = (4, 5, 6, 8)
PARTS = 16  # parts of the mined lexicon, one voter each
MOST_FEATURES = 3000
TOXIC, CLEAN = 1, 2


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


class Lookup:
    """Finds the positions of hashes in a sorted list; a bit table turns most of them away first."""

    BITS = 20

    def __init__(self, features: np.ndarray):
        self.features = features
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(features & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, words with any feature by document); each (document, feature) once."""
        n = len(words.rows)
        docs, feats, any_hit = [], [], np.zeros(len(words.hashes), bool)
        if len(words.hashes) and len(self.features):
            for h in [words.hashes, *words.prefixes]:
                at = np.flatnonzero(self.table[(h & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.features, h[at]), len(self.features) - 1)
                at, k = at[self.features[k] == h[at]], k[self.features[k] == h[at]]
                any_hit[at] = True
                docs.append(np.searchsorted(words.first, at, "right") - 1)
                feats.append(k)
        hits = np.bincount(np.searchsorted(words.first, np.flatnonzero(any_hit), "right") - 1, minlength=n)[:n]
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), hits
        pair = np.unique(np.concatenate(docs) * len(self.features) + np.concatenate(feats))
        return pair // len(self.features), pair % len(self.features), hits


def seed_features() -> np.ndarray:
    return np.unique(np.concatenate([word_hashes(w.encode(), plain=True) for w in INSULTS.split()]))


def mine(sample: DataFrame, least_docs: int, most: int) -> np.ndarray:
    """Words and word beginnings whose share of toxic texts is far above the average."""
    ddl = "feature long, n_toxic long, n_all long"
    schema = arrow_schema(sample, ddl)

    def run(batches):
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for words in words_of(batch.column(0), True, 1_000_000, PREFIXES):
                size = np.diff(words.first)
                doc = np.repeat(np.arange(len(size)), size)
                parts = []
                for h in [words.hashes, *words.prefixes]:
                    order = np.lexsort((doc, h))
                    h, d = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    parts.append((h[new], toxic[np.array(words.rows)[d[new]]]))
                h, y = (np.concatenate(x) for x in zip(*parts))
                f, at = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(np.bincount(at, y, len(f)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(f)).astype(np.int64))], schema=schema)

    whole = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not whole.t or whole.t == whole.n:
        return np.zeros(0, np.uint64)
    rate = whole.t / whole.n
    counts = sample.select("text", "toxic").mapInArrow(run, ddl).groupBy("feature").agg(F.sum("n_toxic").alias("t"), F.sum("n_all").alias("n"))
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    picked = counts.filter((F.col("t") >= least_docs) & (F.col("t") >= F.lit(0.5 + 0.5 * rate) * F.col("n")) & (z >= 4)).orderBy(z.desc(), "feature").limit(most).select("feature").collect()
    candidates = np.sort(np.array([r.feature for r in picked], np.int64).view(np.uint64))
    return cover(sample.filter("toxic = 1"), candidates, max(least_docs, whole.t // 200))


def cover(toxic: DataFrame, candidates: np.ndarray, least_gain: int) -> np.ndarray:
    """The candidates that a greedy set cover of the toxic texts takes: a word that is frequent only because one toxic text
    has many copies adds nothing once the words that make those texts toxic are in."""
    def run(batches):
        look = Lookup(candidates)
        for batch in batches:
            for words in words_of(batch.column(0), True, 1_000_000, PREFIXES):
                d, f, _ = look.find(words)
                cut = np.searchsorted(d, np.arange(len(words.rows) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["feats"])

    if not len(candidates):
        return candidates
    each = [np.frombuffer(r.feats, np.int32) for r in toxic.select("text").mapInArrow(run, "feats binary").collect()]  # bounded by fit_rows
    docs, feats = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate(each) if each else np.zeros(0, np.int32)
    order = np.argsort(feats, kind="stable")
    inside = np.split(docs[order], np.searchsorted(feats[order], np.arange(1, len(candidates))))
    open_, taken = np.ones(len(each), bool), []
    gain = np.array([len(x) for x in inside])
    while True:
        k = int(gain.argmax())
        fresh = int(open_[inside[k]].sum())
        if fresh < gain[k]:
            gain[k] = fresh  # gains only shrink, so a stale one is refreshed when it comes up
            continue
        if fresh < least_gain:
            return candidates[np.sort(np.array(taken, int))]
        taken.append(k)
        open_[inside[k]] = False
        gain[k] = 0


def votes(words: Words, seeds: Lookup, mined: Lookup) -> np.ndarray:
    """Votes of all voters on the documents of ``words``: 0 nothing, 1 toxic, 2 clean."""
    n = len(words.rows)
    size = np.maximum(1, np.diff(words.first))
    sd, sf, s_hits = seeds.find(words)
    md, mf, m_hits = mined.find(words)
    cols = [np.where(s_hits > 0, TOXIC, 0), np.where(s_hits > 1, TOXIC, 0), np.where(s_hits > 0.01 * size, TOXIC, 0)]
    part = (mined.features[mf] % np.uint64(PARTS)).astype(np.int64) if len(mf) else mf
    for p in range(PARTS):
        cols.append(np.where(np.bincount(md[part == p], minlength=n)[:n] > 0, TOXIC, 0))
    cols += [np.where(m_hits > 1, TOXIC, 0), np.where(m_hits > 0.005 * size, TOXIC, 0)]
    none = (s_hits == 0) & (m_hits == 0)
    cols += [np.where(none, CLEAN, 0), np.where(none & (size >= 100), CLEAN, 0), np.where((m_hits + s_hits) < 0.001 * size, CLEAN, 0)]
    if len(words.starts):
        loud = np.zeros(len(words.hashes))
        ends = words.data[np.maximum(words.ends - 1, 0)]
        loud[:] = ends == ord("!")
        shout = np.bincount(np.searchsorted(words.first, np.arange(len(loud)), "right") - 1, loud, n)[:n]
    else:
        shout = np.zeros(n)
    cols.append(np.where(shout > 0.3 * size, TOXIC, 0))
    return np.stack(cols, 1).astype(np.int8)


def label_model(v: np.ndarray, rounds: int = 30) -> np.ndarray:
    """P(toxic) of each row of votes, by expectation maximisation over two trees of voters (one structure, two classes)."""
    n, m = v.shape
    rows, at, count = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    one = np.eye(3)[rows]  # pattern, voter, value
    toxic, clean = (rows == TOXIC).sum(1), (rows == CLEAN).sum(1)
    p = np.where(toxic > clean, 0.9, 0.05)
    parent = np.full(m, -1)
    for step in range(rounds):
        log = np.zeros((len(rows), 2))
        for y, w in ((0, (1 - p) * count), (1, p * count)):
            log[:, y] = np.log(w.sum() + 1) - np.log(n + 2)
            for j in range(m):
                if parent[j] < 0:
                    table = (w[:, None] * one[:, j]).sum(0) + 0.1
                    log[:, y] += np.log(table / table.sum())[rows[:, j]]
                else:
                    table = np.einsum("r,ra,rb->ab", w, one[:, parent[j]], one[:, j]) + 0.1
                    table /= table.sum(1, keepdims=True)
                    log[:, y] += np.log(table)[rows[:, parent[j]], rows[:, j]]
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))
        if step == rounds // 3:
            parent = voter_tree(one, p, count)
    return p[at.reshape(-1)]


def voter_tree(one: np.ndarray, p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each voter's parent in the maximum spanning tree of correlations that the class does not explain (conditional mutual information)."""
    m = one.shape[1]
    gain = np.zeros((m, m))
    for w in ((1 - p) * count, p * count):
        joint = np.einsum("r,rja,rkb->jkab", w, one, one) + 1e-9
        share = w.sum() / count.sum()
        joint /= joint.sum((2, 3), keepdims=True)
        a, b = joint.sum(3, keepdims=True), joint.sum(2, keepdims=True)
        gain += share * (joint * np.log(joint / (a * b))).sum((2, 3))
    parent, inside = np.full(m, -1), [0]
    while len(inside) < m:
        left = [j for j in range(m) if j not in inside]
        best = max(((gain[i, j], i, j) for i in inside for j in left), key=lambda x: x[0])
        parent[best[2]] = best[1]
        inside.append(best[2])
    return parent


def fit_linear(docs: np.ndarray, feats: np.ndarray, y: np.ndarray, size: int, steps: int = 400, shrink: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors; (docs, feats) are the active features."""
    n = len(y)
    w, b = np.zeros(size), 0.0
    m1, m2, g = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(docs, w[feats], n) + b
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g[:size], g[size] = np.bincount(feats, e[docs], size) / n + shrink * w / max(1, n) * 100, e.mean()
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        move = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w -= move[:size]
        b -= move[size]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 20_000, least_docs: int = 5) -> Model:
    """``fit_rows`` bounds the labelled rows that the model sees; they are drawn by a hash of the key outside the held-out fold.

    Of rows that share a key the sample takes one, that with the smallest text hash; of labels that share a key the largest counts.
    Labels without key or value are not used.
    """
    seeds = seed_features()
    k = F.col(f"`{key}`")
    chosen = (
        labels.select(k.alias("_k"), F.col(f"`{label}`").cast("int").alias("toxic")).filter(f"_k is not null and toxic is not null and crc32(cast(_k as string)) % 5 != 0")
        .groupBy("_k").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_k"), "_k").limit(fit_rows)
    )
    chosen = stage(chosen, "toxic-chosen")  # at most fit_rows rows
    own = docs.select(k.alias("_k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "_k")
    sample = own.groupBy("_k", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")  # one row a key
    sample = stage(sample, "toxic-sample")
    mined = mine(sample, least_docs, MOST_FEATURES)
    features = np.unique(np.concatenate([seeds, mined]))
    ddl = "votes binary, feats binary"
    schema = arrow_schema(sample, ddl)

    def run(batches):
        s, m, f = Lookup(seeds), Lookup(mined), Lookup(features)
        for batch in batches:
            for words in words_of(batch.column(0), True, 1_000_000, PREFIXES):
                v = votes(words, s, m)
                d, x, _ = f.find(words)
                cut = np.searchsorted(d, np.arange(len(v) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in v], pa.binary()), pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], schema=schema)

    rows = sample.select("text").mapInArrow(run, ddl).toPandas()  # bounded by fit_rows
    if not len(rows):
        return Model(features, np.full(len(features), 4.0), -2.0)
    v = np.stack([np.frombuffer(x, np.int8) for x in rows.votes])
    y = label_model(v)
    each = [np.frombuffer(x, np.int32) for x in rows.feats]
    d = np.repeat(np.arange(len(each)), [len(x) for x in each])
    w, b = fit_linear(d, np.concatenate(each).astype(np.int64), y, len(features))
    unseen = np.isin(features, seeds) & (np.bincount(np.concatenate(each), minlength=len(features)) == 0)
    w[unseen] = max(1.0, -b)  # listed insults that the sample doesn't hold
    return Model(features, w, b)


def toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out (the fold that no label of which was used), score and predicted."""
    kind = dict(docs.dtypes)[key]
    ddl = f"`{key}` {kind}, score double"
    schema = arrow_schema(docs, ddl)

    def run(batches):
        look = Lookup(model.features)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for words in words_of(batch.column(1), True, 600_000, PREFIXES):
                d, f, _ = look.find(words)
                z = np.bincount(d, model.weights[f], len(words.rows)) + model.bias
                score[words.rows.start : words.rows.stop] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=schema)

    scored = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, ddl)
    k = F.col(f"`{key}`")
    held = F.coalesce(F.crc32(k.cast("string")) % 5 == 0, F.lit(False))
    return scored.select(k, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
