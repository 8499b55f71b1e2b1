"""Exact duplicates, ranked search and collocations: small tables with every trouble, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tracklens.llm import lexical, phrases, trie

SCHEMA = "doc_id long, text string, lang string, kept string, row long, rank int, node long, m int"


def lower(t):
    return re.sub("[A-Z]", lambda x: x[0].lower(), t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    say = lambda n, v: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    base = say(40, 30)
    out = [(1, base), (2, base.upper()), (3, base), (3, base), (4, None), (5, ""), (6, "É été"), (7, "é été"), (None, base), (None, "alone"), (None, "alone"), (8, base[:50]), (9, base[:50] + "x"), (10, "long " * 30_000)]
    out += [(k, say(r.randrange(0, 60), 12)) for k in range(11, 90)] + [(k, "same words here, same words here") for k in range(90, 130)]
    return [(k, t, None if (k or 0) % 9 == 4 else "xx", "a", 7, 1, 2, 3) for k, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# ---- exact duplicates


def test_trie_against_dict():
    r = random.Random(1)
    t, known = trie.Trie(), {}
    for _ in range(4000):
        s = bytes(r.choice(b"ab") for _ in range(r.randrange(0, 12)))
        value = t.insert(s, lambda x: [x, 0])
        value[1] += 1
        known[s] = known.get(s, 0) + 1
    assert dict(map(tuple, t.values())) == known
    largest = t.parts()[0][1]
    taken = dict(map(tuple, t.take(largest)))
    assert taken == {s: n for s, n in known.items() if s[:1] == bytes([largest])}
    assert dict(map(tuple, t.values())) == {s: n for s, n in known.items() if s not in taken}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bound,part", [(trie.BOUND, trie.PART), (20_000, 100_000)])
def test_exact_duplicates(docs, rows, keep, bound, part):
    got = trie.exact_duplicates(docs, keep=keep, bound=bound, part=part).collect()
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[lower(t)].append(k)
    want = []
    for t, keys in groups.items():
        known = [k for k in keys if k is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        stays = keys.index(best)
        want += [(k, best, len(keys), i == stays, hashlib.sha256(t.encode()).hexdigest()) for i, k in enumerate(keys)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_exact_rows_that_stay(docs, rows):
    out = trie.one_of_each(docs)
    assert out.columns == docs.columns
    assert Counter(lower(r.text) for r in out.collect()) == Counter(dict.fromkeys({lower(t) for _, t, *_ in rows}, 1))


def test_exact_duplicates_string_keys(spark):
    table = spark.createDataFrame([("a", "T"), ("b", "t"), ("c", "u")], "name string, text string")
    assert sorted((r.name, r.keep_id, r.kept) for r in trie.exact_duplicates(table, key="name").collect()) == [("a", "b", False), ("b", "b", True), ("c", "c", True)]


# ---- ranked search


def ranking(rows, items, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    bags = [(k, Counter(terms(t)), len(terms(t))) for k, t, *_ in rows]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for i, text in items:
        scores = []
        for k, b, n in bags:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text))
            if s > 0:
                scores.append((-s, k is None, k or 0, k))
        out += [(i, place + 1, k, -s) for place, (s, _, _, k) in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("block,cells", [(lexical.BLOCK, lexical.CELLS), (900, 7)])
def test_ranked(spark, docs, rows, block, cells, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "CELLS", cells)
    items = [(1, "w1 w2 w2 W3"), (2, "SAME words"), (2, "same words"), (3, None), (4, "nowhere"), (5, "É long"), (None, "w5, alone w5")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = lexical.ranked(docs, table).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(ranking(rows, items), key=repr)


def test_best_keeps_ties_by_key():
    best = lexical.Best(1, 2)
    best.add(np.array([0, 0, 0]), np.array([5, 5, 4]), np.array([9, 8, 1]))
    best.add(np.array([0]), np.array([5]), np.array([3]))
    assert best.key.tolist() == [3, 8] and best.score.tolist() == [5, 5]


# ---- collocations


def phrase_table(rows, most=3, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(t)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        own = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * b >= 50 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items()):
                continue
            score, _, left, right = min((Fraction(1_000_000 * a * a, counts[g[:k]] * counts[g[k:]]).__floor__(), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            own.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top])]
    return out


@pytest.mark.parametrize("most,top,size", [(3, 7, 2000), (4, 50, phrases.CHUNK)])
def test_collocations(docs, rows, most, top, size, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", size)
    monkeypatch.setattr(phrases, "HELD", 2 * size)
    got = phrases.collocations(docs, most=most, top=top).collect()
    assert sorted(map(tuple, got)) == sorted(phrase_table(rows, most, top=top))


def test_three_way_against_counts():
    r = np.random.default_rng(4)
    for n, kinds in ((1, 1), (50, 2), (3000, 9), (3000, 400)):
        symbols, weight = r.integers(-kinds, kinds, (3, n)), r.integers(1, 4, n)
        total = Counter()
        for g, w in zip(map(tuple, symbols.T.tolist()), weight.tolist()):
            total[g] += w
        want = [total[g] if total[g] >= 6 else 0 for g in map(tuple, symbols.T.tolist())]
        assert phrases.three_way(symbols, weight, 6).tolist() == want


def test_exact_scores_beyond_64_bits(spark):
    a, left, right = 9_000_000_000_123, 9_000_000_000_124, 9_000_000_000_999
    value = spark.sql(f"select (1000000 * cast({a} as decimal(19, 0)) * cast({a} as decimal(19, 0))) div (cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0)))").first()[0]
    assert value == 1_000_000 * a * a // (left * right)


# ---- all of them


def test_no_rows(spark, docs):
    none = docs.filter("false")
    bench = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert trie.exact_duplicates(none).count() == 0 and trie.one_of_each(none).count() == 0
    assert lexical.ranked(none, bench).count() == 0 and lexical.ranked(docs, bench.filter("false")).count() == 0
    assert phrases.collocations(none).count() == 0
