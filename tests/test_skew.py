"""The chunked plans for hot keys must equal the plain window plans."""

import pytest
from pyspark.sql import functions as F

from tracklens.operators import causal, knn, ranks, sequence, skew
from tracklens.functions.columns import draw_long

ORD = ["ts", "seq", "item"]


@pytest.fixture(scope="module")
def fp(spark):
    # player 0 holds a third of all rows; times collide, some acc are missing
    base = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17 + 1).cast("long").alias("player"), F.col("id").alias("item"),
        (draw_long("t", F.col("id")) % 200 * 86400).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 11 != 0, (draw_long("a", F.col("id")) % 101).cast("double")).alias("acc"),
        (draw_long("l", F.col("id")) % 10).cast("int").alias("lamp"), (draw_long("b", F.col("id")) % 7).cast("int").alias("bp"),
        (draw_long("x", F.col("id")) % 50).cast("double").alias("x1"), (draw_long("y", F.col("id")) % 9).cast("double").alias("x2"))
    return base.cache()


@pytest.fixture(scope="module")
def hot(fp):
    h = skew.probe(fp, ["player"], "ts", 40)
    assert h is not None and [r.player for r in h.collect()] == [0]
    return h


def same(a, b, cols, digits=9):
    key = ["player", "item"]
    rnd = lambda d: sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in d.select(*key, *cols).collect()), key=repr)
    assert rnd(a) == rnd(b)


def test_no_hot_key_gives_plain_plan(fp):
    assert skew.probe(fp, ["player"], "ts", 10_000) is None


def test_prefix_all_kinds(fp, hot):
    aggs = {"r": ("rank",), "s": ("sum", F.col("acc")), "c": ("count", F.col("acc")), "mx": ("max", F.col("acc")), "mn": ("min", F.col("acc")),
            "pv": ("prev", F.col("acc")), "nx": ("next", F.col("acc")), "f": ("first", F.col("ts")), "st": ("max", F.struct("ts", "seq"))}
    a, b = skew.prefix(fp, ["player"], ORD, aggs), skew.prefix(fp, ["player"], ORD, aggs, hot)
    same(a, b, list(aggs))


def test_one_key_and_one_time(spark):
    """100,000 rows of one key and one timestamp: no chunk above the limit, equal to the plain window."""
    rows = spark.range(100_000).select(F.lit(0).cast("long").alias("player"), F.col("id").alias("item"), F.lit(5).cast("long").alias("ts"), draw_long("s", F.col("id")).alias("seq"), (F.col("id") % 101).cast("double").alias("acc"))
    rows = rows.union(spark.range(1).select(F.lit(0).cast("long"), F.lit(-1).cast("long"), F.lit(10**12).cast("long"), F.lit(0).cast("long"), F.lit(1.0)))
    hot = skew.probe(rows, ["player"], "ts", 10_000)
    assert max(r["count"] for r in skew._equi_depth(rows, ["player"], ORD, hot).groupBy(skew.CHUNK).count().collect()) <= 10_000
    aggs = {"r": ("rank",), "s": ("sum", F.col("acc")), "pv": ("prev", F.col("acc"))}
    a, b = (skew.prefix(rows, ["player"], ORD, aggs, h).agg(*[F.sum(F.hash("item", c)).alias(c) for c in aggs]).first() for h in (None, hot))
    assert a == b


@pytest.mark.parametrize("by,span,upto", [("rows", 10, -1), ("rows", 3, 0), ("range", 20 * 86400, -1), ("range", 86400, 0)])
def test_trailing(fp, hot, by, span, upto):
    aggs = {"m": F.avg("acc"), "n": F.count(F.lit(1))}
    same(skew.trailing(fp, ["player"], ORD, span, aggs, None, by, upto), skew.trailing(fp, ["player"], ORD, span, aggs, hot, by, upto), list(aggs))


def test_history_last10_and_activity(fp, hot):
    cols = ["h_n_firstplays", "h_n_known_acc", "h_acc_mean", "h_acc_std", "h_fail_rate", "h_fc_rate", "h_bp_mean", "h_days_span"]
    same(causal.history(fp, ORD), causal.history(fp, ORD, hot), cols)
    same(causal.last_known(fp, ORD), causal.last_known(fp, ORD, hot=hot), ["h_acc_last10"])
    log = fp.select("player", "ts")
    same(causal.activity(fp, log), causal.activity(fp, log, hot), ["h_days_since_active", "h_plays_last30d"])


def test_last10_matches_brute_force(fp):
    rows = sorted(fp.collect(), key=lambda r: (r.player, r.ts, r.seq, r.item))
    want, known = {}, {}
    for r in rows:
        k = known.setdefault(r.player, [])
        want[r.item] = sum(k[-10:]) / len(k[-10:]) if k else None
        if r.acc is not None:
            k.append(r.acc)
    got = {r.item: r.h_acc_last10 for r in causal.last_known(fp, ORD).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert (got[i] is None and w is None) or abs(got[i] - w) < 1e-9


def test_response_and_shuffle(fp, hot):
    for kw in ({}, {"half_life_days": 60.0}):
        a, b = causal.response(fp, ORD, ["x1", "x2"], min_n=5.0, **kw), causal.response(fp, ORD, ["x1", "x2"], min_n=5.0, hot=hot, **kw)
        same(a, b, ["h_resp_x1", "h_slope_x1", "h_dev_x2"], 6)
    d = draw_long("s", F.col("player"), F.col("item"))
    same(causal.shuffle_time(fp, ORD, d), causal.shuffle_time(fp, ORD, d, hot), ["new_ts"])


def test_quantiles_and_spearman_of_hot_groups(fp, hot, monkeypatch):
    plain_q = ranks.quantiles(fp, ["player"], "acc", {"a": 0.1, "b": 0.5}).collect()
    plain_s = ranks.spearman(fp, ["player"], "acc", "ts").collect()
    all_q = ranks.quantiles(fp, [], "acc", {"a": 0.1, "b": 0.5}).first()
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    assert sorted(ranks.quantiles(fp, ["player"], "acc", {"a": 0.1, "b": 0.5}, hot).collect()) == sorted(plain_q)
    got = {r.player: r.rho for r in ranks.spearman(fp, ["player"], "acc", "ts", hot).collect()}
    for r in plain_s:
        assert abs(got[r.player] - r.rho) < 1e-9
    again = ranks.quantiles(fp, [], "acc", {"a": 0.1, "b": 0.5}).first()
    assert again == all_q
    import numpy as np
    acc = [r.acc for r in fp.collect() if r.acc is not None]
    assert abs(all_q.a - np.quantile(acc, 0.1)) < 1e-9 and abs(all_q.b - np.quantile(acc, 0.5)) < 1e-9


def test_global_rank_is_a_permutation(fp):
    r = skew.global_prefix(fp, ["acc", "item"], {"rk": ("rank",)}, 50).select("rk").collect()
    assert sorted(x.rk for x in r) == list(range(1, 601))


def test_large_player_neighbours_equal_block_plan(fp, hot):
    known = fp.withColumn("acc", F.coalesce("acc", F.lit(1.0)))
    small = knn.prior_neighbours(known, ORD, ["x1", "x2"], [3, 5])
    large = knn.prior_neighbours(known, ORD, ["x1", "x2"], [3, 5], hot, block=20, finest=-4)
    same(small, large, ["n_3", "knn_3", "n_5", "knn_5"])


def brute_neighbours(rows, k):
    """{item: mean acc of the k nearest earlier rows}, distances in doubles, ties to the earlier row."""
    import numpy as np

    x = np.array([[np.nan if v is None else float(v) for v in (r.x1, r.x2)] for r in rows])
    x = np.where(np.isnan(x), np.nanmean(x, 0), x)
    s = np.array([np.nanstd([float(v) for v in c if v is not None]) for c in zip(*[(r.x1, r.x2) for r in rows])])
    out, hist = {}, {}
    for i, r in enumerate(rows):
        h = hist.setdefault(r.player, [])
        near = sorted((sum(((x[i, a] - x[j, a]) / s[a]) ** 2 for a in (0, 1) if s[a] > 0), n, j) for n, j in enumerate(h))[:k]
        acc = [rows[j].acc for _, _, j in near if rows[j].acc is not None]
        out[r.item] = sum(acc) / len(acc) if acc else None
        h.append(i)
    return out


@pytest.mark.parametrize("block", [knn.BLOCK, 20])
def test_neighbours_match_brute_force(fp, hot, block):
    rows = sorted(fp.collect(), key=lambda r: (r.player, r.ts, r.seq, r.item))
    want = brute_neighbours(rows, 5)
    got = {r.item: r.knn_5 for r in knn.prior_neighbours(fp, ORD, ["x1", "x2"], [5], hot, block=block, finest=-3).collect()}
    assert got.keys() == want.keys()
    for item, w in want.items():
        assert (w is None and got[item] is None) or abs(w - got[item]) < 1e-9


def test_neighbours_of_equal_points_and_flat_axes(spark):
    n = 60
    df = spark.range(n).select(F.lit(1).cast("long").alias("player"), F.col("id").alias("item"), F.col("id").alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("acc"),
                               (F.col("id") % 2).cast("double").alias("x1"), F.lit(7.0).alias("x2"))
    for block in (knn.BLOCK, 10):  # the nearest are the earliest rows of the same parity
        got = {r.item: r.knn_3 for r in knn.prior_neighbours(df, ORD, ["x1", "x2"], [3], block=block, finest=-2).collect()}
        assert got[40] == 2.0 and got[41] == 3.0 and got[0] is None


def test_cells_tell_points_closer_than_a_thousandth_apart(spark):
    df = spark.range(50).select(F.lit(1).cast("long").alias("player"), F.col("id").alias("item"), F.col("id").alias("ts"), F.col("id").alias("seq"), F.col("id").cast("double").alias("acc"),
                                F.when(F.col("id") == 0, 1e6).otherwise(F.col("id") * 1e-3).alias("x1"))
    for block in (knn.BLOCK, 10):
        got = {r.item: r.knn_1 for r in knn.prior_neighbours(df, ORD, ["x1"], [1], block=block).collect()}
        assert all(got[i] == i - 1 for i in range(2, 50))


def test_sequence_stats_of_hot_item(spark):
    n = spark.range(400).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5 + 1).cast("long").alias("item"), F.col("id").alias("event_id"),
                                (draw_long("q", F.col("id")) % 300).alias("tick"), (draw_long("r", F.col("id")) % 8).cast("int").alias("lane"),
                                (F.col("id") % 9 == 0).cast("int").alias("type"), F.lit(5).cast("long").alias("dur")).cache()
    hot = skew.probe(n, ["item"], "tick", 100)
    assert hot is not None
    skew_limit, skew.HOT_ROWS = skew.HOT_ROWS, 30
    try:
        for f in (lambda h: sequence.density17(n, 16, 4, 0.2, hot=h), lambda h: sequence.gap_stats(n, ["item", "lane"], {"p": 0.25}, h, "m"), lambda h: sequence.perm_space(n.withColumn("lane", (F.col("lane") % 5)), 4, h)):
            a, b = ({r.item: r for r in f(h).collect()} for h in (None, hot))
            assert a.keys() == b.keys()
            for i in a:
                for x, y in zip(a[i], b[i]):
                    assert (x is None and y is None) or abs(x - y) < 1e-9
    finally:
        skew.HOT_ROWS = skew_limit
