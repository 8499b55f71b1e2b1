"""Hand-checked metrics and planted-signal models."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from tracklens.functions.columns import draw
from tracklens.operators import metrics as E, models as M, sequence, splits
from tracklens.streaming import first_play as fs
from tracklens.sources import sinks


def matrix(spark, players=60, items=80):
    g = spark.range(players * items).select((F.col("id") % players).alias("player"), F.floor(F.col("id") / players).alias("item")).filter(draw("keep", F.col("player"), F.col("item")) < 0.5)
    p = [draw(f"p{k}", F.col("player")) * 2 - 1 for k in range(2)]
    q = [draw(f"q{k}", F.col("item")) * 2 - 1 for k in range(2)]
    return g.withColumn("acc", 60 + 3 * draw("u", F.col("player")) + 15 * (p[0] * q[0] + p[1] * q[1]) + draw("e", F.col("player"), F.col("item")))


def test_als_finds_planted_factors_and_cold_keys_fall_back(spark):
    m = splits.random_mask(matrix(spark), 1, 0.2).cache()
    tr, te = m.filter("not is_test"), m.filter("is_test")
    p = M.als_predict(tr, te, rank=3, reg=0.05, iters=10)
    r = p.agg(F.avg(F.abs(F.col("acc") - F.col("mf"))).alias("mf"), F.avg(F.abs(F.col("acc") - F.col("additive"))).alias("b")).first()
    assert r.mf < 0.6 * r.b
    cold = M.als_predict(tr.filter("player <> 3"), te.filter("player = 3"), rank=3, iters=3)
    assert all(abs(x.mf - x.additive_shrunk) < 1e-9 for x in cold.collect())


def test_ridge_equals_closed_form(spark):
    m = matrix(spark).withColumn("x1", draw("q0", F.col("item"))).withColumn("x2", draw("q1", F.col("item"))).cache()
    got = {(r.player, r.item): r.pred for r in M.ridge_predict(m, m, ["x1", "x2"], "acc", 7.0).collect()}
    pdf = m.toPandas()
    X = pdf[["x1", "x2"]].to_numpy()
    Z = (X - X.mean(0)) / X.std(0)
    y = pdf["acc"].to_numpy()
    b = np.linalg.solve(Z.T @ Z + 7.0 * np.eye(2), Z.T @ (y - y.mean()))
    for (_, row), w in zip(pdf.iterrows(), y.mean() + Z @ b):
        assert abs(got[(row.player, row["item"])] - w) < 1e-6


def test_splits_do_not_leak(spark):
    m = matrix(spark)
    held = splits.cold_groups(m, "player", 0.1, 0, "cold_player")
    assert held.count() == 6
    assert m.join(held, "player", "left_anti").join(held, "player").count() == 0
    loo = splits.leave_k_out(m, 5, 0).groupBy("player").count().collect()
    assert {r["count"] for r in loo} == {5}


def test_kappa_auc_and_centring(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.2), (3, 2.6), (9, 9.4)], "a int, b double")
    assert E.kappa(df, "a", "b").first().qwk == 1.0
    auc = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.9)], "y int, s double")
    assert E.auc(auc, "y", "s").first().auc == 0.875
    pr = spark.createDataFrame([(0, 1, 10.0, 60.0), (0, 2, 20.0, 70.0), (1, 1, 5.0, 5.0), (1, 2, 9.0, 9.0)], "player long, item long, y double, pred double")
    assert E.centred_errors(pr).first().centred_mae == 0.0
    assert E.basic(pr).first().mae == 25.0


def test_conformal_covers(spark):
    d = spark.range(2000).select(F.col("id"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), (draw("y", F.col("id")) * 4 - 1).alias("y"))
    r = E.conformal(d.filter("id % 2 = 0"), d.filter("id % 2 = 1")).first()
    assert abs(r.coverage - 0.8) < 0.04


def test_permutation_space_seven_lanes(spark):
    rows = [(1, i, t, l) for i, (t, l) in enumerate([(0, 1), (0, 4), (3, 2), (4, 7), (6, 0), (6, 5), (6, 6), (9, 3), (15, 1)])]
    n = spark.createDataFrame(rows, "item long, event_id long, tick long, lane int")
    got = sequence.perm_space(n, 7).first()
    ticks = sorted({r[2] for r in rows})
    lanes = {t: [r[3] for r in rows if r[2] == t and r[3] > 0] for t in ticks}
    gap = [b - a for a, b in zip(ticks, ticks[1:])] + [0]
    w = np.array([0 if g == 0 else min(min(x for x in gap if x) / g, 1) for g in gap])
    vals = {"tight": [], "base": [], "smooth": [], "spread": []}
    x = np.arange(len(ticks))
    for perm in itertools.permutations(range(1, 8)):
        pos = {lane: i + 1 for i, lane in enumerate(perm)}
        ys = [[pos[v] for v in lanes[t]] for t in ticks]
        y = np.array([np.mean(v) if v else 0.0 for v in ys])
        span = np.array([max(v) - min(v) if len(v) > 1 else 0 for v in ys])
        W = w.sum()
        sl = ((w * x * y).sum() - (w * x).sum() * (w * y).sum() / W) / ((w * x * x).sum() - (w * x).sum() ** 2 / W)
        ic = ((w * y).sum() - sl * (w * x).sum()) / W
        vals["smooth"].append(math.sqrt((w * (y - sl * x - ic) ** 2).sum() / W))
        vals["tight"].append((span * w).sum() / W)
        vals["base"].append(((span + np.abs(np.diff(y, prepend=y[0]))) * w).sum() / W)
        vals["spread"].append(math.sqrt(max((w * y * y).sum() / W - ((w * y).sum() / W) ** 2, 0)))
    for k, v in vals.items():
        v = np.array(v)
        for s, want in (("mean", v.mean()), ("std", v.std()), ("min", v.min()), ("max", v.max()), ("base_pct", (v < v[0] - 1e-9).mean())):
            assert abs(got[f"ps_{k}_{s}"] - want) < 1e-6, (k, s)


def test_streamed_first_plays_equal_batch(spark):
    log = spark.range(300).select((F.col("id") % 7).alias("player"), (F.col("id") % 11).alias("item"), (F.col("id") * 3600).alias("ts"), F.timestamp_seconds(F.col("id") * 3600).alias("time"), F.lit(1.0).alias("acc"), F.lit(1).alias("lamp"))
    want = sorted((r.player, r.item, r.time) for r in log.groupBy("player", "item").agg(F.min("time").alias("time")).collect())
    src, out, ck = (sinks.scratch(spark, n) for n in ("s", "o", "c"))
    log.repartition(6).write.parquet(src)
    fs.run_updates(fs.first_plays(fs.log_stream(spark, src, 2)), out, ck)
    assert sorted((r.player, r.item, r.time) for r in fs.compact(spark, out).collect()) == want


def plays(spark, rows):
    """(player, item, day) as log rows."""
    return spark.createDataFrame(rows, "player long, item long, day long").select("player", "item", (F.col("day") * 86400).alias("ts"), F.timestamp_seconds(F.col("day") * 86400).alias("time"), F.lit(1.0).alias("acc"), F.lit(1).alias("lamp"))


def streamed_weeks(spark, parts, keep):
    """({Monday: n}, late rows of every part) of parts that arrive one after the other."""
    src, out, ck = (sinks.scratch(spark, n) for n in ("s", "o", "c"))
    late = []
    for part in parts:
        plays(spark, part).write.mode("append").parquet(src)
        late.append(fs.run_windows(fs.weekly_windows(fs.first_plays_in_order(fs.log_stream(spark, src, 100), keep)), out, ck))
    return {r.week.strftime("%Y-%m-%d"): r.n for r in fs.latest_windows(spark, out).collect()}, late


def test_ordered_feed_in_event_time_equals_batch(spark):
    rows = [(i % 7, i % 11, i + 100) for i in range(150)]  # every key again after 77 days
    got, late = streamed_weeks(spark, [rows[a : a + 50] for a in (0, 50, 100)], "1000 days")
    log = plays(spark, rows)
    want = {r.week: r.n for r in fs.weekly(log.groupBy("player", "item").agg(F.min("time").alias("time"))).collect()}
    assert got == want and sum(got.values()) == 77 and not any(late)


def test_late_rows_are_dropped_and_counted(spark):
    parts = [[(1, 1, 4), (2, 2, 100)],  # the newest row is of day 100: with 30 days, day 70 is the limit from here on
             [(3, 3, 75), (4, 4, 10), (2, 2, 101)],  # in time; late; seen before
             [(5, 5, 180)],
             [(2, 2, 181)]]  # forgotten by now: a first play again
    got, late = streamed_weeks(spark, parts, "30 days")
    assert sum(late) == 1 and late[0] == 0
    assert sum(got.values()) == 5  # days 4, 100, 75, 180 and 181
    assert got["1970-01-05"] == 1 and "1970-01-12" not in got


def test_gate_rules_and_latent_gain(spark):
    rows = [("warm", s, p, 10.0 * i + e, 10.0 * i + e + 2 + i % 2, 10.0 * i + e + 4 + 3 * (i % 2), 10.0 * i + e + 3) for s in (0, 1) for p in (1, 2) for i in (0, 1) for e in (0.0, 1.0)]
    rows += [("loo_1", s, p, 1.0, 3.0, 2.0, 2.5) for s in (0, 1) for p in (1, 2)] + [("cold_player", 0, 1, 1.0, 2.0, 2.0, 2.0), ("cold_player", 0, 1, None, 9.0, 0.0, 0.0)]
    pred = spark.createDataFrame(rows, "split string, seed int, player long, acc double, mf double, gate double, bias double")
    got = {r.split: r for r in E.gate_table(E.seed_errors(pred, "acc", ["mf", "gate", "bias"]), "mf", "gate", "bias").collect()}
    assert got["warm"].passed and got["warm"].mae == 2.5 and got["warm"].gate_mae == 5.5 and got["warm"].centred_mae == 0.5 and got["warm"].latent_gain == 0.5 and got["warm"].latent_helps and got["warm"].note is None
    assert not got["loo_1"].passed and got["loo_1"].reasons == "mae: no stable win" and got["loo_1"].centred_mae is None and "one test row" in got["loo_1"].note and got["loo_1"].latent_gain == -0.5
    assert got["cold_player"].passed and got["cold_player"].mae == 1.0


def test_trace_stops_early_and_grid_takes_the_smallest_error(spark):
    m = splits.random_mask(matrix(spark), 1, 0.2).cache()
    tr, te = m.filter("not is_test"), m.filter("is_test")
    inner = splits.random_mask(tr.drop("is_test"), 7, 0.2, "inner").filter("is_test").select("player", "item")
    trace = M.als_select(tr, inner, [2, 3], [0.05, 1e4], [2, 6, 10, 14], patience=1)
    by = {}
    for rank, reg, n, e in trace:
        by.setdefault((rank, reg), []).append((n, e))
    assert list(by) == [(2, 0.05), (2, 1e4), (3, 0.05), (3, 1e4)]
    for steps in by.values():  # ends at the first step that brings nothing
        assert all(b[1] < a[1] for a, b in zip(steps[:-1], steps[1:-1])) and (len(steps) == 4 or steps[-1][1] >= steps[-2][1])
    assert M.best_point(trace)[1] == 0.05 and M.best_point(trace)[3] == min(e for *_, e in trace)


def test_factors_read_written_frames(spark, monkeypatch):
    seen, plain = [], M.baselines.predict
    monkeypatch.setattr(M.baselines, "predict", lambda train, rows, *a, **k: seen.append((train, rows)) or plain(train, rows, *a, **k))
    rows = spark.createDataFrame([(p, i, float(50 + p + i)) for p in range(4) for i in range(5)], "player long, item long, acc double")
    M.Factors(rows.filter("player <> item"), rows.filter("player = item"))
    assert len(seen) == 2 and all("/cut-" in f for pair in seen for d in pair for f in d.inputFiles()) and all(d.inputFiles() for pair in seen for d in pair)


def test_fits_leave_nothing_behind(spark, monkeypatch):
    import os

    monkeypatch.setattr(M, "LARGE", 0)
    rows = spark.createDataFrame([(p, i, float(50 + p + i)) for p in range(6) for i in range(7)], "player long, item long, acc double")
    train, test = rows.filter("player <> item"), rows.filter("player = item")
    f = M.Factors(train, test)
    kept = [f.residuals._cut, f.rows._cut]
    where = os.path.dirname(kept[0])
    before = {x for x in os.listdir(where) if x.startswith("cut-")}
    assert f.predict(rank=2, iters=2).count() == 6
    f.close()
    assert not any(os.path.exists(x) for x in kept)
    M.als_select(train, rows.filter("item = player + 1").select("player", "item"), [2], [0.3], [1, 2])
    assert {x for x in os.listdir(where) if x.startswith("cut-")} <= before
