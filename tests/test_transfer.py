"""Few-shot rows against a plain loop, whole players held out, and the grid against single fits."""

import statistics

from pyspark.sql import functions as F

from tracklens.functions.columns import draw
from tracklens.operators import models as M, transfer as T

DDL = "player long, item long, ts long, acc double, lamp int, bp int, x1 double"


def rows():
    out = []
    for p, n in ((1, 9), (2, 4), (3, 1), (4, 12)):
        out += [(p, i, 86400 * (i * (p + 1) % 7) + i, None if (p, i) == (4, 3) else float(10 * p + i * i % 11), i % 9, i % 4, float(i)) for i in range(n)]
    return out


def test_few_shot_rows_equal_a_plain_loop(spark):
    sizes, n_targets = [0, 1, 3, 5], 4
    want = {}
    for p in {r[0] for r in rows()}:
        mine = sorted((r for r in rows() if r[0] == p), key=lambda r: (r[2], r[1]))
        own = mine[: max(sizes) + n_targets]
        for k in sizes:
            if k >= len(own) - 1:
                continue
            acc = [r[3] for r in own[:k] if r[3] is not None]
            for r in own[k : k + n_targets]:
                want[p, k, r[1]] = (
                    float(k), sum(acc) / len(acc) if acc else None, statistics.pstdev(acc) if len(acc) > 1 else None,
                    sum(x[4] == 1 for x in own[:k]) / k if k else None, sum(x[5] for x in own[:k]) / k if k else None,
                    (r[2] - own[0][2]) / 86400 if k else None)
    df = spark.createDataFrame(rows(), DDL)
    got = {(r.player, r.k, r["item"]): tuple(r[c] for c in T.HIST) for r in T.few_shot(df, ["ts", "item"], sizes, n_targets).collect()}
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[key], w)), key


def test_no_rows_give_no_targets(spark):
    assert T.few_shot(spark.createDataFrame([], DDL), ["ts", "item"]).count() == 0


def test_models_never_see_the_players_they_predict(spark):
    base = spark.range(400).select((F.col("id") % 8).alias("player"), F.col("id").alias("item"), (F.col("id") % 10).cast("double").alias("x1"))
    base = base.withColumn("fold", F.col("player") % 2).withColumn("acc", F.col("x1") * 5 + F.when(F.col("fold") == 1, 1000).otherwise(0))
    targets = base.withColumn("k", F.lit(0))
    p = T.unseen_players(base, targets, "fold", 2, {"acc": ("acc", lambda c: c, lambda c: c)}, {"m0": (["x1"], False)}, 4)
    seen = {r.fold: (r.lo, r.hi, r.n) for r in p.groupBy("fold").agg(F.min("m0_acc").alias("lo"), F.max("m0_acc").alias("hi"), F.count("*").alias("n")).collect()}
    assert seen[0][0] >= 1000 and seen[1][1] < 100 and seen[0][2] == seen[1][2] == 200  # each fold is predicted at the other's level


def test_curve_weighs_groups_by_rows(spark):
    d = spark.createDataFrame([(1, "a", 0, 1.0, 3.0), (2, "a", 0, 1.0, 1.0), (3, "b", 0, 1.0, 7.0), (3, None, None, 5.0, 4.0)], "player long, client string, k int, acc double, m0_acc double")
    got = {(r.client, r.k): (r.n_eval, r.n_players, r.m0_acc) for r in T.error_curve(d, "client", {"acc": "acc"}, ["m0"]).collect()}
    assert got == {("a", 0): (2, 2, 1.0), ("b", 0): (1, 1, 6.0), ("unknown", None): (1, 1, 1.0), ("all", 0): (3, 3, 8 / 3), ("all", None): (1, 1, 1.0)}


def test_grid_errors_equal_single_fits(spark):
    d = spark.range(300).select(F.col("id").alias("item"), draw("x", F.col("id")).alias("x1"), (F.col("id") % 3).alias("fold")).withColumn("resid", F.sin(F.col("x1") * 6) + draw("e", F.col("item")))
    trace = M.boost_select(d, ["x1"], "resid", "fold", 3, {"stepSize": [0.1, 0.3], "maxDepth": [2]}, [2, 5])
    assert [x[:3] for x in trace] == [(2, 0.1, 2), (5, 0.1, 2), (2, 0.3, 2), (5, 0.3, 2)]
    for n, step, depth, err in trace[:2]:
        own = [M.mae(M.fit_predict(d.filter(F.col("fold") != k), d.filter(F.col("fold") == k), ["x1"], "resid", M.gbt(n).setParams(stepSize=step, maxDepth=depth), impute=False), "resid", "pred") for k in range(3)]
        assert abs(sum(own) / 3 - err) < 1e-9
    assert trace[3][3] < trace[0][3]
