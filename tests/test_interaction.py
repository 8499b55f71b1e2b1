"""Content x player: ridge on one-hot blocks and trees with the player as a category, against dense fits on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.functions.columns import draw
from tracklens.operators import boost, models as M


def frame(spark, players=12, n=40):
    p, k = F.col("id") % players, F.col("id")
    d = spark.range(players * n).select(k, p.alias("player"), F.floor(draw("a", k) * 9).cast("double").alias("x1"), F.floor(draw("b", k) * 7).cast("double").alias("x2"), (draw("t", k) < 0.2).alias("is_test"))
    slope = draw("s", F.col("player")) * 6 - 3
    return d.withColumn("acc", 50 + 8 * draw("u", F.col("player")) + slope * (F.col("x1") - 4) + F.col("x2") + draw("e", F.col("id")))


def test_ridge_gives_every_player_slopes_of_its_own(spark):
    d = frame(spark).cache()
    tr, te = d.filter("not is_test and player <> 3"), d.filter("is_test")  # player 3 is not seen in training
    got = {x.id: x.pred for x in M.interaction_predict(tr, te, ["x1", "x2"], "player", "acc", 2.0).collect()}
    a, b = tr.toPandas(), te.toPandas()
    mu, means = a["acc"].mean(), a.groupby("player")["acc"].mean()
    base = lambda p: p["player"].map(means).fillna(mu).to_numpy()
    m, s = a[["x1", "x2"]].mean(), a[["x1", "x2"]].std(ddof=0)

    def wide(p):
        x = ((p[["x1", "x2"]] - m) / s).to_numpy()
        return np.hstack([np.ones((len(p), 1)), x, *[x * (p["player"] == k).to_numpy()[:, None] for k in means.index]])

    X = wide(a)
    w = np.linalg.solve(X.T @ X + 2.0 * np.diag([0.0] + [1.0] * (X.shape[1] - 1)), X.T @ (a["acc"].to_numpy() - base(a)))
    want = dict(zip(b["id"], np.clip(base(b) + wide(b) @ w, 0, 100)))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-8


def spark_trees(tr, te, rounds):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    a, b = M.group_base(tr, te, "player", "acc")
    stages = [StringIndexer(inputCol="player", outputCol="_p"), VectorAssembler(inputCols=["x1", "x2", "_p"], outputCol="features"), M.gbt(rounds).setLabelCol("_y")]
    out = Pipeline(stages=stages).fit(a.withColumn("_y", F.col("acc") - F.col("_base"))).transform(b)
    return out.agg(F.avg(F.abs(F.col("acc") - M.clip(F.col("_base") + F.col("prediction"), 0.0, 100.0)))).first()[0]


@pytest.mark.parametrize(("held", "most"), [(1_000_000, 250_000), (0, 250_000), (0, 20)], ids=["one task", "passes", "players of many rows"])
def test_trees_split_by_player_as_spark_does(spark, monkeypatch, held, most):
    monkeypatch.setattr(boost, "HELD", held)
    monkeypatch.setattr(boost, "KEEP", 2)
    monkeypatch.setattr(M, "FIT_ROWS", most)
    d = frame(spark).cache()
    tr, te = d.filter("not is_test"), d.filter("is_test")
    rounds = 12 if not held else 4
    want = spark_trees(tr, te, rounds)
    assert abs(M.interaction_trees(tr, te, ["x1", "x2"], "player", "acc", rounds) - want) < 1e-6
    plain = M.mae(M.fit_predict(tr, te, ["x1", "x2"], "acc", M.gbt(rounds), impute=False), "acc", "pred")
    assert want < 0.8 * plain  # the players do matter


def test_a_player_of_one_row_and_a_row_without_player(spark):
    rows = [(p, float(i % 5), float(i % 3), 40.0 + 5 * p + (i % 5) * (p - 2)) for p in range(5) for i in range(20)] + [(9, 1.0, 1.0, 70.0), (None, 2.0, 2.0, 30.0)]
    tr = spark.createDataFrame(rows, "player long, x1 double, x2 double, acc double")
    te = spark.createDataFrame([(9, 2.0, 1.0, 70.0), (None, 2.0, 2.0, 30.0), (77, 1.0, 1.0, 50.0), (1, None, 1.0, 50.0)], "player long, x1 double, x2 double, acc double")
    out = M.interaction_predict(tr, te, ["x1", "x2"], "player", "acc")
    assert {x.player for x in out.collect()} == {9, None, 77} and all(0 <= x.pred <= 100 for x in out.collect())  # the row with a gap is left out
    assert M.interaction_trees(tr, te, ["x1", "x2"], "player", "acc", 3) > 0
