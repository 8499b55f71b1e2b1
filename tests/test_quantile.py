"""Boosted quantile heads on rows whose spread depends on a feature."""

import numpy as np
from pyspark.sql import functions as F

from tracklens.operators import metrics, quantile


def test_heads_follow_the_spread(spark):
    r = np.random.default_rng(5)
    x = r.integers(1, 5, 4000)
    rows = [(int(k), float(a) if k % 50 else None, float(b), float(10 * a + a * e)) for k, (a, b, e) in enumerate(zip(x, r.normal(size=4000), r.normal(size=4000)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    heads = quantile.Heads(df.filter("id < 2000"), ["a", "b"], "y", [0.1, 0.9], rounds=8, step=0.5, depth=2)
    out = heads.predict(df.filter("id >= 2000"), ["lo", "hi"])
    assert out.columns == ["id", "a", "b", "y", "lo", "hi"] and out.filter("a is null").count() == 40
    loss = out.agg(*[F.avg(quantile.pinball(F.col("y"), p, q)).alias(n) for n, p, q in (("lo", F.col("lo"), 0.1), ("hi", F.col("hi"), 0.9), ("clo", F.lit(heads.start[0]), 0.1), ("chi", F.lit(heads.start[1]), 0.9))]).first()
    assert loss.lo < 0.6 * loss.clo and loss.hi < 0.6 * loss.chi
    width = {k.a: k.w for k in out.filter("a is not null").groupBy("a").agg(F.avg(F.col("hi") - F.col("lo")).alias("w")).collect()}
    assert width[4.0] > 2 * width[1.0]
    cover = metrics.conformal(out.filter("id < 3000"), out.filter("id >= 3000"), level=0.8).first().coverage
    assert abs(cover - 0.8) < 0.05


def _one_by_one(df, feats, label, qs, rounds, step, depth):
    """Predictions of heads grown alone: a Spark ML tree a round, then the quantile of every leaf."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows, out = VectorAssembler(inputCols=feats, outputCol="features").transform(df), {}
    ids, y = (np.array(v) for v in zip(*[(r.id, r[label]) for r in rows.collect()]))
    for q in qs:
        p = np.full(len(y), np.quantile(y, q))
        for _ in range(rounds):
            g = df.sparkSession.createDataFrame([(int(i), float(v)) for i, v in zip(ids, np.where(y >= p, q, q - 1))], "id int, g double")
            tree = DecisionTreeRegressor(maxDepth=depth, minInstancesPerNode=20, labelCol="g", leafCol="leaf", seed=0).fit(rows.join(g, "id"))
            at = {r.id: r.leaf for r in tree.transform(rows).select("id", "leaf").collect()}
            leaf = np.array([at[i] for i in ids])
            for k in set(leaf):
                p[leaf == k] += step * np.quantile(y[leaf == k] - p[leaf == k], q)
        out[q] = dict(zip(ids.tolist(), p))
    return out


def test_heads_share_their_passes_and_equal_heads_grown_alone(spark, monkeypatch):
    from tracklens.operators import boost

    r = np.random.default_rng(7)
    x = r.integers(0, 12, (1500, 3)).astype(float)
    y = np.where(r.random(1500) < 0.3, 0.0, (1 + x[:, 0]) * r.normal(size=1500) + x[:, 1])
    y[:3] = 1e12, -1e12, 1e-300  # far and tiny values
    df = spark.createDataFrame([(k, *map(float, (*a, b))) for k, (a, b) in enumerate(zip(x, y))], "id int, a double, b double, c double, y double")
    passes, real = [], boost._pass
    monkeypatch.setattr(boost, "_pass", lambda *a: passes.append(1) or real(*a))
    heads = quantile.Heads(df, ["a", "b", "c"], "y", [0.1, 0.9], rounds=3, step=0.3, depth=2)
    assert len(passes) == 6  # rounds x depth, whatever the number of heads
    want = _one_by_one(df, ["a", "b", "c"], "y", [0.1, 0.9], 3, 0.3, 2)
    for row in heads.predict(df, ["lo", "hi"]).collect():
        assert abs(row.lo - want[0.1][row.id]) < 1e-9 and abs(row.hi - want[0.9][row.id]) < 1e-9


def test_quantiles_of_leaves_are_exact(spark):
    from tracklens.operators import boost

    for y in ([3.0], [0.0] * 50 + [7.5] * 51, [1.0, np.nextafter(1.0, 2), 2.0, 1e300, -1e300, 1e15, 1e15 + 2], list(np.random.default_rng(3).normal(size=5000))):
        rows = spark.createDataFrame([(float(k % 2), float(v)) for k, v in enumerate(y)], "a double, y double").repartition(3)
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            m = boost.Model(0, 0, [0], q=q)
            boost.fit(rows, ["a"], ["y"], [m], 0)
            assert m.start == np.quantile(y, q) or abs(m.start - np.quantile(y, q)) < 1e-12 * abs(m.start)
