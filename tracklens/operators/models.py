"""Models on Spark ML: matrix factorisation over shrunk biases, ridge, boosted trees, logistic and isotonic fits.

Everything is fitted on train rows only.  Content features are never imputed (rows with a gap are
left out); history features take the train median.
"""

from __future__ import annotations

import itertools
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut, dropped, passing
from . import baselines, boost, skew

TREES = dict(maxIter=300, stepSize=0.06, maxDepth=3)  # reference settings; callers may lower maxIter


LARGE = 8_000_000  # fitted rows x rank from which a factorisation tidies up after every iteration
FIT_ROWS = 250_000  # rows of one part of a frame that a fit keeps


def spread(df: DataFrame) -> DataFrame:
    """The frame written once and dealt into as many parts as its rows ask for, so what one task of a fit keeps and reads does not grow with the table."""
    df = cut(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // FIT_ROWS))
    return df.repartition(parts)


def complete(df: DataFrame, feats: list[str]) -> DataFrame:
    return df.dropna(subset=feats)


def _double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _features(feats: list[str], impute: bool, scale: bool = False) -> list:
    stages, cols = [], feats
    if impute:
        cols = [f"_i_{f}" for f in feats]
        stages.append(Imputer(strategy="median", inputCols=feats, outputCols=cols))
    stages.append(VectorAssembler(inputCols=cols, outputCol="_raw" if scale else "features"))
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    return stages


def fit_predict(train: DataFrame, test: DataFrame, feats: list[str], label: str, estimator, impute: bool = True, scale: bool = False, out: str = "pred",
                transform: tuple | None = None) -> DataFrame:
    """Fit on train, add ``out`` to test.  ``transform`` = (to, back) column functions for a transformed target."""
    to, back = transform or (lambda c: c, lambda c: c)
    tr = _double(train, feats).withColumn("_label", to(F.col(label).cast("double")))
    est = estimator.setLabelCol("_label").setFeaturesCol("features")
    model = Pipeline(stages=[*_features(feats, impute, scale), est]).fit(tr)
    res = model.transform(_double(test, feats))
    return res.select(*test.columns, back(F.col("prediction")).alias(out))


def gbt(max_iter: int = 300, seed: int = 0, weight: str | None = None) -> GBTRegressor:
    g = GBTRegressor(**{**TREES, "maxIter": max_iter}, seed=seed)
    return g.setWeightCol(weight) if weight else g


def ridge(train: DataFrame, alpha: float, label: str, train_n: int | None = None) -> LinearRegression:
    """Penalty in sum-of-squares units.  Spark divides the loss by n and scales it by the label spread, hence the factor."""
    s = train.agg(F.stddev_pop(label).alias("s"), F.count(label).alias("n")).first()
    return LinearRegression(regParam=alpha * (s.s or 1.0) / s.n, elasticNetParam=0.0, standardization=False, solver="normal")


def ridge_predict(train: DataFrame, test: DataFrame, feats: list[str], label: str, alpha: float, out: str = "pred") -> DataFrame:
    """Ridge on features standardised by the train rows."""
    mom = train.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(feats) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {f"_z{i}": (F.col(c).cast("double") - mom[f"m{i}"]) / (mom[f"s{i}"] or 1.0) for i, c in enumerate(feats)}
    tr, te = train.withColumns(z).withColumn("_y", F.col(label).cast("double")), test.withColumns(z)
    va = VectorAssembler(inputCols=list(z), outputCol="features")
    model = ridge(tr, alpha, "_y").setLabelCol("_y").fit(va.transform(tr))
    return model.transform(va.transform(te)).select(*test.columns, F.col("prediction").alias(out))


def content_ridge(train: DataFrame, test: DataFrame, feats: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Player offset + ridge on item statistics for the rest, clipped to 0-100."""
    mu, (pe,) = baselines.effects(train, ["player"], target)

    def offset(df):
        j = df.withColumn("_mu", mu.scalar()).join(pe, "player", "left")
        return j.withColumn("_off", F.coalesce(F.col("m_player") - F.col("_mu"), F.lit(0.0))).drop("m_player", "n_player")

    tr = offset(train).withColumn("_res", F.col(target) - F.col("_mu") - F.col("_off"))
    p = ridge_predict(tr, offset(test), feats, "_res", alpha, "_r")
    return p.select(*test.columns, F.least(F.greatest(F.col("_mu") + F.col("_off") + F.col("_r"), F.lit(0.0)), F.lit(100.0)).alias("pred"))


def side_by_side(spark, work, points: list, parallel: int = 4) -> list:
    """``work`` of every point, ``parallel`` Spark jobs at a time; results in the order of the points."""
    with ThreadPool(parallel) as pool:
        return pool.map(inheritable_thread_target(spark)(work), points)


class Factors:
    """Matrix factorisation over the shrunk additive bias: ALS on the train residuals.

    The frames are written once, for any number of fits: residuals of the fitted rows, and the rows to predict with their bias; ``close`` removes them.  Where the
    factors are many, a fit checkpoints them in every iteration, so that the shuffles of those before are removed: what lies on disk does not grow with the iterations.
    Players and items are numbered by rank (ALS wants small numbers; the keys may be any).  A cold key falls back to the bias;
    predictions are clipped to 0-100.
    """

    def __init__(self, train: DataFrame, test: DataFrame, target: str = "acc", shrink_k: float = 10.0):
        checkpoint_dir(train.sparkSession)
        self.spark, self.target, self.columns = train.sparkSession, target, test.columns
        with passing(self.spark) as keep:
            train, test = cut(train.select("player", "item", target)), cut(test)  # each is read several times for numbers and effects
            numbers = [cut(skew.global_prefix(train.select(k).distinct(), [k], {n: ("rank",)}).select(k, F.col(n).cast("int").alias(n))) for k, n in (("player", "_u"), ("item", "_v"))]

            def framed(rows):
                out = baselines.predict(train, rows, target, shrink_k=shrink_k)
                for k, d in zip(("player", "item"), numbers):
                    out = out.join(d, k, "left")
                return out

            bias = F.col("additive_shrunk")
            self.residuals = cut(framed(train).filter(F.col(target).isNotNull()).select("_u", "_v", (F.col(target) - bias).cast("float").alias("_r")))
            self.rows = cut(framed(test).select(*test.columns, "additive", "additive_shrunk", "_u", "_v"))
            keep += [self.residuals, self.rows]
        self.n = self.residuals.count()

    def close(self) -> None:
        """Removes the frames; predictions must have been read by then."""
        dropped(self.spark, self.residuals, self.rows)

    def predict(self, rank: int = 8, reg: float = 0.3, iters: int = 25, seed: int = 0) -> DataFrame:
        """The rows with additive, additive_shrunk and mf."""
        every = 1 if self.large(rank) else 10
        als = ALS(rank=rank, regParam=reg, maxIter=iters, seed=seed, userCol="_u", itemCol="_v", ratingCol="_r", coldStartStrategy="nan", checkpointInterval=every)
        warm = als.fit(self.residuals).transform(self.rows.filter("_u is not null and _v is not null"))
        cold = self.rows.filter("_u is null or _v is null").withColumn("prediction", F.lit(None).cast("float"))
        latent = F.coalesce(F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)), F.lit(0.0))
        raw = F.col("additive_shrunk") + latent
        return warm.unionByName(cold).select(*self.columns, "additive", "additive_shrunk", F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)).alias("mf"))

    def large(self, rank: int) -> bool:
        return self.n * rank > LARGE

    def trace(self, rank: int, reg: float, steps: list[int], patience: int = 1, seed: int = 0) -> list[tuple[int, float]]:
        """(iterations, MAE on the rows) for growing numbers of iterations, until ``patience`` steps in a row bring nothing."""
        out, best, idle = [], None, 0
        for n in steps:
            out.append((n, mae(self.predict(rank, reg, n, seed), self.target, "mf")))
            if self.large(rank):
                dropped(self.spark)  # the fit's factors and shuffles
            idle = 0 if best is None or out[-1][1] < best else idle + 1
            best = out[-1][1] if best is None else min(best, out[-1][1])
            if idle >= patience:
                break
        return out


def als_predict(train: DataFrame, test: DataFrame, target: str = "acc", rank: int = 8, reg: float = 0.3, iters: int = 8, seed: int = 0, shrink_k: float = 10.0) -> DataFrame:
    """One fit of ``Factors``."""
    return Factors(train, test, target, shrink_k).predict(rank, reg, iters, seed)


def als_select(train: DataFrame, inner_keys: DataFrame, ranks_: list[int], regs: list[float], steps: list[int], target: str = "acc", patience: int = 1, parallel: int = 4) -> list[tuple[int, float, int, float]]:
    """(rank, reg, iterations, inner MAE) of every fit of the grid, in grid order; each point stops early.

    Models are fitted on the train rows outside ``inner_keys`` and scored on those inside; ``parallel`` points are fitted at a time.
    """
    key = ["player", "item"]
    with passing(train.sparkSession) as keep:
        inner_keys = cut(inner_keys)
        frames = Factors(train.join(inner_keys, key, "left_anti"), train.join(inner_keys, key, "left_semi"), target)
        keep += [frames.residuals, frames.rows]
    points = [(rk, rg) for rk in ranks_ for rg in regs]
    traces = side_by_side(train.sparkSession, lambda p: frames.trace(*p, steps, patience), points, parallel)
    frames.close()
    return [(*p, n, e) for p, tr in zip(points, traces) for n, e in tr]


def best_point(trace: list[tuple[int, float, int, float]]) -> tuple[int, float, int, float]:
    """The fit with the smallest inner MAE, of equal ones the first."""
    return min(trace, key=lambda x: x[3])


def boost_select(rows: DataFrame, feats: list[str], label: str, fold: str, folds: int, grid: dict[str, list], rounds: list[int]) -> list[tuple]:
    """(rounds, *settings, mean MAE over the folds) of every point of ``grid`` x ``rounds``, in grid order.

    Boosting is stage-wise, so one fit with the most rounds has the errors of all smaller numbers.  All points and folds grow side by side; the held-out rows
    are read once.
    """
    frame = cut(_double(rows.dropna(subset=[*feats, label]), [*feats, label]).select(fold, *feats, label))
    settings = [dict(zip(grid, x)) for x in itertools.product(*grid.values())]
    models = [boost.Model(k, 0, list(range(len(feats))), s.get("stepSize", TREES["stepSize"]), s.get("maxDepth", TREES["maxDepth"]), s.get("minInstancesPerNode", 1)) for s in settings for k in range(folds)]
    edge = boost.fit(frame, feats, [label], models, max(rounds), fold)
    points = [(i, n) for i in range(len(models)) for n in rounds]
    errors = frame.withColumn("_p", boost.predictions(feats, models, edge, F.col(fold), points)).agg(*[F.avg(F.abs(F.col(label) - F.col(f"_p.p{j}"))) for j in range(len(points))]).first()
    means = [[sum(errors[(i * folds + k) * len(rounds) + j] for k in range(folds)) / folds for j in range(len(rounds))] for i in range(len(settings))]
    return [(n, *s.values(), e[j]) for s, e in zip(settings, means) for j, n in enumerate(rounds)]


def classify(train: DataFrame, test: DataFrame, feats: list[str], label: str, estimator, out: str = "prob", impute: bool = True, scale: bool = False) -> DataFrame:
    """Probability of class 1 (or the predicted class with ``out='class'``)."""
    tr = _double(train, feats).withColumn("_label", F.col(label).cast("double"))
    model = Pipeline(stages=[*_features(feats, impute, scale), estimator.setLabelCol("_label").setFeaturesCol("features")]).fit(tr)
    res = model.transform(_double(test, feats))
    col = F.col("prediction") if out == "class" else vector_to_array("probability")[1]
    return res.select(*test.columns, col.alias(out))


def isotonic(cal: DataFrame, test: DataFrame, x: str, y: str, lo: float, hi: float) -> DataFrame:
    """Monotone recalibration of ``x`` fitted on the calibration rows; clipped; plus the half-step grid version."""
    model = IsotonicRegression(featuresCol=x, labelCol="_y", predictionCol="_iso").fit(cal.withColumn("_y", F.col(y).cast("double")))
    iso = F.least(F.greatest("_iso", F.lit(lo)), F.lit(hi))
    return model.transform(test).withColumn("iso", iso).withColumn("iso_grid", F.rint(F.col("iso") * 2) / 2).drop("_iso")


def residual_band(cal: DataFrame, test: DataFrame, bins: int = 10, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """q10 / q90 band: residual quantiles per bin of the predicted value, from calibration rows."""
    from . import ranks

    edges = ranks.quantiles(cal, [], "pred", {f"e{i}": i / bins for i in range(1, bins)})

    def binned(df):
        d = df.withColumn("_e", edges.select(F.struct(*edges.columns)).scalar())
        return d.withColumn("bin", sum(((F.col("pred") >= F.col(f"_e.{e}")).cast("int") for e in edges.columns), F.lit(0))).drop("_e")

    q = ranks.quantiles(binned(cal).withColumn("_res", F.col("y") - F.col("pred")), ["bin"], "_res", {"rlo": lo, "rhi": hi}, "auto")
    return binned(test).join(q, "bin").withColumns({"lo": F.col("pred") + F.col("rlo"), "hi": F.col("pred") + F.col("rhi")}).drop("rlo", "rhi")


def difficulty_frame(train: DataFrame, target: str = "acc") -> DataFrame:
    """Per item: raters, mean residual after removing rater skill, mean skill of its raters."""
    _, (pe,) = baselines.effects(train, ["player"], target)
    d = train.join(pe.select("player", "m_player"), "player")
    return d.groupBy("item").agg(F.count(F.lit(1)).alias("n_raters"), F.avg(F.col(target) - F.col("m_player")).alias("mean_resid"), F.avg("m_player").alias("mean_skill"))


def group_base(train: DataFrame, test: DataFrame, group: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``_base``: the group's mean label in train, the mean of all train rows where it has none."""
    means = train.groupBy(group).agg(F.avg(label).alias("_m"))
    mu = train.agg(F.avg(label)).first()[0]

    def based(df):
        return df.join(means, group, "left").withColumn("_base", F.coalesce("_m", F.lit(mu))).drop("_m")

    return based(train), based(test)


def standardised(train: DataFrame, test: DataFrame, feats: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both frames with the features less the train mean, in units of the train spread."""
    mom = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(feats) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = {c: (F.col(c).cast("double") - mom[f"m{i}"]) / (mom[f"s{i}"] or 1.0) for i, c in enumerate(feats)}
    return train.withColumns(z), test.withColumns(z)


def interaction_predict(train: DataFrame, test: DataFrame, feats: list[str], group: str, label: str, alpha: float = 1.0) -> DataFrame:
    """Content x group: the residual over the group's mean by ridge on [X | one-hot(group) * X], for any number of groups; clipped to 0-100.

    The slopes of a group meet those of other groups only through the common ones, so the one-hot columns are never made: one row of cross-moments a group, the
    common part solved once from what is left of their sum after each group's own slopes are eliminated, then every group's slopes.  The intercept bears no
    penalty.  Rows with gaps are left out; a group without train rows has the common part only.
    """
    import numpy as np

    test_columns, d = test.columns, len(feats)
    train, test = standardised(*group_base(complete(train, [*feats, label]), complete(test, [*feats, label]), group, label), feats)
    g = [F.lit(1.0), *[F.col(c) for c in feats]]
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    moments = train.groupBy(group).agg(*[F.sum(g[i] * g[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x * (F.col(label) - F.col("_base"))).alias(f"c{i}") for i, x in enumerate(g)])
    moments = cut(moments)
    penalty = alpha * np.eye(d)

    def opened(p):
        a = np.zeros((len(p), d + 1, d + 1))
        for i, j in pairs:
            a[:, i, j] = a[:, j, i] = p[f"a{i}_{j}"]
        return a, np.array([p[f"c{i}"] for i in range(d + 1)]).T, (~p[group].isna()).to_numpy()[:, None, None]

    def left(batches):
        import pandas as pd

        lhs, rhs = np.zeros((d + 1, d + 1)), np.zeros(d + 1)
        for p in batches:
            a, c, known = opened(p)
            own = np.linalg.solve(a[:, 1:, 1:] + penalty, np.concatenate([a[:, 1:, :], c[:, 1:, None]], 2)) * known
            lhs += (a - np.swapaxes(a[:, 1:, :], 1, 2) @ own[:, :, :-1]).sum(0)
            rhs += (c - (np.swapaxes(a[:, 1:, :], 1, 2) @ own[:, :, -1:])[:, :, 0]).sum(0)
        yield pd.DataFrame({"at": np.arange((d + 1) * (d + 2)), "v": np.concatenate([lhs.ravel(), rhs])})

    sums = {x["at"]: x["v"] for x in moments.mapInPandas(left, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
    v = np.array([sums.get(i, 0.0) for i in range((d + 1) * (d + 2))])
    lhs = v[: (d + 1) ** 2].reshape(d + 1, d + 1) + np.diag([0.0] + [alpha] * d)
    common = np.linalg.lstsq(lhs, v[(d + 1) ** 2 :], rcond=None)[0]

    def slopes(batches):
        import pandas as pd

        for p in batches:
            a, c, _ = opened(p)
            own = np.linalg.solve(a[:, 1:, 1:] + penalty, (c[:, 1:] - a[:, 1:, :] @ common)[:, :, None])[:, :, 0]
            yield pd.DataFrame({group: p[group], **{f"_g{i}": own[:, i] for i in range(d)}})

    own = moments.filter(F.col(group).isNotNull()).mapInPandas(slopes, ", ".join([f"`{group}` {train.schema[group].dataType.simpleString()}", *[f"_g{i} double" for i in range(d)]]))
    raw = F.col("_base") + float(common[0]) + sum((F.col(c) * (float(common[i + 1]) + F.coalesce(F.col(f"_g{i}"), F.lit(0.0))) for i, c in enumerate(feats)), F.lit(0.0))
    pred = test.join(own, group, "left").withColumn("pred", clip(raw, 0.0, 100.0))
    return pred.select(*test_columns, "pred")


def interaction_trees(train: DataFrame, test: DataFrame, feats: list[str], group: str, label: str, rounds: int = 300) -> float:
    """MAE on test of boosted trees on content and the group as a categorical feature, fitted to the residual over the group's mean; clipped to 0-100.

    Blocks hold whole groups, and the test rows go along with them: a split by groups needs no table of groups.  Up to ``boost.HELD`` rows are fitted by one task.
    Rows with gaps are left out.
    """
    import numpy as np

    spark = train.sparkSession
    train, test = group_base(complete(train, [*feats, label]), complete(test, [*feats, label]), group, label)
    rows = cut(train.withColumn("_w", F.lit(1)).unionByName(test.withColumn("_w", F.lit(0))).select(group, *feats, "_base", "_w", (F.col(label) - F.col("_base")).alias("_res")))
    edge = boost.edges(rows.filter("_w = 1"), feats)[0]
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FIT_ROWS))
    found = boost.grouped(rows, feats, ["_res", "_base"], "_w", group, edge, parts, FIT_ROWS).rdd.map(lambda row: boost.opened(row, len(feats), 2))
    model = boost.Model(0, 0, list(range(len(feats))), TREES["stepSize"], TREES["maxDepth"], group=True)

    def errors(blocks):
        out = np.zeros(2)
        for _, _, w, y, _, f in blocks:
            new = w[0] == 0
            out += new.sum(), np.abs(np.clip(y[1] + f[0], 0.0, 100.0) - (y[0] + y[1]))[new].sum()
        return {0: out}

    def alone(blocks):
        data = boost.Held(blocks)
        boost.boost(data, [model], rounds, last=True)
        return iter([data.over(errors)])

    if n <= boost.HELD:
        total = found.coalesce(1).mapPartitions(alone).collect()[0]
    else:
        data = boost.Spread(spark, found)
        boost.boost(data, [model], rounds, last=True)
        total = data.over(errors)
        data.close()
    return float(total[0][1] / total[0][0]) if total[0][0] else None


def mae(df: DataFrame, y: str, p: str) -> float:
    return df.agg(F.avg(F.abs(F.col(y) - F.col(p)))).first()[0]


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
