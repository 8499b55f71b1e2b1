"""Evaluation: error, within-player and rank metrics, calibration, conformal bands, controls, verdicts.

Prediction frames carry (player, item, y, pred).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw, draw_long
from ..session import cut
from . import ranks, skew

def error_aggs() -> list[Column]:
    e = F.col("pred") - F.col("y")
    return [F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
            (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count(F.lit(1)))).alias("r2")]


def basic(pr: DataFrame) -> DataFrame:
    pr = cut(pr.select("y", "pred"))
    med = ranks.quantiles(pr.select(F.abs(F.col("pred") - F.col("y")).alias("ae")), [], "ae", {"medae": 0.5})
    return pr.agg(*error_aggs()).withColumn("medae", med.scalar())


def centred(pr: DataFrame) -> DataFrame:
    """Adds dy, dp (each minus its own player test mean) and dpy (pred minus the player's actual mean)."""
    m = pr.groupBy("player").agg(F.avg("y").alias("_my"), F.avg("pred").alias("_mp"))
    return pr.join(m, "player").select(*pr.columns, (F.col("y") - F.col("_my")).alias("dy"), (F.col("pred") - F.col("_mp")).alias("dp"), (F.col("pred") - F.col("_my")).alias("dpy"))


def centred_r2(pr: DataFrame) -> DataFrame:
    c = centred(pr)
    e = F.col("dy") - F.col("dpy")
    return c.agg((F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop("dy") * F.count(F.lit(1)))).alias("centred_r2"))


def centred_errors(pr: DataFrame) -> DataFrame:
    e = F.col("dp") - F.col("dy")
    return centred(pr).agg(F.avg(F.abs(e)).alias("centred_mae"), F.sqrt(F.avg(e * e)).alias("centred_rmse"))


def kappa(df: DataFrame, y: str, p: str, lo: int = 1, hi: int = 9) -> DataFrame:
    """Quadratic weighted kappa from the confusion counts (at most (hi - lo + 1)^2 rows)."""
    c = df.select(F.col(y).cast("double").alias("a"), F.least(F.greatest(F.rint(F.col(p)), F.lit(float(lo))), F.lit(float(hi))).alias("b"))
    cells = c.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    s = cells.agg(F.sum(n).alias("N"), F.sum(n * (a - b) * (a - b)).alias("o"), F.sum(n * a).alias("a1"), F.sum(n * b).alias("b1"), F.sum(n * a * a).alias("a2"), F.sum(n * b * b).alias("b2"))
    # expected disagreement under independence: E(a^2) + E(b^2) - 2 E(a) E(b)
    exp = (F.col("a2") + F.col("b2")) / F.col("N") - 2 * F.col("a1") * F.col("b1") / F.col("N") / F.col("N")
    return s.select((F.lit(1.0) - F.try_divide(F.col("o") / F.col("N"), exp)).alias("qwk"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact rank-sum AUC over distinct scores."""
    c = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    run = skew.global_prefix(c, [score], {"below": ("sum", F.col("neg"))})
    s = run.agg(F.sum(F.col("pos") * (F.coalesce("below", F.lit(0)) + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return s.select((F.col("u") / (F.col("p") * F.col("q"))).alias("auc"))


def edge_bins(df: DataFrame, value: str, n: int, right_closed: bool) -> DataFrame:
    """Bin index from the n-quantile edges of ``value`` (edges: one small row)."""
    df, probs = cut(df), {f"e{i}": i / n for i in range(1, n)}
    edges = ranks.quantiles(df, [], value, probs)
    out = df.withColumn("_edges", edges.select(F.struct(*probs)).scalar())
    v = F.col(value)
    hits = sum((((v > F.col(f"_edges.{e}")) if right_closed else (v >= F.col(f"_edges.{e}"))).cast("int") for e in probs), F.lit(0))
    return out.withColumn("bin", hits).drop("_edges")


def calibration(pr: DataFrame, n: int = 10, within: float = 5.0) -> DataFrame:
    return edge_bins(pr, "pred", n, False).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pred").alias("pred_mean"), F.avg("y").alias("actual_mean"),
        (F.avg("pred") - F.avg("y")).alias("gap"), F.avg((F.abs(F.col("pred") - F.col("y")) <= within).cast("int")).alias("frac_within"))


def conformal(cal: DataFrame, test: DataFrame, lo: str = "lo", hi: str = "hi", level: float = 0.8) -> DataFrame:
    """Correction Q from the calibration rows; coverage and widths of the widened band on the test rows."""
    score = cal.select(F.greatest(F.col(lo) - F.col("y"), F.col("y") - F.col(hi)).alias("s"))
    def at(n):
        return F.least(F.lit(1.0), F.ceil((n + 1) * level) / n)

    q = ranks.quantiles(score, [], "s", {"q": at}).scalar()
    t = test.withColumn("q", q)
    inside = (F.col("y") >= F.col(lo) - F.col("q")) & (F.col("y") <= F.col(hi) + F.col("q"))
    return t.agg(F.first("q").alias("q"), F.avg(inside.cast("int")).alias("coverage"), F.avg(F.col(hi) - F.col(lo) + 2 * F.col("q")).alias("mean_width"))


def ranking(pr: DataFrame, ks=(5, 10, 20), min_n: int = 5) -> DataFrame:
    """precision@k and NDCG@k per player (players with at least ``min_n`` rows).

    Two bounded top-k selections per player (by prediction, by actual), each pruned map-side.
    """
    kmax = max(ks)
    n = pr.groupBy("player").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)
    bp = ranks.top_n(pr.select("player", "item", "y", "pred"), ["player"], [F.desc("pred"), "item"], kmax, "rp")
    by = ranks.top_n(pr.select("player", "item", F.col("y").alias("y2")), ["player"], [F.desc("y2"), "item"], kmax, "ry")
    j = bp.join(by, ["player", "item"], "full").join(n, "player")
    aggs = []
    for k in ks:
        kk = F.least(F.lit(k), F.max("n"))
        both = F.count(F.when((F.col("rp") <= k) & (F.col("ry") <= k), 1))
        dcg = F.sum(F.when(F.col("rp") <= k, F.col("y") / F.log2(F.col("rp") + 1)))
        idcg = F.sum(F.when(F.col("ry") <= k, F.col("y2") / F.log2(F.col("ry") + 1)))
        aggs += [(both / kk).alias(f"precision_{k}"), F.when(idcg > 0, dcg / idcg).alias(f"ndcg_{k}")]
    return j.groupBy("player").agg(F.max("n").alias("n"), *aggs)


def over_players(per: DataFrame, cols: list[str]) -> DataFrame:
    """mean / median / min / max over players per metric; metric rows, not player rows, leave this step."""
    from .audit import long_form

    lf = long_form(cut(per), [], cols, "metric", "value").filter("value is not null")
    med = ranks.quantiles(lf, ["metric"], "value", {"median": 0.5}, "auto")
    return lf.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n_players")).join(med, "metric")


def weighted_average(per: DataFrame, value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def repair(df: DataFrame, cols: list[str], seed: str, key: list[str]) -> DataFrame:
    """Permutation control: ``cols`` move to other rows (two independent draw orders, joined by position)."""
    k = [F.col(c) for c in key]
    a = skew.global_prefix(df.withColumn("_u", draw_long(f"{seed}a", *k)), ["_u", *key], {"_i": ("rank",)}).drop("_u", *cols)
    b = skew.global_prefix(df.select(*key, *cols).withColumn("_u", draw_long(f"{seed}b", *k)), ["_u", *key], {"_i": ("rank",)}).select("_i", *cols)
    return a.join(b, "_i").drop("_i")


def ols(df: DataFrame, x: str, y: str) -> tuple[Column, Column]:
    """(slope, intercept) of y on x as scalar subqueries."""
    s = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    return s.select("b").scalar(), s.select("a").scalar()


# fixed values: cumulative Poisson(1) probabilities, as far as doubles tell them from 1
POISSON1 = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119,
    0.9999898050034682, 0.9999988747979402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892, 0.9999999999364022, 0.9999999999954802,
]
BOOT_PRIME, BOOT_ROOT = 2**31 - 1, 48271


def replicate_factors(replicates: int) -> list[int]:
    """Powers of a root of the prime: a row's one draw times a factor is its draw in that replicate."""
    out = [BOOT_ROOT]
    while len(out) < replicates:
        out.append(out[-1] * BOOT_ROOT % BOOT_PRIME)
    return out[:replicates]


def paired_bootstrap(df: DataFrame, diff: str, replicates: int, key: list[str], seed: str = "boot") -> DataFrame:
    """Mean gain, t and percentile interval of a paired difference.

    Poisson bootstrap: a row draws once, and its weight in each replicate is arithmetic on that draw.  Batches of rows give
    two weighted sums for each replicate, which add up; rows are neither resampled nor copied.
    """
    import numpy as np
    import pandas as pd

    factors = np.array(replicate_factors(replicates), np.int64)
    edges = np.array(POISSON1) * BOOT_PRIME

    def sums(batches):
        top, low = np.zeros(replicates), np.zeros(replicates)
        for pdf in batches:
            for s in range(0, len(pdf), 512):
                u, d = pdf["_u"].to_numpy(np.int64)[s : s + 512], pdf["_d"].to_numpy(float)[s : s + 512]
                w = np.searchsorted(edges, (u[:, None] * factors[None, :]) % BOOT_PRIME, "right")
                top, low = top + d @ w, low + w.sum(0)
        yield pd.DataFrame({"b": np.arange(replicates), "top": top, "low": low})

    drawn = df.filter(F.col(diff).isNotNull()).select((draw_long(seed, *[F.col(c) for c in key]) % (BOOT_PRIME - 1) + 1).alias("_u"), F.col(diff).cast("double").alias("_d"))
    means = drawn.mapInPandas(sums, "b int, top double, low double").groupBy("b").agg((F.sum("top") / F.sum("low")).alias("m"))
    d = F.col(diff)
    plain = df.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("gain"), F.stddev_samp(d).alias("sd"), F.avg((d > 0).cast("int")).alias("helped"))
    lo, hi = (means.agg(F.percentile("m", q)).scalar() for q in (0.025, 0.975))
    return plain.select("n", "gain", (F.col("gain") / (F.col("sd") / F.sqrt("n"))).alias("t"), lo.alias("ci_lo"), hi.alias("ci_hi"), "helped")


def across_seeds(long: DataFrame) -> DataFrame:
    """(model, metric) -> mean, sample std, n and the sorted values over seeds."""
    return long.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n_seeds"), F.min("value").alias("best_lo"), F.max("value").alias("best_hi"))


def stable_gain(summary: DataFrame, challenger: str, reference: str) -> DataFrame:
    """Gain per metric and whether it is stable: every seed beats the reference mean and gain > challenger std."""
    c = summary.filter(F.col("model") == challenger).select("metric", F.col("mean").alias("challenger"), F.col("std").alias("challenger_std"), "best_lo", "best_hi")
    ref = summary.filter(F.col("model") == reference).select("metric", F.col("mean").alias("reference"))
    lower = F.col("metric").contains("mae")
    gain = F.when(lower, F.col("reference") - F.col("challenger")).otherwise(F.col("challenger") - F.col("reference"))
    wins = F.when(lower, F.col("best_hi") < F.col("reference")).otherwise(F.col("best_lo") > F.col("reference"))
    out = c.join(ref, "metric").withColumn("gain", gain).withColumn("all_seeds_win", wins)
    return out.withColumn("gain_exceeds_std", F.col("gain") > F.col("challenger_std")).withColumn("stable_win", F.col("all_seeds_win") & F.col("gain_exceeds_std")).drop("best_lo", "best_hi")


def seed_errors(pred: DataFrame, y: str, models: list[str]) -> DataFrame:
    """(split, seed, model, metric, value) of predictions (split, seed, player, ``y``, one column a model).

    mae, and the centred MAE (actual and predicted value each less its player's mean), which is NULL where no player has two rows.
    """
    by = ["split", "seed"]
    known = pred.filter(F.col(y).isNotNull())
    means = known.groupBy(*by, "player").agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_y"), *[F.avg(m).alias(f"_p{i}") for i, m in enumerate(models)])
    j = known.join(means, [*by, "player"])
    within = [F.when(F.max("_n") > 1, F.avg(F.abs((F.col(y) - F.col("_y")) - (F.col(m) - F.col(f"_p{i}"))))) for i, m in enumerate(models)]
    wide = j.groupBy(*by).agg(*[F.avg(F.abs(F.col(y) - F.col(m))).alias(f"mae{i}") for i, m in enumerate(models)], *[w.alias(f"centred_mae{i}") for i, w in enumerate(within)])
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("metric"), F.col(f"{k}{i}").alias("value")) for i, m in enumerate(models) for k in ("mae", "centred_mae")])
    return wide.select(*by, F.explode(rows).alias("s")).select(*by, "s.*")


def gate_table(errors: DataFrame, model: str, gate: str, bias: str, cold: tuple[str, ...] = ("cold_player",)) -> DataFrame:
    """One row a split from ``seed_errors``: does ``model`` win over ``gate``, and is it more than the regularised ``bias``?

    A win is stable when every seed beats the gate's mean and the gain exceeds the model's spread over seeds.  A warm split passes when
    all its metrics are stable wins; a metric that is NULL on a split is no part of it, and ``note`` says so.  A cold
    split passes when the model is not worse than the gate.  ``latent_gain`` is the bias's MAE less the model's.
    """
    s = errors.groupBy("split", "model", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.max("value").alias("worst"), F.countDistinct("seed").alias("n_seeds"))

    def at(who, metric, what):
        return F.max(F.when((F.col("model") == who) & (F.col("metric") == metric), F.col(what)))

    wide = s.groupBy("split").agg(
        F.max("n_seeds").alias("n_seeds"), at(model, "mae", "mean").alias("mae"), at(gate, "mae", "mean").alias("gate_mae"), at(model, "mae", "std").alias("seed_std"), at(model, "mae", "worst").alias("_w"),
        at(model, "centred_mae", "mean").alias("centred_mae"), at(gate, "centred_mae", "mean").alias("gate_centred_mae"), at(model, "centred_mae", "std").alias("_cs"), at(model, "centred_mae", "worst").alias("_cw"),
        at(bias, "mae", "mean").alias("bias_mae"))
    stable = (F.col("_w") < F.col("gate_mae")) & (F.col("gate_mae") - F.col("mae") > F.col("seed_std"))
    within = (F.col("_cw") < F.col("gate_centred_mae")) & (F.col("gate_centred_mae") - F.col("centred_mae") > F.col("_cs"))
    is_cold, degenerate = F.col("split").isin(*cold), F.col("centred_mae").isNull()
    not_worse = F.col("mae") <= F.col("gate_mae") + 1e-9
    reasons = F.array_compact(F.array(
        F.when(is_cold & ~not_worse, "worse than the gate"), F.when(~is_cold & ~stable, "mae: no stable win"), F.when(~is_cold & ~degenerate & ~within, "centred_mae: no stable win")))
    out = wide.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("latent_gain", F.col("bias_mae") - F.col("mae"))
    note = F.when(degenerate, "one test row per player: no within-player metrics").when(is_cold, "no train rows of the player: only the item effect is left")
    return out.select("split", "n_seeds", "mae", "gate_mae", "centred_mae", "gate_centred_mae", "bias_mae", (F.col("reasons") == "").alias("passed"), "reasons", "latent_gain",
                      (F.col("latent_gain") > F.col("seed_std")).alias("latent_helps"), note.alias("note"))
