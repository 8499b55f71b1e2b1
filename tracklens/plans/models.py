"""Spark ML fits.  Each query returns a small table of held-out results or the predictions themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw_hex, r
from ..operators import boost, causal, metrics as E, models as M, splits
from ..session import cut, dropped, passing
from ..sources import tables as t
from . import sqlparts as S
from .joins import levels
from .metrics import pr, rd
from .registry import query
from .splits import RI

KEY = ["player", "item"]
CONTENT = ["x1", "x2"]
HIST = ["h_n_firstplays", "h_acc_mean", "h_acc_std", "h_fail_rate", "h_bp_mean", "h_days_span"]
ITERS = 12  # boosting rounds in the registered queries


def matrix(spark, sf):
    """(train, test) of the best results with the item axes; the log is joined and ranked once for both."""
    s = cut(splits.random_mask(t.best_rows(spark, sf).select(*KEY, "acc"), 0, 0.2).join(t.items(spark, sf).select("item", *CONTENT), "item"))
    return s.filter("not is_test").drop("is_test"), s.filter("is_test").drop("is_test")


def history_samples(spark, sf):
    """(train, test) first plays with causal history and item axes, split by each player's own time line."""
    fp, hot = t.samples(spark, sf), t.hot(spark, sf, "player")
    h = causal.phase(causal.history(fp, t.FP_ORDER, hot), hot)
    h = cut(h.select(*KEY, "ts", "seq", "acc", "lamp", "bp", "phase", "notes", *CONTENT, *HIST))
    return h.filter("phase = 'train'"), h.filter("phase = 'test'")


def table(spark, rows, schema):
    return spark.createDataFrame([tuple(round(v, 4) if isinstance(v, float) else v for v in x) for x in rows], schema)


STEPS = [5, 10, 15, 20, 25]  # iterations at which early stopping looks
DIMS, REGS = [2, 4, 8, 16, 32, 64], [0.3, 1.0, 3.0, 10.0, 30.0]


def inner_keys(spark, sf, train):
    return splits.per_player_quota(train, 0.1, 0, "ri_inner", t.hot(spark, sf, "player")).select(*KEY)


@query("mdl_mf_als")
def mdl_mf_als(spark, sf):
    """Iterations chosen by early stopping on the inner split, then one fit on all train rows."""
    tr, te = matrix(spark, sf)
    _, _, iters, _ = M.best_point(M.als_select(tr, inner_keys(spark, sf, tr), [8], [0.3], STEPS))
    p = M.als_predict(tr, te, rank=8, reg=0.3, iters=iters)
    return p.select(*KEY, "acc", r("additive_shrunk").alias("bias_pred"), r("mf", 3).alias("mf_pred"))


@query("mdl_mf_select")
def mdl_mf_select(spark, sf):
    """Trace of the whole grid on the inner split, one row for each fit; ``chosen`` marks the frozen parameters."""
    tr, _ = matrix(spark, sf)
    trace = M.als_select(tr, inner_keys(spark, sf, tr), DIMS, REGS, STEPS)
    best = M.best_point(trace)
    return table(spark, [(*x, x == best) for x in trace], "rank int, reg double, iterations int, inner_mae double, chosen boolean")


GATE_SEEDS = [0, 1, 2]
GATE_LOO = [1, 5, 10]
GATE_MODELS = ["mf", "additive", "additive_shrunk"]  # the model, the gate, the regularised bias


def gate_errors(spark, sf):
    """``seed_errors`` of a factorisation fitted for every split and seed, of large tables one after the other; what a fit has written goes at its end."""
    best = cut(t.best_rows(spark, sf).select(*KEY, "acc"))

    def held(split, seed):
        if split == "random_interaction":
            return splits.random_mask(best, seed, 0.2).filter("is_test").select(*KEY), KEY
        if split == "cold_player":
            return splits.cold_groups(best, "player", 0.1, seed, "cold_player"), ["player"]
        return splits.leave_k_out(best, int(split.split("_")[1]), seed), KEY

    def one(point):
        split, seed = point
        with passing(spark) as keep:
            keys, on = held(split, seed)
            keys = cut(keys)
            frames = M.Factors(best.join(keys, on, "left_anti"), best.join(keys, on, "left_semi"), "acc")
            p = cut(frames.predict(rank=8, reg=0.3, iters=10, seed=seed).select(F.lit(split).alias("split"), F.lit(seed).alias("seed"), "player", "acc", *GATE_MODELS))
            keep.append(cut(E.seed_errors(p, "acc", GATE_MODELS)))
        return keep[0]

    points = [(s, seed) for s in ["random_interaction", *[f"loo_{k}" for k in GATE_LOO], "cold_player"] for seed in GATE_SEEDS]
    out = M.side_by_side(spark, one, points, 1 if best.count() * 8 > M.LARGE else 4)
    dropped(spark, best)
    return reduce(DataFrame.unionByName, out)


@query("evl_gate_m3")
def evl_gate_m3(spark, sf):
    """The factorisation against the additive gate on every split over the seeds, with reasons, and what its latent part adds to the shrunk bias."""
    return rd(E.gate_table(gate_errors(spark, sf), *GATE_MODELS), 6)


# ridge on two standardised axes, written out
RIDGE = f"""WITH {S.BEST}, {S.ITEMS}, d AS (SELECT best.*, x1, x2, {RI} AS is_test FROM best JOIN items USING (item)), tr AS (SELECT * FROM d WHERE NOT is_test), mu AS (SELECT avg(acc) AS mu, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2 FROM tr),
 pe AS (SELECT player, avg(acc) AS mp FROM tr GROUP BY player), z AS (SELECT d.*, mu, coalesce(mp - mu, 0) AS off, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM d LEFT JOIN pe USING (player), mu),
 s AS (SELECT count(*) AS n, covar_pop(z1, z2) AS c, covar_pop(z1, acc - mu - off) AS a, covar_pop(z2, acc - mu - off) AS b, avg(acc - mu - off) AS i FROM z WHERE NOT is_test),
 w AS (SELECT *, ((n + 5.0) * n * a - n * c * n * b) / ((n + 5.0) ** 2 - (n * c) ** 2) AS b1, ((n + 5.0) * n * b - n * c * n * a) / ((n + 5.0) ** 2 - (n * c) ** 2) AS b2 FROM s)
 SELECT player, item, round(least(greatest(mu + off + i + b1 * z1 + b2 * z2, 0), 100), 4) AS pred FROM z, w WHERE is_test"""


@query("mdl_content_ridge", RIDGE)
def mdl_content_ridge(spark, sf):
    tr, te = matrix(spark, sf)
    return M.content_ridge(tr, te, CONTENT, "acc", alpha=5.0).select(*KEY, r("pred", 4).alias("pred"))


@query("mdl_gbt")
def mdl_gbt(spark, sf):
    tr, te = history_samples(spark, sf)
    return M.fit_predict(tr, te, CONTENT + HIST, "acc", M.gbt(ITERS)).select(*KEY, "acc", r("pred", 3).alias("pred"))


def heads(tr, te, feats, iters=ITERS):
    """acc, ordinal lamp and log1p(bp) heads, grown side by side."""
    labels = {"_y_acc": F.col("acc").cast("double"), "_y_lamp": F.col("lamp").cast("double"), "_y_bp": F.log1p(F.col("bp").cast("double"))}
    own = [boost.Model(0, j, list(range(len(feats)))) for j in range(len(labels))]
    edge = boost.fit(tr.withColumns(labels), feats, list(labels), own, iters)
    p = te.withColumn("_p", boost.predictions(feats, own, edge))
    return p.select(*te.columns, F.col("_p.p0").alias("p_acc"), F.col("_p.p1").alias("p_lamp"), F.expm1(M.clip(F.col("_p.p2"), 0.0, 12.0)).alias("p_bp"))


@query("mdl_three_heads")
def mdl_three_heads(spark, sf):
    tr, te = history_samples(spark, sf)
    p = heads(tr, te, CONTENT + HIST)
    return p.select(*KEY, r("p_acc", 3).alias("p_acc"), r("p_lamp", 3).alias("p_lamp"), r("p_bp", 3).alias("p_bp"))


@query("mdl_lamp_class")
def mdl_lamp_class(spark, sf):
    tr, te = history_samples(spark, sf)
    cls = M.classify(tr, te, CONTENT + HIST, "lamp", RandomForestClassifier(numTrees=10, maxDepth=5, seed=0), out="class")
    both = M.fit_predict(tr, cls, CONTENT + HIST, "lamp", M.gbt(ITERS), out="reg")
    k = F.rint(M.clip(F.col("reg"), 0.0, 8.0))
    res = both.agg(F.avg((F.col("class") == F.col("lamp")).cast("int")).alias("ca"), F.avg(F.abs(F.col("class") - F.col("lamp"))).alias("cm"), F.avg((k == F.col("lamp")).cast("int")).alias("ra"), F.avg(F.abs(k - F.col("lamp"))).alias("rm"))
    rows = F.array(F.struct(F.lit("classes").alias("model"), r("ca", 4).alias("accuracy"), r("cm", 4).alias("ord_mae")), F.struct(F.lit("regression").alias("model"), r("ra", 4).alias("accuracy"), r("rm", 4).alias("ord_mae")))
    return res.select(F.inline(rows))


@query("mdl_bp_tracks")
def mdl_bp_tracks(spark, sf):
    """raw / ratio x plain / log1p, every track scored on both scales."""
    tr, te = history_samples(spark, sf)
    tr, te = tr.withColumn("ratio", F.col("bp") / F.col("notes")), te.withColumn("ratio", F.col("bp") / F.col("notes"))
    out = te
    log = (F.log1p, F.expm1)
    for y in ("bp", "ratio"):
        for name, tf in (("plain", None), ("log1p", log)):
            out = M.fit_predict(tr, out, CONTENT + HIST, y, M.gbt(6), out=f"{y}_{name}", transform=tf)
    tracks = [f"{y}_{n}" for y in ("bp", "ratio") for n in ("plain", "log1p")]
    raw = {k: (F.col(k) if k.startswith("bp") else F.col(k) * F.col("notes")) for k in tracks}
    res = out.agg(*[F.avg(F.abs(F.col("bp") - raw[k])).alias(f"a_{k}") for k in tracks], *[F.avg(F.abs(F.col("ratio") - raw[k] / F.col("notes"))).alias(f"b_{k}") for k in tracks])
    return res.select(F.inline(F.array(*[F.struct(F.lit(k).alias("track"), r(f"a_{k}", 4).alias("mae_bp"), r(f"b_{k}", 4).alias("mae_ratio")) for k in tracks])))


@query("mdl_fail_logit")
def mdl_fail_logit(spark, sf):
    tr, te = history_samples(spark, sf)
    f = (F.col("lamp") == 1).cast("int")
    p = M.classify(tr.withColumn("fail", f), te.withColumn("fail", f), CONTENT + HIST, "fail", LogisticRegression(maxIter=2000, regParam=1 / (0.5 * max(1, tr.count()))), scale=True)  # penalty of the survey: C = 0.5 on the sum of losses
    return p.select(*KEY, "fail", r("prob", 4).alias("prob"))


@query("mdl_pass_prob")
def mdl_pass_prob(spark, sf):
    tr, te = history_samples(spark, sf)
    f = (F.col("lamp") >= 4).cast("int")
    p = M.classify(tr.withColumn("ok", f), te.withColumn("ok", f), CONTENT + HIST, "ok", GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.06, seed=0))
    return p.select(*KEY, "ok", r("prob", 4).alias("prob"))


@query("mdl_isotonic")
def mdl_isotonic(spark, sf):
    p = cut(pr(spark, sf).withColumn("is_cal", draw_hex("cal", F.col("player"), F.col("item")) < "80000000"))
    out = M.isotonic(p.filter("is_cal"), p.filter("not is_cal"), "pred", "lamp", 0.0, 8.0)
    return out.select(*KEY, "lamp", r("pred", 4).alias("pred"), r("iso", 4).alias("iso"), "iso_grid")


@query("mdl_residual_target")
def mdl_residual_target(spark, sf):
    """Fit the deviation from a causal offset and add it back; two offsets."""
    tr, te = history_samples(spark, sf)
    mu = tr.agg(F.avg("acc")).first()[0]
    rows = []
    for name, off in (("player_prior", F.coalesce("h_acc_mean", F.lit(mu))), ("global", F.lit(mu))):
        a, b = tr.withColumn("off", off).withColumn("dev", F.col("acc") - off), te.withColumn("off", off)
        p = M.fit_predict(a, b, CONTENT + HIST, "dev", M.gbt(ITERS), out="d").withColumn("pred", F.col("off") + F.col("d"))
        rows.append((name, M.mae(b, "acc", "off"), M.mae(p, "acc", "pred")))
    return table(spark, rows, "offset string, offset_mae double, model_mae double")


@query("mdl_upweight")
def mdl_upweight(spark, sf):
    tr, te = history_samples(spark, sf)
    reg = F.when(F.col("notes") >= 40, "top").otherwise("rest")
    tr, te = tr.withColumn("region", reg).withColumn("w", F.when(F.col("notes") >= 40, 4.0).otherwise(1.0)), te.withColumn("region", reg)
    p = M.fit_predict(tr, M.fit_predict(tr, te, CONTENT + HIST, "acc", M.gbt(ITERS), out="plain"), CONTENT + HIST, "acc", M.gbt(ITERS, weight="w"), out="weighted")
    return p.groupBy("region").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("acc") - F.col("plain"))), 4).alias("mae_plain"), r(F.avg(F.abs(F.col("acc") - F.col("weighted"))), 4).alias("mae_weighted"))


@query("mdl_item_difficulty", f"""WITH {S.BEST}, tr AS (SELECT * FROM best WHERE NOT {RI}), pm AS (SELECT player, avg(acc) AS m FROM tr GROUP BY player)
 SELECT item, count(*) AS n_raters, round(avg(acc - m), 4) AS mean_resid, round(avg(m), 4) AS mean_skill FROM tr JOIN pm USING (player) GROUP BY item""")
def mdl_item_difficulty(spark, sf):
    tr = splits.random_mask(t.best_rows(spark, sf), 0, 0.2).filter("not is_test")
    return rd(M.difficulty_frame(tr))


@query("mdl_interaction")
def mdl_interaction(spark, sf):
    """Content x player on the held-out cells: ridge on one-hot blocks, and trees with the player as a category; both on the residual over the player's mean."""
    tr, te = matrix(spark, sf)
    rows = [("linear", M.mae(M.interaction_predict(tr, te, CONTENT, "player", "acc"), "acc", "pred")), ("trees", M.interaction_trees(tr, te, CONTENT, "player", "acc", M.TREES["maxIter"]))]
    return table(spark, rows, "model string, mae double")
