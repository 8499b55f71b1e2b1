"""Transfer to players that the models have not seen, and tuning with the test rows read once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r
from ..operators import baselines, causal, models as M, splits, transfer as T
from ..session import cut
from ..sources import tables as t
from . import sqlparts as S
from .registry import query

KEY = ["player", "item"]
CONTENT = ["x1", "x2"]
FOLDS = 3       # folds of whole players
ROUNDS = 12     # boosting rounds of the registered query
HEADS = {
    "acc": ("acc", lambda c: c, lambda c: c),
    "lamp": ("lamp", lambda c: c, lambda c: c),
    "bp": ("bp", F.log1p, lambda c: F.expm1(M.clip(c, 0.0, 12.0))),
}
MODELS = {"m0": (CONTENT, False), "m2": (CONTENT + T.HIST, True)}


def transfer_frames(spark, sf):
    """(rows with causal history, targets of every prefix size); the targets' k is NULL where the whole causal history is used."""
    fp, hot = t.samples(spark, sf), t.hot(spark, sf, "player")
    cols = [*KEY, "client", "ts", "seq", "acc", "lamp", "bp", *CONTENT, *T.HIST]
    num = {c: F.col(c).cast("double") for c in CONTENT + T.HIST}
    h = causal.history(fp, t.FP_ORDER, hot).join(t.clients(spark, sf).select("player", "client"), "player", "left")
    rows = cut(h.select(*cols).withColumns(num).withColumn("fold", splits.fold(FOLDS, 0, "player", salt="transfer")).dropna(subset=CONTENT))
    few = T.few_shot(rows, t.FP_ORDER)
    whole = rows.withColumn("k", F.lit(None).cast("int"))
    return rows, few.select(*whole.columns).unionByName(whole)


def own_history(rows, targets, folds):
    """M1: the player's own means; where there are none, those of the players of the other folds."""
    heads = {"acc": "h_acc_mean", "bp": "h_bp_mean"}
    other = None
    for k in range(folds):
        m = rows.filter(F.col("fold") != k).agg(F.lit(k).cast("long").alias("fold"), *[F.avg(h).alias(f"_mu_{h}") for h in heads])
        other = m if other is None else other.unionByName(m)
    return targets.join(F.broadcast(other), "fold").withColumns({f"m1_{h}": F.coalesce(F.col(c), F.col(f"_mu_{h}")) for h, c in heads.items()}).drop(*[f"_mu_{h}" for h in heads])


@query("mdl_transfer")
def mdl_transfer(spark, sf):
    """Errors on players of a held-out fold by prefix size (NULL: whole causal history) and client: M0 item only, M1 own history only, M2 both."""
    rows, targets = transfer_frames(spark, sf)
    pred = T.unseen_players(rows, own_history(rows, targets, FOLDS), "fold", FOLDS, HEADS, MODELS, ROUNDS)
    pred = pred.withColumn("m1_lamp", F.col("m1_acc") / 100 * 6)  # the survey's scale from a mean result to a lamp
    curve = T.error_curve(pred, "client", {h: x[0] for h, x in HEADS.items()}, ["m0", "m1", "m2"])
    return curve.select("client", "k", "n_eval", "n_players", *[r(f"{m}_{h}", 4).alias(f"mae_{m}_{h}") for h in HEADS for m in ("m0", "m1", "m2")])


STATE = f"""WITH {S.SAMPLES}, ok AS (SELECT * FROM smp WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS rk FROM ok),
 c AS (SELECT player, least(count(*), 350) AS n FROM rk GROUP BY player), ks AS (SELECT unnest([0, 1, 5, 10, 20, 50, 100, 200]) AS k),
 pk AS (SELECT player, k FROM c, ks WHERE k < n - 1)
 SELECT player, k, count(*) FILTER (WHERE rk.rk > k) AS n_target, round(avg(acc) FILTER (WHERE rk.rk <= k), 4) AS acc_mean,
 round(CASE WHEN k > 1 THEN stddev_pop(acc) FILTER (WHERE rk.rk <= k) END, 4) AS acc_std, round(avg(CAST(lamp = 1 AS INT)) FILTER (WHERE rk.rk <= k), 4) AS fail_rate,
 round(avg(bp) FILTER (WHERE rk.rk <= k), 4) AS bp_mean, round(avg(ts) FILTER (WHERE rk.rk > k) / 86400 - min(ts) FILTER (WHERE rk.rk <= k) / 86400, 4) AS mean_days_span
 FROM pk JOIN rk USING (player) WHERE rk.rk <= k + 150 GROUP BY player, k"""


@query("mdl_transfer_prefix", STATE)
def mdl_transfer_prefix(spark, sf):
    """What the few-shot rows of every player and prefix size hold: history of the prefix alone, and its targets."""
    fp = t.samples(spark, sf).dropna(subset=CONTENT)
    g = T.few_shot(fp, t.FP_ORDER).groupBy("player", "k")
    names = {"acc_mean": "h_acc_mean", "acc_std": "h_acc_std", "fail_rate": "h_fail_rate", "bp_mean": "h_bp_mean"}
    return g.agg(F.count(F.lit(1)).alias("n_target"), *[r(F.max(c), 4).alias(n) for n, c in names.items()], r(F.avg("h_days_span"), 4).alias("mean_days_span"))


# the survey's grid but for the rounds, which are 200 and 400 there
GRID = dict(stepSize=[0.04, 0.08], maxDepth=[2, 3, 6], minInstancesPerNode=[20, 50])
GRID_ROUNDS = [10, 20]
INNER_FOLDS = 3
UNTUNED = dict(stepSize=0.06, maxDepth=3, minInstancesPerNode=20)
UNTUNED_ROUNDS = 15


def item_frames(spark, sf, seed=0):
    """(train items with their mean residual over player means, test rows with that base and the item's axes); test items are unseen in training."""
    best = cut(t.best_rows(spark, sf).join(t.items(spark, sf).select("item", *CONTENT), "item").dropna(subset=CONTENT).select(*KEY, "acc", *CONTENT))
    held = cut(splits.cold_groups(best, "item", 0.2, seed, "cold_item"))
    train, test = best.join(held, "item", "left_anti"), best.join(held, "item", "left_semi")
    mu, (means,) = baselines.effects(train, ["player"], "acc")
    means = means.select("player", "m_player")
    items = train.join(means, "player").groupBy("item", *CONTENT).agg(F.avg(F.col("acc") - F.col("m_player")).alias("resid"))
    base = test.join(means, "player", "left").withColumn("base", F.coalesce("m_player", mu.scalar())).drop("m_player")
    return items, base


@query("mdl_tune_nested")
def mdl_tune_nested(spark, sf):
    """The whole grid on inner folds of the train items; the test rows are read once, with the chosen and the untuned settings."""
    items, base = item_frames(spark, sf)
    trace = M.boost_select(items.withColumn("fold", splits.fold(INNER_FOLDS, 0, "item", salt="inner")), CONTENT, "resid", "fold", INNER_FOLDS, GRID, GRID_ROUNDS)
    best = min(trace, key=lambda x: x[-1])
    names = list(GRID)
    base = cut(base)
    bias = M.mae(base, "acc", "base")

    def tested(point):
        rounds, setting = point
        p = M.fit_predict(items, base, CONTENT, "resid", M.gbt(rounds).setParams(**setting), impute=False, out="d")
        return M.mae(p.withColumn("pred", M.clip(F.col("base") + F.col("d"), 0.0, 100.0)), "acc", "pred")

    tuned, untuned = M.side_by_side(spark, tested, [(best[0], dict(zip(names, best[1:-1]))), (UNTUNED_ROUNDS, UNTUNED)])
    rows = [("grid", *x, x is best, tuned if x is best else None, bias if x is best else None) for x in trace]
    rows.append(("untuned", UNTUNED_ROUNDS, *UNTUNED.values(), None, False, untuned, bias))
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in rows]
    return spark.createDataFrame(rows, "role string, rounds int, step double, max_depth int, min_rows int, inner_mae double, chosen boolean, test_mae double, player_mean_mae double")
