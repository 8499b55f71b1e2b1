"""Evaluation metrics, controls and verdicts on the additive baseline's held-out predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import draw_hex, r
from ..operators import baselines, metrics as M, ranks, skew, splits
from ..session import cut
from ..sources import tables as t
from . import sqlparts as S
from .joins import LV, levels
from .registry import query
from .splits import RI

KEY = ["player", "item"]

PRED = f"""{S.BEST}, spl AS (SELECT *, {RI} AS is_test FROM best), mu AS (SELECT avg(acc) AS mu FROM spl WHERE NOT is_test),
 pe AS (SELECT player, avg(acc) AS mp, count(*) AS np FROM spl WHERE NOT is_test GROUP BY player), ie AS (SELECT item, avg(acc) AS mi, count(*) AS ni FROM spl WHERE NOT is_test GROUP BY item),
 prd AS (SELECT player, item, acc AS y, lamp, mu AS global_mean, mu + coalesce(mp - mu, 0) AS player_mean, mu + coalesce(mi - mu, 0) AS item_mean, mu + coalesce(mp - mu, 0) + coalesce(mi - mu, 0) AS additive,
 mu + coalesce(mp - mu, 0) * (coalesce(np, 0) / (coalesce(np, 0) + 10.0)) + coalesce(mi - mu, 0) * (coalesce(ni, 0) / (coalesce(ni, 0) + 10.0)) AS additive_shrunk
 FROM spl LEFT JOIN pe USING (player) LEFT JOIN ie USING (item), mu WHERE is_test), pr AS (SELECT player, item, y, lamp, round(additive, 6) AS pred, round(additive_shrunk, 6) AS pred2 FROM prd)"""


def predictions(spark, sf):
    s = cut(splits.random_mask(t.best_rows(spark, sf).select(*KEY, "acc", "lamp"), 0, 0.2))  # read five times
    return baselines.predict(s.filter("not is_test"), s.filter("is_test"))


def pr(spark, sf):
    return predictions(spark, sf).select(*KEY, F.col("acc").alias("y"), "lamp", r("additive").alias("pred"), r("additive_shrunk").alias("pred2"))


def rd(df, digits=4, keep=()):
    return df.select(*[r(c, digits).alias(c) if ty == "double" and c not in keep else F.col(c) for c, ty in df.dtypes])


@query("mdl_bias", f"WITH {PRED} SELECT player, item, round(global_mean, 6) AS global_mean, round(player_mean, 6) AS player_mean, round(item_mean, 6) AS item_mean, round(additive, 6) AS additive FROM prd")
def mdl_bias(spark, sf):
    return predictions(spark, sf).select(*KEY, *[r(m).alias(m) for m in baselines.MODELS[:4]])


@query("mdl_bias_shrunk", f"WITH {PRED} SELECT player, item, round(additive_shrunk, 6) AS additive_shrunk FROM prd")
def mdl_bias_shrunk(spark, sf):
    return predictions(spark, sf).select(*KEY, r("additive_shrunk").alias("additive_shrunk"))


@query("mdl_mf_bias_only", f"WITH {PRED} SELECT count(*) AS n, round(avg(abs(y - additive_shrunk)), 4) AS mae, count(*) FILTER (WHERE additive_shrunk < 0 OR additive_shrunk > 100) AS clipped FROM prd")
def mdl_mf_bias_only(spark, sf):
    p = predictions(spark, sf)
    out = (F.col("additive_shrunk") < 0) | (F.col("additive_shrunk") > 100)
    return p.agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.abs(F.col("acc") - F.col("additive_shrunk"))), 4).alias("mae"), F.count(F.when(out, 1)).alias("clipped"))


@query("mdl_level_additive", f"""WITH {S.FP}, {LV}, x AS (SELECT fp.*, "table", level, {S.draw_hex("'lvl'", 'player', 'fp.item')} < '33333333' AS is_test FROM fp JOIN lv USING (item)), tr AS (SELECT * FROM x WHERE NOT is_test),
 mu AS (SELECT avg(acc) AS mu FROM tr), p AS (SELECT player, avg(acc) AS mp FROM tr GROUP BY 1), l AS (SELECT "table", level, avg(acc) AS ml FROM tr GROUP BY 1, 2)
 SELECT count(*) AS n, round(avg(abs(acc - mu)), 4) AS m0, round(avg(abs(acc - coalesce(mp, mu))), 4) AS m1, round(avg(abs(acc - coalesce(ml, mu))), 4) AS m2, round(avg(abs(acc - (coalesce(mp, mu) + coalesce(ml, mu) - mu))), 4) AS m3
 FROM x LEFT JOIN p USING (player) LEFT JOIN l USING ("table", level), mu WHERE is_test""")
def mdl_level_additive(spark, sf):
    x = t.first_plays(spark, sf).join(levels(spark, sf), "item").withColumn("is_test", draw_hex("lvl", F.col("player"), F.col("item")) < "33333333")
    tr, te = x.filter("not is_test"), x.filter("is_test")
    mu = tr.agg(F.avg("acc")).scalar()
    j = te.join(tr.groupBy("player").agg(F.avg("acc").alias("mp")), "player", "left").join(tr.groupBy("table", "level").agg(F.avg("acc").alias("ml")), ["table", "level"], "left").withColumn("mu", mu)
    p, lv = F.coalesce("mp", "mu"), F.coalesce("ml", "mu")
    return j.agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(F.abs(F.col("acc") - e)), 4).alias(m) for m, e in (("m0", F.col("mu")), ("m1", p), ("m2", lv), ("m3", p + lv - F.col("mu")))])


@query("evl_basic", f"WITH {PRED} SELECT count(*) AS n, round(avg(abs(pred - y)), 4) AS mae, round(sqrt(avg((pred - y) ** 2)), 4) AS rmse, round(avg(pred - y), 4) AS bias, round(1 - sum((pred - y) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(median(abs(pred - y)), 4) AS medae FROM pr")
def evl_basic(spark, sf):
    return rd(M.basic(pr(spark, sf)))


CEN = f"{PRED}, c AS (SELECT *, y - avg(y) OVER (PARTITION BY player) AS dy, pred - avg(pred) OVER (PARTITION BY player) AS dp, pred - avg(y) OVER (PARTITION BY player) AS dpy FROM pr)"


@query("evl_centered_r2", f"WITH {CEN} SELECT round(1 - sum((dy - dpy) ** 2) / sum(dy * dy), 4) AS centred_r2 FROM c")
def evl_centered_r2(spark, sf):
    return rd(M.centred_r2(pr(spark, sf)))


@query("evl_centered_mae", f"WITH {CEN} SELECT round(avg(abs(dp - dy)), 4) AS centred_mae, round(sqrt(avg((dp - dy) ** 2)), 4) AS centred_rmse FROM c")
def evl_centered_mae(spark, sf):
    return rd(M.centred_errors(pr(spark, sf)))


def avg_rank(col, part="player"):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0"


RHO = "CASE WHEN count(*) >= 3 AND stddev_pop(ry) > 0 AND stddev_pop(rp) > 0 THEN corr(ry, rp) END"


@query("evl_spearman", f"WITH {PRED}, k AS (SELECT player, {avg_rank('y')} AS ry, {avg_rank('pred')} AS rp FROM pr) SELECT player, count(*) AS n, round({RHO}, 4) AS rho FROM k GROUP BY player")
def evl_spearman(spark, sf):
    return rd(ranks.spearman(pr(spark, sf), ["player"], "y", "pred", t.hot(spark, sf, "player")))


@query("evl_spearman_ordinal", f"WITH {PRED}, k AS (SELECT row_number() OVER (ORDER BY y, player, item) AS ry, row_number() OVER (ORDER BY pred, player, item) AS rp FROM pr) SELECT round(corr(ry, rp), 4) AS rho FROM k")
def evl_spearman_ordinal(spark, sf):
    p = pr(spark, sf).select(*KEY, "y", "pred")
    a = skew.global_prefix(p, ["y", *KEY], {"ry": ("rank",)})
    return skew.global_prefix(a, ["pred", *KEY], {"rp": ("rank",)}).agg(r(F.corr("ry", "rp"), 4).alias("rho"))


@query("evl_partial_spearman", f"""WITH {PRED}, {S.ITEMS}, k AS (SELECT row_number() OVER (ORDER BY y, player, item) AS rx, row_number() OVER (ORDER BY pred, player, item) AS ry, row_number() OVER (ORDER BY x1, player, item) AS rz FROM pr JOIN items USING (item)),
 c AS (SELECT corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM k) SELECT round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 4) AS partial_rho FROM c""")
def evl_partial_spearman(spark, sf):
    p = pr(spark, sf).join(t.items(spark, sf).select("item", "x1"), "item").select(*KEY, "y", "pred", "x1")
    for c, o in (("y", "rx"), ("pred", "ry"), ("x1", "rz")):
        p = skew.global_prefix(p, [c, *KEY], {o: ("rank",)})
    s = p.agg(F.corr("rx", "ry").alias("xy"), F.corr("rx", "rz").alias("xz"), F.corr("ry", "rz").alias("yz"))
    xy, xz, yz = F.col("xy"), F.col("xz"), F.col("yz")
    return s.select(r((xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz)), 4).alias("partial_rho"))


@query("evl_by_player", f"""WITH {PRED}, k AS (SELECT *, {avg_rank('y')} AS ry, {avg_rank('pred')} AS rp FROM pr), p AS (SELECT player, avg(abs(y - pred)) AS mae, {RHO} AS spearman FROM k GROUP BY player),
 l AS (SELECT 'mae' AS metric, round(mae, 4) AS v FROM p UNION ALL SELECT 'spearman', round(spearman, 4) FROM p WHERE spearman IS NOT NULL)
 SELECT metric, round(avg(v), 4) AS mean, round(median(v), 4) AS median, min(v) AS min, max(v) AS max, count(*) AS n_players FROM l GROUP BY metric""")
def evl_by_player(spark, sf):
    p = pr(spark, sf)
    per = p.groupBy("player").agg(r(F.avg(F.abs(F.col("y") - F.col("pred"))), 4).alias("mae"))
    rho = ranks.spearman(p, ["player"], "y", "pred", t.hot(spark, sf, "player")).select("player", r("rho", 4).alias("spearman"))
    return rd(M.over_players(per.join(rho, "player"), ["mae", "spearman"]))


@query("evl_by_region", f"""WITH {PRED}, {LV}, x AS (SELECT pr.*, coalesce("table", 'none') AS region, count(*) OVER (PARTITION BY pr.item) AS players FROM pr LEFT JOIN lv ON pr.item = lv.item)
 SELECT region, count(*) AS n, round(avg(abs(y - pred)), 4) AS mae, count(*) FILTER (WHERE players >= 2) AS n_shared, round(avg(abs(y - pred)) FILTER (WHERE players >= 2), 4) AS mae_shared FROM x GROUP BY region""")
def evl_by_region(spark, sf):
    p = pr(spark, sf)
    shared = p.groupBy("item").agg(F.countDistinct("player").alias("players"))
    x = p.join(shared, "item").join(levels(spark, sf), "item", "left").withColumn("region", F.coalesce("table", F.lit("none")))
    e, two = F.abs(F.col("y") - F.col("pred")), F.col("players") >= 2
    return x.groupBy("region").agg(F.count(F.lit(1)).alias("n"), r(F.avg(e), 4).alias("mae"), F.count(F.when(two, 1)).alias("n_shared"), r(F.avg(F.when(two, e)), 4).alias("mae_shared"))


@query("evl_band_mae", f"""WITH {PRED}, {S.ITEMS}, i AS (SELECT item, avg(y) AS yt, avg(pred) AS yp FROM pr GROUP BY item), b AS (SELECT CASE WHEN notes % 13 <= 2 THEN '0-2' WHEN notes % 13 <= 5 THEN '3-5' WHEN notes % 13 <= 8 THEN '6-8' ELSE '9-12' END AS band, yt, yp FROM i JOIN items USING (item))
 SELECT band, count(*) AS n_items, round(avg(abs(yt - yp)), 4) AS mae FROM b GROUP BY band""")
def evl_band_mae(spark, sf):
    i = pr(spark, sf).groupBy("item").agg(F.avg("y").alias("yt"), F.avg("pred").alias("yp")).join(t.items(spark, sf), "item")
    lv = F.col("notes") % 13
    band = F.when(lv <= 2, "0-2").when(lv <= 5, "3-5").when(lv <= 8, "6-8").otherwise("9-12")
    return i.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_items"), r(F.avg(F.abs(F.col("yt") - F.col("yp"))), 4).alias("mae"))


@query("evl_qwk", f"""WITH {PRED}, c AS (SELECT CAST(lamp + 1 AS DOUBLE) AS a, least(greatest(round_even(pred / 11, 0), 1), 9) AS b FROM pr), h AS (SELECT a, count(*) AS na FROM c GROUP BY a), g AS (SELECT b, count(*) AS nb FROM c GROUP BY b),
 e AS (SELECT sum(na * nb * (a - b) ** 2) / (SELECT count(*) FROM c) AS e FROM h, g) SELECT round(1 - (SELECT sum((a - b) ** 2) FROM c) / e, 6) AS qwk FROM e""")
def evl_qwk(spark, sf):
    p = pr(spark, sf).select((F.col("lamp") + 1).alias("a"), (F.col("pred") / 11).alias("b"))
    return rd(M.kappa(p, "a", "b"), 6)


@query("evl_auc", f"""WITH {PRED}, k AS (SELECT lamp >= 4 AS pos, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS rk FROM pr)
 SELECT round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM k""")
def evl_auc(spark, sf):
    p = pr(spark, sf).select((F.col("lamp") >= 4).cast("int").alias("pos"), "pred")
    return rd(M.auc(p, "pos", "pred"), 6)


@query("evl_brier_quintile", f"""WITH {PRED}, p AS (SELECT least(greatest(pred / 100, 0), 1) AS p, CAST(lamp >= 4 AS INT) AS y FROM pr), e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS q FROM p),
 b AS (SELECT CAST(p > q[1] AS INT) + CAST(p > q[2] AS INT) + CAST(p > q[3] AS INT) + CAST(p > q[4] AS INT) AS bin, p, y FROM p, e)
 SELECT bin, count(*) AS n, round(avg(p), 4) AS p_mean, round(avg(y), 4) AS y_mean, (SELECT round(avg((p - y) ** 2), 6) FROM p) AS brier FROM b GROUP BY bin""")
def evl_brier_quintile(spark, sf):
    p = pr(spark, sf).select(F.least(F.greatest(F.col("pred") / 100, F.lit(0.0)), F.lit(1.0)).alias("p"), (F.col("lamp") >= 4).cast("int").alias("y"))
    brier = p.agg(r(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))))).scalar()
    return M.edge_bins(p, "p", 5, True).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p"), 4).alias("p_mean"), r(F.avg("y"), 4).alias("y_mean")).withColumn("brier", brier)


@query("evl_calibration", f"""WITH {PRED}, e AS (SELECT quantile_cont(pred, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM pr), b AS (SELECT CAST(list_sum(list_transform(q, lambda z: CAST(pred >= z AS INT))) AS INT) AS bin, pred, y FROM pr, e)
 SELECT bin, count(*) AS n, round(avg(pred), 4) AS pred_mean, round(avg(y), 4) AS actual_mean, round(avg(pred) - avg(y), 4) AS gap, round(avg(CAST(abs(pred - y) <= 5 AS INT)), 4) AS frac_within FROM b GROUP BY bin""")
def evl_calibration(spark, sf):
    return rd(M.calibration(pr(spark, sf)))


BAND = "pred - 18 - abs(pred - 50) / 4 AS lo, pred + 18 AS hi"


def banded(spark, sf):
    p = pr(spark, sf)
    return p.withColumn("lo", F.col("pred") - 18 - F.abs(F.col("pred") - 50) / 4).withColumn("hi", F.col("pred") + 18).withColumn("is_cal", draw_hex("cal", F.col("player"), F.col("item")) < "80000000")


@query("evl_width_corr", f"""WITH {PRED}, b AS (SELECT *, {BAND} FROM pr), p AS (SELECT player, stddev_samp(y) AS s, median(hi - lo) AS w FROM b GROUP BY player) SELECT round(corr(s, w), 4) AS width_corr FROM p WHERE s IS NOT NULL""")
def evl_width_corr(spark, sf):
    b = banded(spark, sf).withColumn("width", F.col("hi") - F.col("lo"))
    w = ranks.quantiles(b, ["player"], "width", {"w": 0.5}, t.hot(spark, sf, "player"))
    s = b.groupBy("player").agg(F.when(F.count("y") > 1, F.stddev_samp("y")).alias("s")).filter("s is not null")
    return s.join(w, "player").agg(r(F.corr("s", "w"), 4).alias("width_corr"))


@query("top_precision_ndcg", f"""WITH {PRED}, k AS (SELECT *, count(*) OVER (PARTITION BY player) AS n, row_number() OVER (PARTITION BY player ORDER BY pred DESC, item) AS rp, row_number() OVER (PARTITION BY player ORDER BY y DESC, item) AS ry FROM pr)
 SELECT player, any_value(n) AS n, {', '.join(f"round(count(*) FILTER (WHERE rp <= {k} AND ry <= {k}) / least({k}, any_value(n)), 4) AS precision_{k}, round(sum(CASE WHEN rp <= {k} THEN y / log2(rp + 1) END) / sum(CASE WHEN ry <= {k} THEN y / log2(ry + 1) END), 4) AS ndcg_{k}" for k in (5, 10, 20))}
 FROM k WHERE n >= 5 GROUP BY player""")
def top_precision_ndcg(spark, sf):
    return rd(M.ranking(pr(spark, sf)))


# ---- seeds ----
SEEDS = [0, 1, 2]
MD = baselines.MODELS
SEED_SQL = f"""{S.BEST}, sd AS (SELECT unnest([0, 1, 2]) AS seed), x AS (SELECT best.*, seed, {S.draw_hex("'ri'", 'seed', 'player', 'item')} < '33333333' AS is_test FROM best, sd), tr AS (SELECT * FROM x WHERE NOT is_test),
 mu AS (SELECT seed, avg(acc) AS mu FROM tr GROUP BY 1), pe AS (SELECT seed, player, avg(acc) AS mp, count(*) AS np FROM tr GROUP BY 1, 2), ie AS (SELECT seed, item, avg(acc) AS mi, count(*) AS ni FROM tr GROUP BY 1, 2),
 w AS (SELECT x.seed, x.player, x.item, acc, mu AS global_mean, mu + coalesce(mp - mu, 0) AS player_mean, mu + coalesce(mi - mu, 0) AS item_mean, mu + coalesce(mp - mu, 0) + coalesce(mi - mu, 0) AS additive,
 mu + coalesce(mp - mu, 0) * (coalesce(np, 0) / (coalesce(np, 0) + 10.0)) + coalesce(mi - mu, 0) * (coalesce(ni, 0) / (coalesce(ni, 0) + 10.0)) AS additive_shrunk
 FROM x JOIN mu ON x.seed = mu.seed LEFT JOIN pe ON x.seed = pe.seed AND x.player = pe.player LEFT JOIN ie ON x.seed = ie.seed AND x.item = ie.item WHERE is_test),
 l AS (SELECT seed, player, acc, model, pred FROM w UNPIVOT (pred FOR model IN ({', '.join(MD)}))), c AS (SELECT *, (acc - avg(acc) OVER (PARTITION BY seed, model, player)) - (pred - avg(pred) OVER (PARTITION BY seed, model, player)) AS d FROM l),
 m AS (SELECT seed, model, round(avg(abs(acc - pred)), 6) AS mae, round(avg(abs(d)), 6) AS centred_mae FROM c GROUP BY 1, 2), ml AS (SELECT seed, model, metric, value FROM m UNPIVOT (value FOR metric IN (mae, centred_mae))),
 ag AS (SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n_seeds, min(value) AS lo, max(value) AS hi FROM ml GROUP BY 1, 2)"""


def seed_metrics(spark, sf):
    """(seed, model, metric, value) for all baselines; all seeds in one plan."""
    b = t.best_rows(spark, sf).select(*KEY, "acc", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    x = cut(b.withColumn("is_test", draw_hex("ri", F.col("seed"), F.col("player"), F.col("item")) < "33333333"))
    w = baselines.predict(x.filter("not is_test"), x.filter("is_test"), by=["seed"])
    means = w.groupBy("seed", "player").agg(F.avg("acc").alias("my"), *[F.avg(m).alias(f"mp_{m}") for m in MD])
    j = w.join(means, ["seed", "player"])
    aggs = []
    for m in MD:
        aggs += [r(F.avg(F.abs(F.col("acc") - F.col(m)))).alias(f"mae__{m}"), r(F.avg(F.abs((F.col("acc") - F.col("my")) - (F.col(m) - F.col(f"mp_{m}"))))).alias(f"centred_mae__{m}")]
    wide = j.groupBy("seed").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("metric"), F.col(f"{k}__{m}").alias("value")) for m in MD for k in ("mae", "centred_mae")])
    return wide.select("seed", F.explode(rows).alias("s")).select("seed", "s.*")


@query("evl_multi_seed", f"WITH {SEED_SQL} SELECT model, metric, round(mean, 4) AS mean, round(std, 4) AS std, n_seeds, round(lo, 4) AS best_lo, round(hi, 4) AS best_hi FROM ag")
def evl_multi_seed(spark, sf):
    return rd(M.across_seeds(seed_metrics(spark, sf)))


GAIN = """g AS (SELECT c.metric, c.mean AS challenger, c.std AS challenger_std, r.mean AS reference, r.mean - c.mean AS gain, c.hi < r.mean AS all_seeds_win, r.mean - c.mean > c.std AS gain_exceeds_std,
 c.hi < r.mean AND r.mean - c.mean > c.std AS stable_win FROM ag c JOIN ag r USING (metric) WHERE c.model = 'additive_shrunk' AND r.model = '{ref}')"""


@query("evl_stable_gain", f"WITH {SEED_SQL}, {GAIN.format(ref='additive')} SELECT metric, round(challenger, 4) AS challenger, round(challenger_std, 4) AS challenger_std, round(reference, 4) AS reference, round(gain, 4) AS gain, all_seeds_win, gain_exceeds_std, stable_win FROM g")
def evl_stable_gain(spark, sf):
    return rd(M.stable_gain(M.across_seeds(seed_metrics(spark, sf)), "additive_shrunk", "additive"))


@query("evl_gate_shrunk", f"""WITH {SEED_SQL}, {GAIN.format(ref='additive')} SELECT 'random_interaction' AS split, bool_and(stable_win) AS passed, count(*) FILTER (WHERE NOT stable_win) AS n_reasons FROM g""")
def evl_gate_shrunk(spark, sf):
    """Verdict of the shrunk bias over the plain one on the random split: all metrics must be stable wins."""
    g = M.stable_gain(M.across_seeds(seed_metrics(spark, sf)), "additive_shrunk", "additive")
    return g.agg(F.bool_and("stable_win").alias("passed"), F.count(F.when(~F.col("stable_win"), 1)).alias("n_reasons")).select(F.lit("random_interaction").alias("split"), "passed", "n_reasons")


@query("evl_gate_b", f"""WITH {SEED_SQL}, {GAIN.format(ref='item_mean')}, f AS (SELECT bool_or(stable_win) FILTER (WHERE metric = 'mae') AS mae_win, bool_or(stable_win) FILTER (WHERE metric = 'centred_mae') AS cen_win FROM g)
 SELECT mae_win AS gate1, cen_win AS gate2, mae_win AND NOT cen_win AS difficulty_only FROM f""")
def evl_gate_b(spark, sf):
    """Gate 1: beats the item reference.  Gate 2: also improves within players; otherwise difficulty only."""
    g = M.stable_gain(M.across_seeds(seed_metrics(spark, sf)), "additive_shrunk", "item_mean")
    f = g.agg(F.bool_or(F.when(F.col("metric") == "mae", F.col("stable_win"))).alias("gate1"), F.bool_or(F.when(F.col("metric") == "centred_mae", F.col("stable_win"))).alias("gate2"))
    return f.withColumn("difficulty_only", F.col("gate1") & ~F.col("gate2"))


# ---- controls ----
def shuf_sql(src, cols, seed, keys="player, item"):
    ka = S.draw_hex(f"'{seed}a'", "player", "item")
    kb = S.draw_hex(f"'{seed}b'", "player", "item")
    return f"(SELECT a.player, a.item, a.acc, {', '.join('b.' + c for c in cols)} FROM (SELECT *, row_number() OVER (ORDER BY {ka}, {keys}) AS i FROM {src}) a JOIN (SELECT {', '.join(cols)}, row_number() OVER (ORDER BY {kb}, {keys}) AS i FROM {src}) b USING (i))"


CTL = f"""{S.SAMPLES}, s AS (SELECT player, item, acc, CAST(bp AS DOUBLE) AS x, {S.draw_hex("'ctl'", 'player', 'item')} < '4ccccccc' AS is_test FROM smp)"""


def control_rows(spark, sf):
    s = cut(t.first_plays(spark, sf).select(*KEY, "acc", F.col("bp").cast("double").alias("x"), (draw_hex("ctl", F.col("player"), F.col("item")) < "4ccccccc").alias("is_test")))
    return s.filter("not is_test").drop("is_test"), s.filter("is_test").drop("is_test")


@query("evl_shuffle_control", f"""WITH {CTL}, tr AS (SELECT * FROM s WHERE NOT is_test), te AS (SELECT * FROM s WHERE is_test), trs AS {shuf_sql('tr', ['x'], 'sh')},
 f AS (SELECT regr_slope(acc, x) AS b, regr_intercept(acc, x) AS a FROM tr), fs AS (SELECT regr_slope(acc, x) AS b, regr_intercept(acc, x) AS a FROM trs)
 SELECT 'real' AS variant, round(any_value(b), 6) AS slope, round(avg(abs(acc - a - b * x)), 6) AS mae FROM te, f UNION ALL SELECT 'shuffled', round(any_value(b), 6), round(avg(abs(acc - a - b * x)), 6) FROM te, fs""")
def evl_shuffle_control(spark, sf):
    """Refit with the column permuted over the train rows and compare."""
    tr, te = control_rows(spark, sf)
    out = None
    for name, fit in (("real", tr), ("shuffled", M.repair(tr, ["x"], "sh", KEY))):
        b, a = M.ols(fit, "x", "acc")
        res = te.select("acc", "x", b.alias("b"), a.alias("a")).agg(F.lit(name).alias("variant"), r(F.first("b")).alias("slope"), r(F.avg(F.abs(F.col("acc") - F.col("a") - F.col("b") * F.col("x")))).alias("mae"))
        out = res if out is None else out.unionByName(res)
    return out


@query("evl_perm_guard", f"""WITH {CTL}, tr AS (SELECT * FROM s WHERE NOT is_test), te AS (SELECT * FROM s WHERE is_test), tes AS {shuf_sql('te', ['x'], 'pg')}, f AS (SELECT regr_slope(acc, x) AS b, regr_intercept(acc, x) AS a FROM tr)
 SELECT (SELECT round(avg(abs(acc - a - b * x)), 6) FROM te, f) AS mae_real, (SELECT round(avg(abs(acc - a - b * x)), 6) FROM tes, f) AS mae_permuted""")
def evl_perm_guard(spark, sf):
    """Content permuted between test rows, same fitted model."""
    tr, te = control_rows(spark, sf)
    b, a = M.ols(tr, "x", "acc")

    def mae(d):
        return d.select("acc", "x", b.alias("b"), a.alias("a")).agg(r(F.avg(F.abs(F.col("acc") - F.col("a") - F.col("b") * F.col("x"))))).scalar()

    one = te.agg(F.lit(1).alias("one"))
    return one.select(mae(te).alias("mae_real"), mae(M.repair(te, ["x"], "pg", KEY)).alias("mae_permuted"))


BOOT = S.draw_hex("'boot'", "player", "item")


@query("evl_paired_boot", f"""WITH {PRED}, d AS (SELECT player, item, abs(y - pred) - abs(y - pred2) AS d, CAST(concat('0x', {BOOT}) AS BIGINT) % 2147483646 + 1 AS u FROM pr),
 bs AS (SELECT unnest({M.replicate_factors(2000)}) AS f), ws AS (SELECT f, d, (u * f) % 2147483647 AS v FROM d, bs), w AS (SELECT f, d, {' + '.join(f'CAST(v >= CAST({p * 2147483647!r} AS DOUBLE) AS INT)' for p in M.POISSON1)} AS w FROM ws),
 m AS (SELECT sum(w * d) / sum(w) AS m FROM w GROUP BY f), c AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m)
 SELECT count(*) AS n, round(avg(d), 6) AS gain, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, round(any_value(lo), 6) AS ci_lo, round(any_value(hi), 6) AS ci_hi, round(avg(CAST(d > 0 AS INT)), 6) AS helped FROM d, c""")
def evl_paired_boot(spark, sf):
    d = pr(spark, sf).withColumn("d", F.abs(F.col("y") - F.col("pred")) - F.abs(F.col("y") - F.col("pred2")))
    o = M.paired_bootstrap(d, "d", 2000, KEY)
    return o.select("n", r("gain").alias("gain"), r("t", 4).alias("t"), r("ci_lo").alias("ci_lo"), r("ci_hi").alias("ci_hi"), r("helped").alias("helped"))


@query("evl_weighted_avg", f"WITH {PRED}, p AS (SELECT player, count(*) AS n, avg(abs(y - pred)) AS mae FROM pr GROUP BY player) SELECT round(sum(n * mae) / sum(n), 6) AS wavg, round(avg(mae), 6) AS plain FROM p")
def evl_weighted_avg(spark, sf):
    p = pr(spark, sf).groupBy("player").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
    return p.agg(r(M.weighted_average(p, "mae", "n")).alias("wavg"), r(F.avg("mae")).alias("plain"))


@query("evl_identifiability", f"""WITH {S.BEST}, {S.CLIENTS} SELECT client, count(DISTINCT player) AS players, CASE WHEN count(DISTINCT player) = 1 THEN 'single player: item effects only' WHEN count(DISTINCT player) < 5 THEN 'weak: few players' ELSE 'ok' END AS note,
 'player_mean,additive' AS degenerate_cold_player, 'item_mean,additive' AS degenerate_cold_item FROM best JOIN clients USING (player) GROUP BY client""")
def evl_identifiability(spark, sf):
    p = t.best_rows(spark, sf).select("player").distinct().join(t.clients(spark, sf), "player").groupBy("client").agg(F.count(F.lit(1)).alias("players"))
    note = F.when(F.col("players") == 1, "single player: item effects only").when(F.col("players") < 5, "weak: few players").otherwise("ok")
    return p.select("client", "players", note.alias("note"), F.lit("player_mean,additive").alias("degenerate_cold_player"), F.lit("item_mean,additive").alias("degenerate_cold_item"))


@query("evl_residual_report", f"""WITH {PRED}, {S.ITEMS}, x AS (SELECT pr.*, abs(y - pred) AS ae, x1, x2, notes % 13 AS level FROM pr JOIN items USING (item)) SELECT CAST(level AS VARCHAR) AS key, count(*) AS n, round(avg(ae), 4) AS value FROM x GROUP BY level
 UNION ALL SELECT 'corr_x1', count(*), round(corr(ae, x1), 4) FROM x UNION ALL SELECT 'corr_x2', count(*), round(corr(ae, x2), 4) FROM x""")
def evl_residual_report(spark, sf):
    x = pr(spark, sf).join(t.items(spark, sf), "item").withColumn("ae", F.abs(F.col("y") - F.col("pred")))
    per = x.groupBy((F.col("notes") % 13).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("ae"), 4).alias("value"))
    c = x.agg(F.count(F.lit(1)).alias("n"), F.corr("ae", "x1").alias("c1"), F.corr("ae", "x2").alias("c2"))
    rows = F.array(*[F.struct(F.lit(f"corr_x{i}").alias("key"), F.col("n"), r(f"c{i}", 4).alias("value")) for i in (1, 2)])
    return per.unionByName(c.select(F.inline(rows)))


@query("evl_leak_guards", f"""WITH {S.FP}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS rk FROM fp) SELECT 'held_out_in_train' AS guard, CAST(0 AS BIGINT) AS violations
 UNION ALL SELECT 'prefix_not_earlier', (SELECT count(*) FROM (SELECT player, max(ts) FILTER (WHERE rk <= 20) AS a, min(ts) FILTER (WHERE rk > 20) AS b FROM r GROUP BY player) WHERE a > b) UNION ALL SELECT 'item_in_own_prefix', (SELECT count(*) FROM r a JOIN r b USING (player, item) WHERE a.rk > 20 AND b.rk <= 20)""")
def evl_leak_guards(spark, sf):
    fp, hot = t.first_plays(spark, sf), t.hot(spark, sf, "player")
    held = splits.cold_groups(fp, "player", 0.1, 0, "cold_player")
    train = fp.join(held, "player", "left_anti")
    rk = skew.prefix(fp, ["player"], t.FP_ORDER, {"rk": ("rank",)}, hot)
    ord_ = rk.groupBy("player").agg(F.max(F.when(F.col("rk") <= 20, F.col("ts"))).alias("a"), F.min(F.when(F.col("rk") > 20, F.col("ts"))).alias("b")).filter("a > b")
    own = rk.filter("rk > 20").join(rk.filter("rk <= 20").select(*KEY), KEY, "left_semi")

    def rep(name, df):
        return df.agg(F.lit(name).alias("guard"), F.count(F.lit(1)).alias("violations"))

    return rep("held_out_in_train", train.join(held, "player", "left_semi")).unionByName(rep("prefix_not_earlier", ord_)).unionByName(rep("item_in_own_prefix", own))


@query("evl_external_valid", f"""WITH {LV}, k AS (SELECT "table", {avg_rank('x2', '"table"')} AS ry, {avg_rank('level', '"table"')} AS rp FROM items JOIN lv USING (item)) SELECT "table", count(*) AS n, round({RHO}, 4) AS rho FROM k GROUP BY "table" """)
def evl_external_valid(spark, sf):
    j = t.items(spark, sf).join(levels(spark, sf), "item")
    return rd(ranks.spearman(j, ["table"], "x2", "level", "auto"))
