"""Personal response curves, deviations and nearest-neighbour history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import draw, r
from ..operators import causal, knn
from ..sources import tables as t
from . import sqlparts as S
from .registry import query

ORD = t.FP_ORDER
AX = ["x1", "x2"]
KEY = ["player", "item"]
W_SQL = f"OVER (PARTITION BY player ORDER BY ts, seq, item {S.PRIOR})"


def smp(spark, sf):
    return t.samples(spark, sf), t.hot(spark, sf, "player")


def rounded(df, cols, digits=4):
    return df.select(*KEY, *[r(c, digits).alias(c) for c in cols])


def fit_sql(src: str, y: str, w: str, frame: str = W_SQL, axes=AX) -> str:
    """CTE text: weighted sums per axis over ``frame``."""
    cols = []
    for a in axes:
        ok = f"CASE WHEN {a} IS NOT NULL AND {y} IS NOT NULL THEN {w}"
        cols += [f"sum({ok} END) {frame} AS n_{a}", f"sum({ok} * {a} END) {frame} AS sx_{a}", f"sum({ok} * {y} END) {frame} AS sy_{a}",
                 f"sum({ok} * {a} * {y} END) {frame} AS sxy_{a}", f"sum({ok} * {a} * {a} END) {frame} AS sxx_{a}"]
    return f"SELECT *, {', '.join(cols)} FROM {src}"


def out_sql(resc: str = "1.0", min_n: float = 20, shrink: float = 0, clip=(0, 100), prefix="h_", axes=AX, kinds=("resp", "slope", "dev"), sd=None) -> str:
    cols = []
    for a in axes:
        n, sx, sy, sxy, sxx = (f"({t}_{a} * {resc})" for t in ("n", "sx", "sy", "sxy", "sxx"))
        ok = f"{n} >= {min_n} AND ({n} * {sxx} - {sx} * {sx}) > 1e-9"
        beta = f"(({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}) * ({n} / ({n} + {shrink})))"
        sdx = f"sqrt(greatest({sxx} / {n} - ({sx} / {n}) * ({sx} / {n}), 0))"
        e = {"resp": f"CASE WHEN {ok} THEN least(greatest(({sy} - {beta} * {sx}) / {n} + {beta} * {a}, {clip[0]}), {clip[1]}) END",
             "slope": f"CASE WHEN {ok} THEN {beta}{'' if sd is None else ' * ' + sd[a]} END",
             "dev": f"CASE WHEN {ok} AND {sdx} > 1e-9 THEN ({a} - {sx} / {n}) / {sdx} END"}
        cols += [f"round({e[k]}, 4) AS {prefix}{k}_{a}" for k in kinds]
    return ", ".join(cols)


NAMES = [f"h_{k}_{a}" for a in AX for k in ("resp", "slope", "dev")]


@query("win_resp_uni", f"WITH {S.SAMPLES}, s AS ({fit_sql('smp', 'acc', '1.0')}) SELECT player, item, {out_sql()} FROM s")
def win_resp_uni(spark, sf):
    fp, hot = smp(spark, sf)
    return rounded(causal.response(fp, ORD, AX, hot=hot), NAMES)


def decay_sql(h):
    return f"""WITH {S.SAMPLES}, b AS (SELECT *, ln(2) * (ts - min(ts) OVER (PARTITION BY player)) / (86400.0 * {h}) AS u FROM smp),
 s AS ({fit_sql('b', 'acc', 'exp(u)')}) SELECT player, item, {out_sql('exp(-u)', 5)} FROM s"""


@query("win_resp_decay", decay_sql(180))
def win_resp_decay(spark, sf):
    fp, hot = smp(spark, sf)
    return rounded(causal.response(fp, ORD, AX, min_n=5.0, half_life_days=180.0, hot=hot), NAMES)


@query("win_resp_window", f"""WITH {S.SAMPLES}, s AS ({fit_sql('smp', 'acc', '1.0', 'OVER (PARTITION BY player ORDER BY ts, seq, item ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)')})
 SELECT player, item, {out_sql()} FROM s""")
def win_resp_window(spark, sf):
    fp, hot = smp(spark, sf)
    return rounded(causal.response_window(fp, ORD, AX, 30, hot=hot), NAMES)


TRUNC_DRAW = S.draw("'trunc'", "player", "item")
@query("win_resp_trunc", f"""WITH {S.SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) - 1 AS i FROM smp),
 l AS (SELECT *, least(least(10, i) + CAST(floor({TRUNC_DRAW} * (i - least(10, i) + 1)) AS BIGINT), i) AS win_len FROM r),
 s AS (SELECT a.player, a.item, a.win_len, {', '.join(f"any_value(a.{a}) AS {a}, CAST(count(b.{a}) AS DOUBLE) AS n_{a}, sum(b.{a}) AS sx_{a}, sum(b.acc) AS sy_{a}, sum(b.{a} * b.acc) AS sxy_{a}, sum(b.{a} * b.{a}) AS sxx_{a}" for a in AX)}
 FROM l a LEFT JOIN r b ON a.player = b.player AND b.i >= a.i - a.win_len AND b.i < a.i GROUP BY 1, 2, 3)
 SELECT player, item, CAST(win_len AS BIGINT) AS win_len, {out_sql(min_n=10)} FROM s""")
def win_resp_trunc(spark, sf):
    fp, hot = smp(spark, sf)
    out = causal.response_truncated(fp, ORD, AX, draw("trunc", F.col("player"), F.col("item")), 10, hot=hot)
    return out.select(*KEY, F.col("win_len").cast("long").alias("win_len"), *[r(c, 4).alias(c) for c in NAMES])


@query("win_resp_shrink", f"WITH {S.SAMPLES}, s AS ({fit_sql('smp', 'acc', '1.0')}) SELECT player, item, {out_sql(shrink=50, kinds=('resp', 'slope'))} FROM s")
def win_resp_shrink(spark, sf):
    fp, hot = smp(spark, sf)
    return rounded(causal.response(fp, ORD, AX, shrink=50.0, hot=hot), [n for n in NAMES if "dev" not in n])


@query("win_resp_meanstd", f"""WITH {S.SAMPLES}, s AS ({fit_sql('smp', 'acc', '1.0')}), o AS (SELECT player, item, {out_sql(kinds=('resp',)).replace('round(', '(').replace(', 4)', ')')} FROM s),
 v AS (SELECT player, item, unnest([h_resp_x1, h_resp_x2]) AS v FROM o) SELECT player, item, round(avg(v), 4) AS h_resp_mean, round(stddev_pop(v), 4) AS h_resp_std FROM v GROUP BY 1, 2""")
def win_resp_meanstd(spark, sf):
    fp, hot = smp(spark, sf)
    out = causal.response(fp, ORD, AX, hot=hot)
    return rounded(causal.block_mean_std(out, ["h_resp_x1", "h_resp_x2"], "h_resp_mean", "h_resp_std"), ["h_resp_mean", "h_resp_std"])


# 2 x 2 ridge in correlation units, written out
MV = f"""WITH {S.SAMPLES}, w AS (SELECT *, count(*) {W_SQL} AS n, avg(x1) {W_SQL} AS m1, avg(x2) {W_SQL} AS m2, avg(acc) {W_SQL} AS my,
 greatest(stddev_pop(x1) {W_SQL}, 1e-9) AS s1, greatest(stddev_pop(x2) {W_SQL}, 1e-9) AS s2, greatest(stddev_pop(acc) {W_SQL}, 1e-9) AS sy,
 covar_pop(x1, x2) {W_SQL} AS c12, covar_pop(x1, acc) {W_SQL} AS c1, covar_pop(x2, acc) {W_SQL} AS c2 FROM smp),
 q AS (SELECT *, c12 / (s1 * s2) AS rho, c1 / (s1 * sy) AS r1, c2 / (s2 * sy) AS r2 FROM w),
 b AS (SELECT *, (1.1 * r1 - rho * r2) / (1.21 - rho * rho) * sy / s1 AS b1, (1.1 * r2 - rho * r1) / (1.21 - rho * rho) * sy / s2 AS b2 FROM q)
 SELECT player, item, round(CASE WHEN n >= 20 THEN least(greatest(my + b1 * (x1 - m1), 0), 100) END, 4) AS m_resp_x1, round(CASE WHEN n >= 20 THEN b1 END, 4) AS m_slope_x1,
 round(CASE WHEN n >= 20 THEN least(greatest(my + b2 * (x2 - m2), 0), 100) END, 4) AS m_resp_x2, round(CASE WHEN n >= 20 THEN b2 END, 4) AS m_slope_x2 FROM b"""


@query("win_resp_multi", MV)
def win_resp_multi(spark, sf):
    fp, hot = smp(spark, sf)
    out = causal.joint_response(fp.select(*KEY, "ts", "seq", "acc", *AX), ORD, AX, hot=hot)
    return rounded(out, ["m_resp_x1", "m_slope_x1", "m_resp_x2", "m_slope_x2"])


@query("win_resp_prefix", f"""WITH {S.SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS rk FROM smp),
 f AS (SELECT player, {', '.join(f'CAST(count({a}) AS DOUBLE) AS n_{a}, sum({a}) AS sx_{a}, sum(acc) AS sy_{a}, sum({a} * acc) AS sxy_{a}, sum({a} * {a}) AS sxx_{a}' for a in AX)} FROM r WHERE rk <= 10 GROUP BY player)
 SELECT player, item, {out_sql(min_n=5)} FROM r JOIN f USING (player) WHERE rk > 10 AND rk <= 160""")
def win_resp_prefix(spark, sf):
    fp, hot = smp(spark, sf)
    return rounded(causal.prefix_fit(fp, ORD, AX, 10, 150, hot=hot), NAMES)


DEVQ = "round(CASE WHEN count({a}) {w} >= 2 AND stddev_pop({a}) {w} > 1e-9 THEN ({a} - avg({a}) {w}) / stddev_pop({a}) {w} + 1e-6 END, 4) AS dev_{a}"


@query("win_dev", f"WITH {S.SAMPLES} SELECT player, item, {', '.join(DEVQ.format(a=a, w=W_SQL) for a in AX)} FROM smp")
def win_dev(spark, sf):
    fp, hot = smp(spark, sf)
    out = causal.deviation(fp, ORD, AX, hot=hot)
    return out.select(*KEY, *[r(F.col(c) + 1e-6, 4).alias(c) for c in ("dev_x1", "dev_x2")])  # off the rounding edge


ALL_STATS = ["x1", "x2", "notes", "ex", "bp"]
_NE = "sum(exp(u)) {w}"
_DEVD = ("round(CASE WHEN exp(-u) * sum(exp(u)) {w} >= 5 AND sqrt(greatest(sum(exp(u) * {a} * {a}) {w} / sum(exp(u)) {w} - power(sum(exp(u) * {a}) {w} / sum(exp(u)) {w}, 2), 0)) > 1e-6 "
         "THEN ({a} - sum(exp(u) * {a}) {w} / sum(exp(u)) {w}) / sqrt(greatest(sum(exp(u) * {a} * {a}) {w} / sum(exp(u)) {w} - power(sum(exp(u) * {a}) {w} / sum(exp(u)) {w}, 2), 0)) END, 3) AS dev_{a}")


@query("win_dev_all", f"""WITH {S.SAMPLES}, b AS (SELECT *, ln(2) * (ts - min(ts) OVER (PARTITION BY player)) / (86400.0 * 365) AS u FROM smp)
 SELECT player, item, {', '.join(_DEVD.format(a=a, w=W_SQL) for a in ALL_STATS)} FROM b""")
def win_dev_all(spark, sf):
    fp, hot = smp(spark, sf)
    out = causal.deviation_decayed(fp, ORD, ALL_STATS, 365.0, 5.0, hot)
    return rounded(out, [f"dev_{a}" for a in ALL_STATS], 3)


@query("win_axis_sd", f"WITH {S.SAMPLES} SELECT round(stddev_pop(x1), 4) AS sd_x1, round(stddev_pop(x2), 4) AS sd_x2 FROM smp")
def win_axis_sd(spark, sf):
    return t.samples(spark, sf).agg(*[r(F.stddev_pop(a), 4).alias(f"sd_{a}") for a in AX])


def targets3_sql():
    parts = []
    for y, p, clip in (("acc", "h_", (0, 100)), ("lamp", "l_", (0, 10)), ("lbp", "b_", (0, 12))):
        f = fit_sql("b", y, "exp(u)")
        parts.append(f"{p}s AS ({f}), {p}o AS (SELECT player, item, {out_sql('exp(-u)', 5, clip=clip, prefix=p, kinds=('resp', 'dev'))} FROM {p}s)")
    return f"""WITH {S.SAMPLES}, b AS (SELECT *, ln(1 + bp) AS lbp, ln(2) * (ts - min(ts) OVER (PARTITION BY player)) / (86400.0 * 180) AS u FROM smp),
 {', '.join(parts)} SELECT * FROM h_o JOIN l_o USING (player, item) JOIN b_o USING (player, item)"""


@query("win_targets3", targets3_sql())
def win_targets3(spark, sf):
    fp, hot = smp(spark, sf)
    fp = fp.withColumn("lbp", F.log1p("bp"))
    out = causal.response_targets(fp, ORD, AX, {"acc": ("h_", (0, 100)), "lamp": ("l_", (0, 10)), "lbp": ("b_", (0, 12))}, 5.0, 180.0, hot)
    return rounded(out, [f"{p}{k}_{a}" for p in ("h_", "l_", "b_") for a in AX for k in ("resp", "dev")])


@query("evl_half_life_sweep", f"""WITH {S.SAMPLES}, b0 AS (SELECT *, (ts - min(ts) OVER (PARTITION BY player)) / 86400.0 AS d FROM smp),
 hs AS (SELECT unnest([1e9, 720, 365, 180, 90, 30]) AS hl), b AS (SELECT b0.*, hl, CASE WHEN hl > 1e6 THEN 0 ELSE ln(2) * d / hl END AS u FROM b0, hs),
 s AS ({fit_sql('b', 'acc', 'exp(u)', W_SQL.replace('BY player', 'BY hl, player'), ['x1'])}), o AS (SELECT hl, acc, {out_sql('exp(-u)', 5, axes=['x1'], kinds=('resp',))} FROM s)
 SELECT CAST(CASE WHEN hl > 1e6 THEN 0 ELSE hl END AS INT) AS half_life, count(h_resp_x1) AS n, round(avg(abs(acc - h_resp_x1)), 3) AS mae FROM o GROUP BY 1""")
def evl_half_life_sweep(spark, sf):
    fp, hot = smp(spark, sf)
    out = causal.half_life_sweep(fp, ORD, "x1", [None, 720.0, 365.0, 180.0, 90.0, 30.0], 5.0, hot)
    return out.select("half_life", "n", r("mae", 3).alias("mae"))


KNN = """WITH {S}, st AS (SELECT avg(CAST(x1 AS DOUBLE)) AS m1, stddev_pop(CAST(x1 AS DOUBLE)) AS s1, avg(CAST(x2 AS DOUBLE)) AS m2, stddev_pop(CAST(x2 AS DOUBLE)) AS s2 FROM smp),
 z AS (SELECT player, item, ts, seq, acc, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS rn, coalesce(CAST(x1 AS DOUBLE), m1) AS x1, coalesce(CAST(x2 AS DOUBLE), m2) AS x2, s1, s2 FROM smp, st),
 e AS (SELECT a.player, a.item, b.acc, b.rn, (a.x1 - b.x1) / a.s1 AS d1, (a.x2 - b.x2) / a.s2 AS d2 FROM z a JOIN z b ON a.player = b.player AND b.rn < a.rn),
 d AS (SELECT player, item, acc, row_number() OVER (PARTITION BY player, item ORDER BY d1 * d1 + d2 * d2, rn) AS r FROM e)"""


@query("win_knn_prior", KNN.format(S=S.SAMPLES) + " SELECT player, item, round(avg(acc) FILTER (WHERE r <= 20), 4) AS h_knn_acc FROM d GROUP BY 1, 2")
def win_knn_prior(spark, sf):
    fp, hot = smp(spark, sf)
    return rounded(knn.prior_neighbours(fp, ORD, AX, [20], hot).filter("n_20 > 0"), ["knn_20"]).withColumnRenamed("knn_20", "h_knn_acc")


@query("win_knn_k_sweep", KNN.format(S=S.SAMPLES) + " SELECT player, item, " + ", ".join(f"round(avg(acc) FILTER (WHERE r <= {k}), 4) AS knn_{k}" for k in (5, 10, 20, 50, 100)) + " FROM d GROUP BY 1, 2")
def win_knn_k_sweep(spark, sf):
    fp, hot = smp(spark, sf)
    ks = [5, 10, 20, 50, 100]
    return rounded(knn.prior_neighbours(fp, ORD, AX, ks, hot).filter("n_5 > 0"), [f"knn_{k}" for k in ks])


@query("jn_prior_self", KNN.format(S=S.SAMPLES) + " SELECT player, item, count(*) AS n_prior, min(acc) AS prior_min, max(acc) AS prior_max FROM d GROUP BY 1, 2")
def jn_prior_self(spark, sf):
    """Each target against its strictly earlier rows - as one running scan, no pair rows."""
    fp, hot = smp(spark, sf)
    from ..operators import skew

    out = skew.prefix(fp, ["player"], ORD, {"n_prior": ("count", F.lit(1)), "prior_min": ("min", F.col("acc")), "prior_max": ("max", F.col("acc"))}, hot)
    return out.filter(F.col("n_prior") > 0).select(*KEY, "n_prior", "prior_min", "prior_max")


@query("prj_registry", f"""WITH {S.SAMPLES}, s AS ({fit_sql('smp', 'acc', '1.0')}), o AS (SELECT {out_sql()} FROM s) SELECT feature, count(v) AS n_present, (SELECT count(*) FROM o) AS n_rows FROM (SELECT * FROM o UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(NAMES)}))) GROUP BY feature""")
def prj_registry(spark, sf):
    """The registered response block, expanded from the axes, with the share of rows where each feature exists."""
    from ..functions import registry as reg
    from ..operators.audit import long_form

    fp, hot = smp(spark, sf)
    cols = reg.block("h_", reg.AXES)
    f = reg.select_features(causal.response(fp, ORD, list(reg.AXES), hot=hot), KEY, cols)
    return long_form(f, [], cols, "feature", "v").groupBy("feature").agg(F.count("v").alias("n_present"), F.count(F.lit(1)).alias("n_rows"))
