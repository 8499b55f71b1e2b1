"""Linear fits, ablations and ladders, all from tables of cross-moments.  The reference SQL solves the normal equations itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r
from ..operators import causal, corpus as C, splits
from ..operators.gram import Moments, errors
from ..session import cut
from ..sources import tables as t
from . import sqlparts as S
from .corpus import STATS_SQL, chart
from .models import CONTENT, HIST, KEY, table
from .registry import query
from .response import AX, W_SQL, fit_sql, out_sql

RESP = [f"h_resp_{a}" for a in AX]
SLOPE = [f"h_slope_{a}" for a in AX]
BLOCK = ["h_resp_mean", "h_resp_std"]
CORE = CONTENT + HIST
FULL = CORE + RESP + SLOPE + BLOCK
GROUPS = {"content": CONTENT, "level": ["h_acc_mean", "h_acc_std"], "volume": ["h_n_firstplays", "h_days_span"], "errors": ["h_fail_rate", "h_bp_mean"]}
EVERY = [c for g in GROUPS.values() for c in g]
ALPHAS = (0.1, 1.0, 10.0, 100.0)
FOLDS = 5


def samples(spark, sf):
    """First plays of the train and test phases with history, item axes and the response block."""
    fp, hot = t.samples(spark, sf), t.hot(spark, sf, "player")
    h = causal.phase(causal.history(fp, t.FP_ORDER, hot), hot).select(*KEY, "acc", "phase", *CORE).filter("phase <> 'history'")
    resp = causal.response(fp, t.FP_ORDER, AX, hot=hot).select(*KEY, *[r(c, 4).alias(c) for c in RESP + SLOPE])
    out = causal.block_mean_std(h.join(resp, KEY), RESP, *BLOCK)
    return cut(out.select(*KEY, "acc", (F.col("phase") == "test").alias("is_test"), *CORE, *RESP, *SLOPE, *[r(c, 4).alias(c) for c in BLOCK]))


# ---- reference SQL ----

_m = ", ".join
HS = f"""{S.SAMPLES}, ct AS (SELECT player, quantile_cont(ts, 0.5) AS t1, quantile_cont(ts, 0.75) AS t2 FROM smp GROUP BY player),
 rs AS (SELECT player, item, {out_sql(kinds=("resp", "slope"))} FROM ({fit_sql('smp', 'acc', '1.0')})),
 hs AS (SELECT smp.player, smp.item, acc, x1, x2, ts, t1, t2, count(*) {W_SQL} AS h_n_firstplays, avg(acc) {W_SQL} AS h_acc_mean, CASE WHEN count(acc) {W_SQL} > 1 THEN stddev_pop(acc) {W_SQL} END AS h_acc_std,
  avg(CAST(lamp = 1 AS INT)) {W_SQL} AS h_fail_rate, avg(bp) {W_SQL} AS h_bp_mean, CASE WHEN count(*) {W_SQL} > 0 THEN (ts - min(ts) OVER (PARTITION BY player)) / 86400.0 END AS h_days_span FROM smp JOIN ct USING (player)),
 d AS (SELECT hs.* EXCLUDE (ts, t1, t2), ts > t2 AS is_test, {_m(RESP + SLOPE)}, round(list_avg(list_filter([{_m(RESP)}], lambda v: v IS NOT NULL)), 4) AS h_resp_mean,
  round(list_stddev_pop(list_filter([{_m(RESP)}], lambda v: v IS NOT NULL)), 4) AS h_resp_std FROM hs JOIN rs USING (player, item) WHERE ts > t1)"""


def ridge_sql(cols: list[str], label: str, variants: list[tuple], source: str = "d", fold: str = "-1", who: str = "player") -> str:
    """CTEs ev (name, n, mae, rmse, r2, cr2) and betas: variants are (name, columns, columns that must be there, alpha, fold left out or -1)."""
    flags = lambda own: "[" + _m("1" if c in own else "0" for c in cols) + "]"
    v = _m(f"('{n}', {flags(own)}, {flags(need)}, CAST({alpha} AS DOUBLE), {k})" for n, own, need, alpha, k in variants)
    p = len(cols)
    at = range(1, p + 1)
    return f"""v AS (SELECT * FROM (VALUES {v}) q(name, mask, need, alpha, k)),
 xr AS (SELECT {who} AS who, CAST({label} AS DOUBLE) AS y, is_test, {fold} AS fold, [{_m(f'CAST({c} AS DOUBLE)' for c in cols)}] AS x FROM {source} WHERE {label} IS NOT NULL),
 tv AS (SELECT v.*, who, y, list_transform(x, lambda e, i: CASE WHEN mask[i] = 1 THEN e ELSE 0.0 END) AS x, CASE WHEN k < 0 THEN is_test ELSE fold = k END AS judged
  FROM xr, v WHERE (k < 0 OR NOT is_test) AND len(list_filter(x, lambda e, i: e IS NULL AND need[i] = 1)) = 0),
 mo AS (SELECT name, count(*) AS n, avg(y) AS my, [{_m(f'avg(x[{i}])' for i in at)}] AS m, [{_m(f'CASE WHEN var_pop(x[{i}]) > 1e-12 * greatest(1, avg(x[{i}] * x[{i}])) THEN stddev_pop(x[{i}]) END' for i in at)}] AS s FROM tv WHERE NOT judged GROUP BY name),
 z AS (SELECT tv.*, n, y - my AS yc, my, list_transform(x, lambda e, i: CASE WHEN s[i] IS NULL THEN 0.0 ELSE (e - m[i]) / s[i] END) AS z FROM tv JOIN mo USING (name)),
 a AS (SELECT name, any_value(mask) AS mask, any_value(alpha) AS alpha, any_value(n) AS n, [{_m('[' + _m(f'sum(z[{i}] * z[{j}])' for j in at) + f', sum(z[{i}] * yc)]' for i in at)}] AS a FROM z WHERE NOT judged GROUP BY name),
 el(name, n, k, m) AS (SELECT name, n, 1, list_transform(a, lambda w, i: list_transform(w, lambda e, j: e + CASE WHEN i = j THEN alpha * mask[i] ELSE 0.0 END)) FROM a
  UNION ALL SELECT name, n, k + 1, CASE WHEN m[k][k] <= 1e-9 * n THEN list_transform(m, lambda w, i: CASE WHEN i = k THEN list_transform(w, lambda e: 0.0) ELSE w END)
   ELSE list_transform(m, lambda w, i: CASE WHEN i = k THEN list_transform(w, lambda e: e / m[k][k]) ELSE list_transform(w, lambda e, j: e - w[k] * m[k][j] / m[k][k]) END) END FROM el WHERE k <= {p}),
 pd AS (SELECT name, who, y, y - my - ({' + '.join(f'm[{i}][{p + 1}] * z[{i}]' for i in at)}) AS e FROM z JOIN (SELECT name, m FROM el WHERE k = {p + 1}) USING (name) WHERE judged),
 wi AS (SELECT name, sum(w) AS w FROM (SELECT name, var_pop(y) * count(*) AS w FROM pd GROUP BY name, who) GROUP BY name),
 ev AS (SELECT name, count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, 1 - sum(e * e) / any_value(w) AS cr2 FROM pd JOIN wi USING (name) GROUP BY name)"""


# ---- ordinary least squares on the 26 chart statistics ----

CHART_TEST = f"{S.draw_hex(chr(39) + 'ols' + chr(39), 'item')} < '{splits.below(0.2)}'"
OLS_V = [("mean", [], C.STATS, 0.0, -1), ("ols", C.STATS, C.STATS, 0.0, -1)]
OLS_SQL = f"""{STATS_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, s26 AS (SELECT item, {_m(f'round(coalesce(CAST({c} AS DOUBLE), 0), 3) AS {c}' for c in C.STATS)} FROM st),
 yv AS (SELECT user_id AS item, avg(value) AS target FROM events GROUP BY 1), d AS (SELECT s26.*, target, {CHART_TEST} AS is_test FROM s26 JOIN yv USING (item)), {ridge_sql(C.STATS, 'target', OLS_V, who='item')}
 SELECT name AS model, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(r2, 4) AS r2 FROM ev"""


@query("mdl_linear_ols", OLS_SQL)
def mdl_linear_ols(spark, sf):
    """Mean predictor and least squares on the 26 statistics of every chart, for the mean value of its events."""
    from ..functions.columns import draw_hex

    ch = chart(spark, sf)
    stats = C.stats26(ch, cut(ch.notes()))
    target = t.table(spark, sf, "events", "user_id", "value").groupBy(F.col("user_id").alias("item")).agg(F.avg("value").alias("target"))
    d = cut(stats.select("item", *[r(c, 3).alias(c) for c in C.STATS]).join(target, "item").withColumn("is_test", draw_hex("ols", F.col("item")) < splits.below(0.2)))
    m = Moments(d.filter("not is_test"), C.STATS, "target", [C.STATS])
    e = errors(d.filter("is_test"), "target", {"mean": m.fit([], C.STATS), "ols": m.fit(C.STATS)})
    return table(spark, [(k, x["n"], x["mae"], x["rmse"], x["r2"]) for k, x in e.items()], "model string, n long, mae double, rmse double, r2 double")


# ---- ridge with its penalty from folds ----

CV_V = [(f"{a}|{k}", CORE, CORE, a, k) for a in ALPHAS for k in [*range(FOLDS), -1]]
FOLD_SQL = f"CAST(CAST(concat('0x', {S.draw_hex(chr(39) + 'fold' + chr(39), chr(39) + '3' + chr(39), 'item')}) AS BIGINT) % {FOLDS} AS INT)"
CV_SQL = f"""WITH RECURSIVE {HS}, {ridge_sql(CORE, 'acc', CV_V, fold=FOLD_SQL)}, cv AS (SELECT CAST(split_part(name, '|', 1) AS DOUBLE) AS alpha, avg(mae) FILTER (WHERE split_part(name, '|', 2) <> '-1') AS cv_mae, max(mae) FILTER (WHERE split_part(name, '|', 2) = '-1') AS tm FROM ev GROUP BY 1),
 b AS (SELECT alpha AS best FROM cv ORDER BY cv_mae, alpha LIMIT 1) SELECT alpha, round(cv_mae, 4) AS cv_mae, alpha = best AS chosen, CASE WHEN alpha = best THEN round(tm, 4) END AS test_mae FROM cv, b"""


@query("mdl_ridge_cv", CV_SQL)
def mdl_ridge_cv(spark, sf):
    """Penalty by folds of whole items inside the train rows; all penalties and folds are solved from one table of moments."""
    d = samples(spark, sf).withColumn("fold", splits.fold(FOLDS, 3, "item"))
    train = d.filter("not is_test")
    m = Moments(train, CORE, "acc", [CORE], "fold")
    fits = {(a, k): m.fit(CORE, alpha=a, without=k) for a in ALPHAS for k in range(FOLDS)}
    e = errors(train, "acc", fits, {key: F.col("fold") == key[1] for key in fits})
    cv = {a: sum(e[a, k]["mae"] for k in range(FOLDS)) / FOLDS for a in ALPHAS}
    best = min(ALPHAS, key=lambda a: (cv[a], a))
    test = errors(d.filter("is_test"), "acc", {"t": m.fit(CORE, alpha=best)})["t"]["mae"]
    return table(spark, [(a, cv[a], a == best, test if a == best else None) for a in ALPHAS], "alpha double, cv_mae double, chosen boolean, test_mae double")


# ---- ablations ----

PAIR = {a: [f"h_resp_{a}", f"h_slope_{a}"] for a in AX}
AXIS = {("base", "none"): CORE, ("full", "all"): FULL}
AXIS |= {("without", a): [c for c in FULL if c not in PAIR[a]] for a in AX} | {("only", a): CORE + PAIR[a] for a in AX}
AXIS |= {("half", "resp"): CORE + RESP, ("half", "slope"): CORE + SLOPE, ("half", "mean_std"): CORE + BLOCK}
AXIS_V = [("|".join(k), cols, FULL, 0.0, -1) for k, cols in AXIS.items()]
AXIS_SQL = f"""WITH RECURSIVE {HS}, {ridge_sql(FULL, 'acc', AXIS_V)}, f AS (SELECT max(mae) FILTER (WHERE name = 'full|all') AS fm, max(cr2) FILTER (WHERE name = 'full|all') AS fc, max(mae) FILTER (WHERE name = 'base|none') AS bm, max(cr2) FILTER (WHERE name = 'base|none') AS bc FROM ev)
 SELECT split_part(name, '|', 1) AS variant, split_part(name, '|', 2) AS axis, n, round(mae, 4) AS mae, round(cr2, 4) AS cr2, round(mae - CASE WHEN name LIKE 'without%' THEN fm ELSE bm END, 4) AS d_mae, round(cr2 - CASE WHEN name LIKE 'without%' THEN fc ELSE bc END, 4) AS d_cr2 FROM ev, f"""


@query("evl_axis_ablation", AXIS_SQL)
def evl_axis_ablation(spark, sf):
    """Response axes left out one by one, added one by one, and the block's halves, on the rows that have the whole block.  Differences
    are against all axes where one is left out, else against no axes."""
    d = samples(spark, sf)
    m = Moments(d.filter("not is_test"), FULL, "acc", [FULL])
    e = errors(d.filter("is_test"), "acc", {k: m.fit(cols, FULL) for k, cols in AXIS.items()}, group="player")
    rows = []
    for (variant, axis), x in e.items():
        ref = e["full", "all"] if variant == "without" else e["base", "none"]
        rows.append((variant, axis, x["n"], x["mae"], x["cr2"], x["mae"] - ref["mae"], x["cr2"] - ref["cr2"]))
    return table(spark, rows, "variant string, axis string, n long, mae double, cr2 double, d_mae double, d_cr2 double")


GROUP_V = [("none", EVERY, EVERY, 0.0, -1)] + [(g, left := [c for c in EVERY if c not in cols], left, 0.0, -1) for g, cols in GROUPS.items()]


@query("evl_group_ablation", f"WITH RECURSIVE {HS}, {ridge_sql(EVERY, 'acc', GROUP_V)} SELECT name AS dropped, n, round(mae, 4) AS mae FROM ev")
def evl_group_ablation(spark, sf):
    """Feature groups left out one by one, each fit on the rows that have the others."""
    d = samples(spark, sf)
    m = Moments(d.filter("not is_test"), EVERY, "acc", [v[2] for v in GROUP_V])
    e = errors(d.filter("is_test"), "acc", {v[0]: m.fit(v[1]) for v in GROUP_V})
    return table(spark, [(k, x["n"], x["mae"]) for k, x in e.items()], "dropped string, n long, mae double")


LADDER, _sofar = [], []
for _g, _cols in GROUPS.items():
    _sofar = _sofar + _cols
    LADDER += [((layer, _g, len(_sofar), model), _sofar, need, alpha) for layer, need in (("full", _sofar), ("common", EVERY)) for model, alpha in (("ols", 0.0), ("ridge", 10.0))]
ROW_SETS = [x for k, (_, _, x, _) in enumerate(LADDER) if x not in [need for _, _, need, _ in LADDER[:k]]]
LADDER_V = [("|".join(map(str, k)), cols, need, alpha, -1) for k, cols, need, alpha in LADDER]


@query("evl_ladder", f"""WITH RECURSIVE {HS}, {ridge_sql(EVERY, 'acc', LADDER_V)} SELECT split_part(name, '|', 1) AS layer, split_part(name, '|', 2) AS added, CAST(split_part(name, '|', 3) AS INT) AS n_features, split_part(name, '|', 4) AS model, n, round(mae, 4) AS mae, round(cr2, 4) AS cr2 FROM ev""")
def evl_ladder(spark, sf):
    """Feature families added one by one x model, on the rows that have the families so far (full) and on those that have all (common)."""
    d = samples(spark, sf)
    m = Moments(d.filter("not is_test"), EVERY, "acc", ROW_SETS)
    e = errors(d.filter("is_test"), "acc", {k: m.fit(cols, need, alpha) for k, cols, need, alpha in LADDER}, group="player")
    return table(spark, [(*k, x["n"], x["mae"], x["cr2"]) for k, x in e.items()], "layer string, added string, n_features int, model string, n long, mae double, cr2 double")


LEVEL = GROUPS["level"]
SAME_V = [("without", CONTENT, CONTENT + LEVEL, 0.0, -1), ("with", CONTENT + LEVEL, CONTENT + LEVEL, 0.0, -1)]


@query("evl_same_rows", f"""WITH RECURSIVE {HS}, {ridge_sql(CONTENT + LEVEL, 'acc', SAME_V)}, w AS (SELECT max(n) AS n, max(mae) FILTER (WHERE name = 'without') AS a, max(mae) FILTER (WHERE name = 'with') AS b FROM ev)
 SELECT n, round(a, 4) AS mae_without, round(b, 4) AS mae_with, round(a - b, 4) AS gain FROM w""")
def evl_same_rows(spark, sf):
    """Value of the level family on exactly the rows where it exists."""
    d, every = samples(spark, sf), CONTENT + LEVEL
    m = Moments(d.filter("not is_test"), every, "acc", [every])
    e = errors(d.filter("is_test"), "acc", {"without": m.fit(CONTENT, every), "with": m.fit(every)})
    a, b = e["without"], e["with"]
    return table(spark, [(a["n"], a["mae"], b["mae"], a["mae"] - b["mae"])], "n long, mae_without double, mae_with double, gain double")
