"""Window and grid queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r
from ..operators import grid as G, ranks, sequence as Q
from ..sources import tables as t
from . import sqlparts as S
from .registry import query
from .sequence import SHUF, nh, rd

N = S.NOTES
NW = "nw AS (SELECT item, CASE WHEN max(tick) - min(tick) > 64 THEN (max(tick) - min(tick) - 64) // 64 + 1 ELSE 0 END AS n_win FROM notes GROUP BY item)"
WS = NW + ", ws AS (SELECT item, unnest(range(n_win)) AS win FROM nw)"
CELL = "CAST(least(greatest(floor(({}) * 3.75), 0), 239) AS INT)"
GRID = f"""{WS}, g0 AS (SELECT item, tick // 64 AS win, {CELL.format('tick % 64')} AS cell, lane, 1 AS o, 0 AS h FROM notes),
 h0 AS (SELECT item, tick, dur, lane, unnest(range(tick // 64, (tick + dur - 1) // 64 + 1)) AS win FROM notes WHERE type = 1 AND dur > 0), h1 AS (SELECT item, win, unnest(range({CELL.format('tick - win * 64')}, {CELL.format('tick + dur - win * 64')} + 1)) AS cell, lane FROM h0),
 g AS (SELECT item, win, CAST(cell AS INT) AS cell, lane, CAST(least(sum(o), 2) AS INT) AS onset, max(h) AS hold FROM (SELECT * FROM g0 UNION ALL SELECT item, win, cell, lane, 0, 1 FROM h1) JOIN nw USING (item) WHERE win < n_win GROUP BY 1, 2, 3, 4)"""
SEED = "CAST('0x' || " + S.draw_hex("'mask'", "item", "win") + " AS BIGINT)"


def mask_sql(src):
    return f"(SELECT *, CASE WHEN (CAST(cell AS BIGINT) * 7919 + lane * 104729 + seed) % 1000 < 100 THEN 2 WHEN cell >= seed % 181 AND cell < seed % 181 + 60 THEN 1 ELSE 0 END AS mask FROM (SELECT *, {SEED} AS seed FROM {src}))"


@query("seq_win_starts", f"WITH {N}, {WS} SELECT item, win, win * 64 AS start FROM ws")
def seq_win_starts(spark, sf):
    return G.window_starts(t.notes(spark, sf))


@query("top_even_pick", f"""WITH {N}, {NW} SELECT DISTINCT item, win FROM (SELECT item, CASE WHEN n_win <= 5 THEN i ELSE CAST(round_even(i * ((n_win - 1) / 4.0), 0) AS BIGINT) END AS win, n_win, i FROM nw, (SELECT unnest(range(5)) AS i)) WHERE n_win > 0 AND i < n_win""")
def top_even_pick(spark, sf):
    return G.even_pick(t.notes(spark, sf), 5)


@query("seq_win_pairs", f"WITH {N}, {WS} SELECT item, win, win + 1 AS next_win FROM ws JOIN nw USING (item) WHERE win + 1 < n_win")
def seq_win_pairs(spark, sf):
    return G.window_pairs(t.notes(spark, sf))


@query("seq_grid", f"WITH {N}, {GRID} SELECT item, win, cell, lane, onset, hold FROM g")
def seq_grid(spark, sf):
    return G.grid(t.notes(spark, sf))


@query("seq_masks", f"WITH {N}, {GRID}, m AS {mask_sql('g')} SELECT item, win, cell, lane, mask FROM m WHERE onset > 0")
def seq_masks(spark, sf):
    return G.masked(G.grid(t.notes(spark, sf)).filter("onset > 0")).select(*G.KEY, "mask")


DP = f"""WITH {N}, {GRID}, sp0 AS (SELECT item, win, CAST(l AS INT) AS lane, CAST(c AS INT) AS cell, seed FROM (SELECT *, {SEED} AS seed FROM ws), (SELECT unnest(range(8)) AS l), (SELECT unnest(range(240)) AS c)),
 sp AS (SELECT *, CASE WHEN (CAST(cell AS BIGINT) * 7919 + lane * 104729 + seed) % 1000 < 100 THEN 2 WHEN cell >= seed % 181 AND cell < seed % 181 + 60 THEN 1 ELSE 0 END AS mask FROM sp0),
 d AS (SELECT sp.*, CASE WHEN g.onset > 0 THEN 1 ELSE 0 END AS o, CASE WHEN g.hold > 0 THEN 1 ELSE 0 END AS hd, CAST(mask = 0 AS INT) AS u FROM sp LEFT JOIN g USING (item, win, cell, lane)),
 e AS (SELECT *, sum(o * u) OVER l / greatest(sum(u) OVER l, 1e-6) AS lr, sum(hd * u) OVER l / greatest(sum(u) OVER l, 1e-6) AS ph, sum(o * u) OVER n / greatest(sum(u) OVER n, 1e-6) AS nr FROM d WINDOW l AS (PARTITION BY item, win, lane), n AS (PARTITION BY item, win, lane ORDER BY cell ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING)),
 p AS (SELECT *, 0.6 * CASE WHEN cell >= 60 AND cell < 180 THEN nr ELSE lr END + 0.4 * lr AS p FROM e WHERE mask <> 0)
 SELECT item, win, lane, count(*) AS n_masked, CAST(sum(o) AS BIGINT) AS n_hidden, round(sum(p), 4) AS p_sum, round(sum(p * o), 4) AS p_hidden, round(sum(ph), 4) AS p_hold_sum FROM p GROUP BY 1, 2, 3"""


@query("seq_density_pred", DP)
def seq_density_pred(spark, sf):
    p = G.density_prediction(t.notes(spark, sf))
    return p.groupBy("item", "win", "lane").agg(F.count(F.lit(1)).alias("n_masked"), F.sum("on").alias("n_hidden"), r(F.sum("p"), 4).alias("p_sum"), r(F.sum(F.col("p") * F.col("on")), 4).alias("p_hidden"),
                                              r(F.sum("p_hold"), 4).alias("p_hold_sum"))


@query("seq_density_next", f"""WITH {N}, {GRID}, p AS (SELECT item, win, lane, count(*) FILTER (WHERE onset > 0) / 240 AS p_onset, sum(hold) / 240 AS p_hold FROM g GROUP BY 1, 2, 3),
 nx AS (SELECT item, win - 1 AS win, lane, count(*) FILTER (WHERE onset > 0) AS n_next FROM g GROUP BY 1, 2, 3)
 SELECT p.item, p.win, p.lane, round(p_onset, 6) AS p_onset, round(p_hold, 6) AS p_hold, coalesce(n_next, 0) AS n_next FROM p LEFT JOIN nx USING (item, win, lane)""")
def seq_density_next(spark, sf):
    """A window's lane rates as the prediction for the next window, beside what the next window holds."""
    g = G.grid(t.notes(spark, sf))
    nxt = g.filter("onset > 0").groupBy("item", (F.col("win") - 1).alias("win"), "lane").agg(F.count(F.lit(1)).alias("n_next"))
    j = G.next_window_prediction(g).join(nxt, ["item", "win", "lane"], "left")
    return j.select("item", "win", "lane", r("p_onset", 6).alias("p_onset"), r("p_hold", 6).alias("p_hold"), F.coalesce("n_next", F.lit(0)).alias("n_next"))


FOC = f"""WITH {N}, {GRID}, m AS {mask_sql('(SELECT * FROM g WHERE onset > 0)')}, tot AS (SELECT item, win, cell, sum(onset) AS tot FROM m GROUP BY 1, 2, 3),
 v AS (SELECT item, win, cell, lane FROM m WHERE mask = 0), f AS (SELECT m.*, tot, (SELECT max(cell) FROM v WHERE v.item = m.item AND v.win = m.win AND v.cell < m.cell) AS pc FROM m JOIN tot USING (item, win, cell) WHERE mask <> 0),
 b AS (SELECT f.item, f.win, f.cell, f.lane, any_value(f.pc) AS pc, any_value(tot) AS tot, any_value(mask) AS mask, arg_min(v.lane, abs(f.lane - v.lane) * 8 + v.lane) AS best FROM f LEFT JOIN v ON v.item = f.item AND v.win = f.win AND v.cell = f.pc GROUP BY 1, 2, 3, 4)
 SELECT item, win, cell, lane, CASE WHEN pc IS NULL THEN 0 ELSE CAST(least(abs(lane - best), 3) AS INT) END AS lane_dist, CASE WHEN pc IS NULL THEN 0 ELSE CAST(sign(lane - best) + 1 AS INT) END AS direction,
 CASE WHEN pc IS NULL THEN 0 WHEN cell - pc < 3 THEN 0 WHEN cell - pc < 9 THEN 1 WHEN cell - pc < 18 THEN 2 WHEN cell - pc < 36 THEN 3 ELSE 4 END AS dt_prev, CAST(tot >= 2 AS INT) AS simult, mask = 1 AS in_span FROM b"""


@query("seq_focal", FOC)
def seq_focal(spark, sf):
    return G.focal(G.grid(t.notes(spark, sf)))


def _ctx(cond):
    return f"(SELECT count(*) FROM v WHERE v.item = m.item AND v.win = m.win AND {cond})"


@query("seq_focal_stats", f"""WITH {N}, {GRID}, m AS {mask_sql('(SELECT * FROM g WHERE onset > 0)')}, v AS (SELECT item, win, cell, lane FROM m WHERE mask = 0)
 SELECT item, win, cell, lane, {_ctx('abs(v.cell - m.cell) <= 30')} AS near30, {_ctx('abs(v.cell - m.cell) <= 90')} AS near90, {_ctx('v.cell < m.cell')} AS before, {_ctx('v.cell > m.cell')} AS after, {_ctx('v.lane = m.lane AND v.cell < m.cell AND v.cell >= m.cell - 60')} AS lane_before,
 {_ctx('v.lane = m.lane AND v.cell > m.cell AND v.cell <= m.cell + 60')} AS lane_after, {_ctx('v.cell = m.cell')} AS same_cell, round({_ctx('TRUE')} / 1920.0, 6) AS density FROM m WHERE mask <> 0""")
def seq_focal_stats(spark, sf):
    return rd(G.focal_context(G.grid(t.notes(spark, sf))), 6)


SA = f"""WITH {N}, nn AS (SELECT *, tick // 64 AS win FROM notes), {SHUF.format(k='item, win', src='nn')}, b AS (SELECT item, win, count(*) AS n, avg(CAST(lane <> new_lane AS INT)) AS changed FROM sv GROUP BY 1, 2),
 mg AS (SELECT item, win, max(abs(d)) AS d FROM (SELECT item, win, l, sum(d) AS d FROM (SELECT item, win, lane AS l, 1 AS d FROM sv UNION ALL SELECT item, win, new_lane, -1 FROM sv) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 f AS (SELECT item, win, max(c) = 1 AS fwd FROM (SELECT item, win, count(DISTINCT new_lane) AS c FROM sv GROUP BY item, win, lane) GROUP BY 1, 2), r AS (SELECT item, win, max(c) = 1 AS bwd FROM (SELECT item, win, count(DISTINCT lane) AS c FROM sv GROUP BY item, win, new_lane) GROUP BY 1, 2)
 SELECT item, win, n, round(changed, 6) AS changed, d = 0 AS marginals_equal, n >= 2 AND fwd AND bwd AS is_global_perm FROM b JOIN mg USING (item, win) JOIN f USING (item, win) JOIN r USING (item, win)"""


@query("seq_swap_audit", SA)
def seq_swap_audit(spark, sf):
    n, hot = nh(spark, sf)
    v = Q.shuffle_lanes(n.withColumn("win", F.floor(F.col("tick") / G.WIN_TICKS)), ["item", "win"], "ls", hot)
    return rd(G.swap_audit(v), 6)


PRF = f"""WITH {N}, {GRID}, sp AS (SELECT item, win, CAST(l AS INT) AS lane FROM ws, (SELECT unnest(range(8)) AS l)), oc AS (SELECT item, win, lane, 1 AS y, sum(onset) AS n FROM g WHERE onset > 0 GROUP BY 1, 2, 3),
 a AS (SELECT sp.*, coalesce(y, 0) AS y, coalesce(n, 0) AS n FROM sp LEFT JOIN oc USING (item, win, lane)), p AS (SELECT b.item, b.win, b.lane, a.y AS pred, b.y AS y FROM a JOIN a b ON a.item = b.item AND a.lane = b.lane AND b.win = a.win + 1),
 dn AS (SELECT item, win, sum(n) AS dens FROM a GROUP BY 1, 2), tc AS (SELECT quantile_cont(dens, 1 / 3.0) AS e1, quantile_cont(dens, 2 / 3.0) AS e2 FROM (SELECT dens FROM dn WHERE win > 0)), z AS (SELECT p.*, CASE WHEN dens > e2 THEN 'high' WHEN dens > e1 THEN 'mid' ELSE 'low' END AS grp FROM p JOIN dn USING (item, win), tc),
 u AS (SELECT grp, pred, y FROM z UNION ALL SELECT 'all', pred, y FROM z) SELECT grp, CAST(sum(pred * y) AS BIGINT) AS tp, round(sum(pred * y) / sum(pred), 4) AS precision, round(sum(pred * y) / sum(y), 4) AS recall, round(2 * sum(pred * y) / (sum(pred) + sum(y)), 4) AS f1 FROM u GROUP BY grp"""


@query("seq_prf", PRF)
def seq_prf(spark, sf):
    """Lane occupancy of the next window predicted by the current one, pooled and per density tercile."""
    from ..operators.metrics import edge_bins

    n = t.notes(spark, sf)
    occ = G.grid(n).filter("onset > 0").groupBy("item", "win", "lane").agg(F.lit(1).alias("y"), F.sum("onset").alias("n"))
    sp = G.window_starts(n).select("item", "win", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("lane"))
    a = sp.join(occ, ["item", "win", "lane"], "left").fillna(0)
    prev = a.select("item", (F.col("win") + 1).alias("win"), "lane", F.col("y").alias("pred"))
    p = a.join(prev, ["item", "win", "lane"])
    dens = a.groupBy("item", "win").agg(F.sum("n").alias("dens")).filter("win > 0")
    grp = edge_bins(dens, "dens", 3, True).select("item", "win", F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.col("bin") + 1).alias("g"))
    z = p.join(grp, ["item", "win"]).select(F.explode(F.array("g", F.lit("all"))).alias("grp"), "pred", "y")
    return rd(G.prf(z, ["grp"]))


@query("seq_struct_targets", f"""WITH {N}, {GRID}, c AS (SELECT item, win, cell, sum(onset) AS o, count(*) AS l FROM g WHERE onset > 0 GROUP BY 1, 2, 3), w AS (SELECT item, win, sum(o) AS n, count(*) FILTER (WHERE l >= 2) / 240.0 AS s FROM c GROUP BY 1, 2),
 f AS (SELECT item, win, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(s, 0) AS s FROM ws LEFT JOIN w USING (item, win)) SELECT item, win, n, round(s, 6) AS chord_share, lead(n) OVER (PARTITION BY item ORDER BY win) AS next_n FROM f""")
def seq_struct_targets(spark, sf):
    return rd(G.struct_targets(t.notes(spark, sf)), 6)


@query("cor_roll", f"""WITH {N}, e AS (SELECT item, max(tick + CASE WHEN type = 1 THEN dur ELSE 0 END) AS e FROM notes GROUP BY item), tt AS (SELECT item, (e + 3) // 4 AS t FROM e),
 o AS (SELECT item, tick // 4 AS cell, lane, 10 + type AS p FROM notes JOIN tt USING (item) WHERE tick // 4 < t), h AS (SELECT item, unnest(range(tick // 4 + 1, least((tick + dur) // 4, t - 1) + 1)) AS cell, lane, 1 AS p FROM notes JOIN tt USING (item) WHERE type = 1 AND dur > 0)
 SELECT item, cell, lane, CASE WHEN max(p) = 10 THEN 1 ELSE 2 END AS value FROM (SELECT * FROM o UNION ALL SELECT * FROM h) GROUP BY 1, 2, 3""")
def cor_roll(spark, sf):
    return G.roll(t.notes(spark, sf), 4)
