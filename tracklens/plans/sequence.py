"""Note-sequence queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import draw_hex, r
from ..operators import ranks, sequence as Q
from ..sources import tables as t
from . import sqlparts as S
from .registry import query

N = S.NOTES


def nh(spark, sf):
    return t.notes(spark, sf), t.hot(spark, sf, "note")


def rd(df, digits=4):
    return df.select(*[r(c, digits).alias(c) if ty == "double" else F.col(c) for c, ty in df.dtypes])


def gap_sql(by, where="TRUE"):
    return f"g AS (SELECT item, tick - lag(tick) OVER (PARTITION BY {by} ORDER BY tick, event_id) AS gap FROM notes WHERE {where})"


@query("seq_ioi_lane", f"WITH {N}, {gap_sql('item, lane')} SELECT item, round(quantile_cont(gap, 0.05), 4) AS p05, round(quantile_cont(gap, 0.25), 4) AS p25, round(avg(gap), 4) AS mean FROM g WHERE gap > 0 GROUP BY item")
def seq_ioi_lane(spark, sf):
    n, hot = nh(spark, sf)
    return rd(Q.gap_stats(n, ["item", "lane"], {"p05": 0.05, "p25": 0.25}, hot, "mean"))


@query("seq_ioi_global", f"WITH {N}, {gap_sql('item')} SELECT item, round(quantile_cont(gap, 0.05), 4) AS p05, round(quantile_cont(gap, 0.25), 4) AS p25 FROM g WHERE gap > 0 GROUP BY item")
def seq_ioi_global(spark, sf):
    n, hot = nh(spark, sf)
    return rd(Q.gap_stats(n, ["item"], {"p05": 0.05, "p25": 0.25}, hot))


@query("seq_ioi_scratch", f"WITH {N}, {gap_sql('item', 'lane = 0')} SELECT item, round(quantile_cont(gap, 0.05), 4) AS p05 FROM g WHERE gap > 0 GROUP BY item")
def seq_ioi_scratch(spark, sf):
    n, hot = nh(spark, sf)
    return rd(Q.gap_stats(n.filter("lane = 0"), ["item"], {"p05": 0.05}, hot))


SPINE = "sp AS (SELECT item, unnest(range(max(tick) // 16 + 1)) AS sec FROM notes GROUP BY item), cs AS (SELECT sp.item, sp.sec, count(tick) AS c FROM sp LEFT JOIN notes ON sp.item = notes.item AND sp.sec = tick // 16 GROUP BY 1, 2)"


@query("seq_nps", f"WITH {N}, {SPINE} SELECT item, round(stddev_pop(c), 4) AS nps_std, round(quantile_cont(c, 0.9), 4) AS nps_p90 FROM cs GROUP BY item HAVING count(*) >= 3")
def seq_nps(spark, sf):
    n, hot = nh(spark, sf)
    return rd(Q.nps(n, t.TICKS, hot))


@query("seq_simul", f"WITH {N}, c AS (SELECT item, count(*) AS c FROM notes GROUP BY item, tick) SELECT item, max(c) AS simul_max, round(stddev_pop(c), 4) AS simul_std FROM c GROUP BY item")
def seq_simul(spark, sf):
    return rd(Q.simultaneity(t.notes(spark, sf)))


@query("seq_entropy", f"WITH {N}, p AS (SELECT item, count(*) / sum(count(*)) OVER (PARTITION BY item) AS p FROM notes GROUP BY item, lane) SELECT item, round(-sum(p * ln(p)), 4) AS lane_entropy FROM p GROUP BY item")
def seq_entropy(spark, sf):
    return rd(Q.entropy(t.notes(spark, sf)))


@query("seq_balance", f"""WITH {N}, c AS (SELECT item, count(*) FILTER (WHERE lane IN (1, 2, 3)) AS l, count(*) FILTER (WHERE lane IN (5, 6, 7)) AS r, count(*) FILTER (WHERE lane = 0) AS s, max(tick) / 16.0 AS d FROM notes GROUP BY item)
 SELECT item, round(CASE WHEN l + r > 0 THEN abs(l - r) / (l + r) END, 4) AS hand_balance, round(s / d, 4) AS scratch_nps FROM c""")
def seq_balance(spark, sf):
    return rd(Q.balance(t.notes(spark, sf), t.TICKS))


@query("seq_ln_dur", f"WITH {N} SELECT item, round(avg(dur), 4) AS ln_mean_dur FROM notes WHERE type = 1 AND dur > 0 GROUP BY item")
def seq_ln_dur(spark, sf):
    return rd(t.notes(spark, sf).filter("type = 1 and dur > 0").groupBy("item").agg(F.avg("dur").alias("ln_mean_dur")))


D17 = f"""WITH {N}, nw AS (SELECT item, CAST(greatest(ceil(max(tick) / 16.0), 1) AS BIGINT) AS n FROM notes GROUP BY item), sp AS (SELECT item, n, unnest(range(n)) AS sec FROM nw),
 cc AS (SELECT sp.item, sp.n, sp.sec, count(tick) AS c FROM sp LEFT JOIN notes ON notes.item = sp.item AND least(tick // 16, sp.n - 1) = sp.sec GROUP BY 1, 2, 3), cd AS (SELECT *, abs(c - lag(c) OVER (PARTITION BY item ORDER BY sec)) AS d FROM cc),
 a AS (SELECT item, stddev_pop(c) AS density_std, avg(CAST(c >= 4 AS INT)) AS high_density_frac, coalesce(avg(d), 0) AS density_change_mean, CAST(coalesce(max(d), 0) AS DOUBLE) AS density_change_max FROM cd GROUP BY item),
 g0 AS (SELECT item, tick, tick - lag(tick) OVER (PARTITION BY item ORDER BY tick, event_id) AS gap FROM notes), g1 AS (SELECT *, lag(gap) OVER (PARTITION BY item ORDER BY tick) AS pg FROM g0 WHERE gap > 0),
 b AS (SELECT item, avg(gap / 16.0) AS gap_mean, stddev_pop(gap / 16.0) AS gap_std, stddev_pop(gap / 16.0) / avg(gap / 16.0) AS gap_cv, avg(CAST(gap / 16.0 < 0.2 AS INT)) AS tiny_gap_frac, coalesce(avg(CASE WHEN pg IS NOT NULL THEN CAST(abs(gap - pg) / 16.0 < 0.005 AS INT) END), 0) AS rhythm_repeat_frac FROM g1 GROUP BY item),
 l0 AS (SELECT *, lag(lane) OVER (PARTITION BY item ORDER BY tick, lane, event_id) AS pl, row_number() OVER (PARTITION BY item ORDER BY tick, lane, event_id) - row_number() OVER (PARTITION BY item, lane ORDER BY tick, lane, event_id) AS isl FROM notes),
 m AS (SELECT item, avg(abs(lane - pl)) AS lane_move_mean, stddev_pop(abs(lane - pl)) AS lane_move_std, avg(CASE WHEN pl IS NOT NULL THEN CAST(abs(lane - pl) >= 4 AS INT) END) AS large_move_frac FROM l0 GROUP BY item),
 ru AS (SELECT item, CAST(max(c) AS DOUBLE) AS max_same_lane_run FROM (SELECT item, count(*) AS c FROM l0 GROUP BY item, lane, isl) GROUP BY item),
 ch AS (SELECT item, tick, count(*) AS size, max(lane) - min(lane) AS span, min(lane) = 0 AS scr, avg(lane) AS cent FROM notes GROUP BY 1, 2), sz AS (SELECT item, avg(size) AS chord_size_mean FROM ch GROUP BY item),
 c2 AS (SELECT *, abs(cent - lag(cent) OVER (PARTITION BY item ORDER BY tick)) AS mv FROM ch WHERE size >= 2), sh AS (SELECT item, avg(span) AS chord_span_mean, avg(CAST(scr AS INT)) AS scratch_chord_frac, coalesce(avg(mv), 0) AS chord_centroid_move FROM c2 GROUP BY item)
 SELECT a.item, {', '.join(f'round(coalesce({q}, 0), 4) AS {q}' for q in Q.QUANTITIES)} FROM a LEFT JOIN b USING (item) LEFT JOIN m USING (item) LEFT JOIN ru USING (item) LEFT JOIN sz USING (item) LEFT JOIN sh USING (item)"""


@query("seq_density17", D17)
def seq_density17(spark, sf):
    n, hot = nh(spark, sf)
    return rd(Q.density17(n, t.TICKS, high=4, tiny_sec=0.2, hot=hot)).select("item", *Q.QUANTITIES)


@query("seq_mask_rows", f"WITH {N} SELECT item, tick, CAST(bit_or(1 << lane) AS BIGINT) AS mask FROM notes GROUP BY 1, 2")
def seq_mask_rows(spark, sf):
    return Q.mask_rows(t.notes(spark, sf))


POS = """p AS (SELECT item, tick, CAST(coalesce(bit_or(CASE WHEN lane >= 1 THEN 1 << (lane - 1) END), 0) AS BIGINT) AS mask, bool_or(lane = 0) AS scratch FROM nn GROUP BY 1, 2),
 p2 AS (SELECT *, lead(tick) OVER (PARTITION BY item ORDER BY tick) - tick AS gap, row_number() OVER (PARTITION BY item ORDER BY tick) - 1 AS x FROM p),
 ps AS (SELECT *, CASE WHEN gap IS NULL THEN 0.0 ELSE least(min(gap) OVER (PARTITION BY item) / gap, 1.0) END AS w FROM p2)"""


@query("seq_mask_gaps", f"WITH {N}, nn AS (SELECT * FROM notes), {POS} SELECT item, tick, mask, scratch, round(w, 6) AS w FROM ps")
def seq_mask_gaps(spark, sf):
    n, hot = nh(spark, sf)
    return Q.positions(n, hot).select("item", "tick", "mask", "scratch", r("w").alias("w"))


NN = "nn AS (SELECT item, event_id, tick, lane FROM notes)"
_P = [f"p{i}" for i in range(1, 8)]
_LANE = [f"CASE WHEN mask & {1 << i} > 0 THEN {p} END" for i, p in enumerate(_P)]
ORDERS = f"""l AS (SELECT unnest(range(1, 8)) AS l), pm AS (SELECT {', '.join(f'l{i}.l AS p{i}' for i in range(1, 8))} FROM {', '.join(f'l l{i}' for i in range(1, 8))}
 WHERE {' AND '.join(f'l{j}.l <> l{i}.l' for i in range(1, 8) for j in range(1, i))}), mk AS (SELECT unnest(range(128)) AS mask),
 mp AS (SELECT concat({', '.join(_P)}) AS perm, mask, coalesce({' + '.join(f'coalesce({x}, 0)' for x in _LANE)}, 0) / greatest(bit_count(mask), 1) AS y,
 coalesce(greatest({', '.join(_LANE)}) - least({', '.join(_LANE)}), 0) AS span FROM pm, mk)"""
PERM = f"""WITH {N}, {NN}, {POS}, {ORDERS}, pq AS (SELECT *, lag(mask) OVER (PARTITION BY item ORDER BY x) AS before FROM ps),
 f AS (SELECT pq.item, mp.perm, pq.x, pq.w, mp.y, mp.span, abs(mp.y - b.y) AS hop FROM pq JOIN mp ON mp.mask = pq.mask LEFT JOIN mp b ON b.mask = pq.before AND b.perm = mp.perm),
 s AS (SELECT item, perm, count(*) AS np, sum(w) AS sw, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy, sum(w * x * y) AS wxy, sum(w * y * y) AS wyy, sum(w * span) AS ws, sum(w * coalesce(hop, 0)) AS wh FROM f GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(w) > 0),
 q AS (SELECT *, CASE WHEN wxx - wx * wx / sw > 1e-9 THEN (wxy - wx * wy / sw) / (wxx - wx * wx / sw) END AS sl FROM s), m AS (SELECT item, perm = '1234567' AS base, CASE WHEN sl IS NULL THEN 0 ELSE sqrt(greatest((wyy - wy * wy / sw - sl * (wxy - wx * wy / sw)) / sw, 0)) END AS smooth, ws / sw AS tight, (ws + wh) / sw AS base_v, sqrt(greatest(wyy / sw - (wy / sw) ** 2, 0)) AS spread FROM q),
 b AS (SELECT item, smooth AS bs, tight AS bt, base_v AS bb, spread AS bp FROM m WHERE base)
 SELECT m.item, {', '.join(f"round(avg({c}), 4) AS ps_{n}_mean, round(stddev_pop({c}), 4) AS ps_{n}_std, round(min({c}), 4) AS ps_{n}_min, round(max({c}), 4) AS ps_{n}_max, round(avg(CAST({c} < {b} - 1e-9 AS INT)), 4) AS ps_{n}_base_pct" for n, c, b in (('smooth', 'smooth', 'bs'), ('tight', 'tight', 'bt'), ('base', 'base_v', 'bb'), ('spread', 'spread', 'bp')))} FROM m JOIN b USING (item) GROUP BY m.item"""


@query("seq_perm_space", PERM)
def seq_perm_space(spark, sf):
    n, hot = nh(spark, sf)
    return rd(Q.perm_space(n, hot=hot))


@query("jn_cross_perm", f"""WITH {N}, {NN}, {POS}, {ORDERS} SELECT item, perm, round(sum(w * y) / sum(w), 4) AS mean_lane FROM ps JOIN mp USING (mask) GROUP BY item, perm HAVING sum(w) > 0""")
def jn_cross_perm(spark, sf):
    """Items x lane orders: each item's mask histogram (<= 128 rows) meets the table of all orders."""
    n, hot = nh(spark, sf)
    return Q.mean_lanes(n, hot=hot).select("item", "perm", r("mean_lane", 4).alias("mean_lane"))


@query("seq_scratch_frac", f"WITH {N}, nn AS (SELECT * FROM notes), {POS} SELECT item, round(avg(CAST(scratch AS INT)), 4) AS scratch_frac, round(avg(CAST(scratch AND mask <> 0 AS INT)), 4) AS scratch_key_frac FROM ps GROUP BY item")
def seq_scratch_frac(spark, sf):
    p = t.notes(spark, sf).groupBy("item", "tick").agg(F.bool_or(F.col("lane") == 0).alias("s"), F.bool_or(F.col("lane") > 0).alias("k"))
    return rd(p.groupBy("item").agg(F.avg(F.col("s").cast("int")).alias("scratch_frac"), F.avg((F.col("s") & F.col("k")).cast("int")).alias("scratch_key_frac")))


WIN = "w0 AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY tick, lane, event_id) - 1 AS o, count(*) OVER (PARTITION BY item) AS cnt FROM notes), w AS (SELECT *, o // 8 AS win, CAST(o % 8 AS INT) AS pos FROM w0 WHERE (o // 8 + 1) * 8 <= cnt)"


@query("seq_windows", f"WITH {N}, {WIN} SELECT item, win, pos, tick, lane, item % 13 AS label FROM w")
def seq_windows(spark, sf):
    n, hot = nh(spark, sf)
    return Q.windows(n, 8, hot).select("item", "win", "pos", "tick", "lane", (F.col("item") % 13).alias("label"))


@query("seq_delta", f"WITH {N}, {WIN} SELECT item, win, pos, round(ln(1 + coalesce(tick - lag(tick) OVER (PARTITION BY item, win ORDER BY pos), 0) / 16.0), 6) AS delta FROM w")
def seq_delta(spark, sf):
    n, hot = nh(spark, sf)
    return Q.window_delta(Q.windows(n, 8, hot)).select("item", "win", "pos", r(F.log1p(F.col("gap") / 16.0)).alias("delta"))


@query("seq_timepoints", f"WITH {N}, p AS (SELECT item, tick, CAST(bit_or(1 << lane) AS BIGINT) AS mask, max(type) AS has_ln FROM notes GROUP BY 1, 2) SELECT item, tick, mask, has_ln, round(ln(1 + coalesce(tick - lag(tick) OVER (PARTITION BY item ORDER BY tick), 0) / 16.0), 6) AS log_gap, {', '.join(f'CAST((mask >> {i}) & 1 AS INT) AS lane{i}' for i in range(8))} FROM p")
def seq_timepoints(spark, sf):
    n, hot = nh(spark, sf)
    p = Q.timepoints(n, hot)
    return p.select("item", "tick", "mask", "has_ln", r(F.log1p(F.col("gap") / 16.0)).alias("log_gap"), *[F.shiftright("mask", i).bitwiseAND(1).cast("int").alias(f"lane{i}") for i in range(8)])


@query("seq_onehot", f"WITH {N} SELECT event_id, {', '.join(f'CAST(lane = {i} AS INT) AS lane{i}' for i in range(8))} FROM notes")
def seq_onehot(spark, sf):
    return t.notes(spark, sf).select("event_id", *[(F.col("lane") == i).cast("int").alias(f"lane{i}") for i in range(8)])


@query("seq_zscore", f"""WITH {N}, {WIN}, d AS (SELECT item, win, pos, lane, coalesce(tick - lag(tick) OVER (PARTITION BY item, win ORDER BY pos), 0) AS gap, {S.draw_hex("'win'", 'item')} >= '33333333' AS is_train FROM w),
 f AS (SELECT avg(lane) AS ml, stddev_pop(lane) AS sl, avg(gap) AS mg, stddev_pop(gap) AS sg FROM d WHERE is_train) SELECT item, win, pos, round((lane - ml) / CASE WHEN sl = 0 THEN 1 ELSE sl END, 4) AS z_lane, round((gap - mg) / CASE WHEN sg = 0 THEN 1 ELSE sg END, 4) AS z_gap FROM d, f""")
def seq_zscore(spark, sf):
    n, hot = nh(spark, sf)
    d = Q.window_delta(Q.windows(n, 8, hot)).withColumn("is_train", draw_hex("win", F.col("item")) >= "33333333")
    tr = d.filter("is_train")

    def z(c):
        sd = tr.agg(F.stddev_pop(c)).scalar()
        return r((F.col(c) - tr.agg(F.avg(c)).scalar()) / F.when(sd == 0, 1.0).otherwise(sd), 4).alias(f"z_{c}")

    return d.select("item", "win", "pos", z("lane"), z("gap"))


SHUF = f"""sa AS (SELECT *, row_number() OVER (PARTITION BY {{k}} ORDER BY tick, event_id) AS i FROM {{src}}), sb AS (SELECT {{k}}, lane AS new_lane, row_number() OVER (PARTITION BY {{k}} ORDER BY {S.draw_hex("'ls'", 'event_id')}, event_id) AS i FROM {{src}}), sv AS (SELECT sa.*, new_lane FROM sa JOIN sb USING ({{k}}, i))"""


@query("seq_lane_shuffle", f"WITH {N}, {SHUF.format(k='item', src='notes')} SELECT item, event_id, lane, new_lane FROM sv")
def seq_lane_shuffle(spark, sf):
    n, hot = nh(spark, sf)
    return Q.shuffle_lanes(n, ["item"], "ls", hot).select("item", "event_id", "lane", "new_lane")


@query("seq_lane_perm", f"WITH {N} SELECT event_id, tick + 8 AS tick, CASE WHEN lane < 7 THEN 6 - lane ELSE lane END AS lane FROM notes")
def seq_lane_perm(spark, sf):
    perm = F.array(*[F.lit(6 - i) for i in range(7)])
    return t.notes(spark, sf).select("event_id", (F.col("tick") + 8).alias("tick"), F.when(F.col("lane") < 7, F.try_element_at(perm, F.col("lane") + 1)).otherwise(F.col("lane")).alias("lane"))


@query("seq_pool_vec", """SELECT label, CAST(dim AS INT) AS dim, round(avg(v), 5) AS value FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY 1, 2""")
def seq_pool_vec(spark, sf):
    return rd(Q.pool_vectors(t.table(spark, sf, "embeddings", "label", "embedding"), "label", "embedding"), 5)


@query("seq_vec_drift", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0.9 + 0.01) AS b FROM embeddings)
 SELECT vec_id, round(list_cosine_similarity(a, b), 5) AS cosine, round(list_distance(a, b), 5) AS l2 FROM v""")
def seq_vec_drift(spark, sf):
    v = t.table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("a", F.col("embedding").cast("array<double>"))
    v = v.withColumn("b", F.transform("a", lambda x: x * 0.9 + 0.01))
    cos, l2 = Q.vector_drift(F.col("a"), F.col("b"))
    return v.select("vec_id", r(cos, 5).alias("cosine"), r(l2, 5).alias("l2"))
