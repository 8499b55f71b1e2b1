"""Causal history over the play log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import acc_first, draw_hex, r
from ..operators import causal, ranks, skew
from ..sources import tables as t
from . import sqlparts as S
from .registry import query

ORD = t.FP_ORDER
W_SQL = f"OVER (PARTITION BY player ORDER BY ts, seq, item {S.PRIOR})"


def fp_hot(spark, sf):
    return t.first_plays(spark, sf), t.hot(spark, sf, "player")


@query("flagship", f"""WITH {S.FP}, h AS (SELECT *, count(*) {W_SQL} AS n0, avg(acc) {W_SQL} AS m0, stddev_pop(acc) {W_SQL} AS s0,
 avg(CASE WHEN lamp = 1 THEN 1.0 ELSE 0 END) {W_SQL} AS f0 FROM fp),
 cut AS (SELECT player, quantile_cont(ts, 0.5) AS t1, quantile_cont(ts, 0.75) AS t2 FROM fp GROUP BY player),
 ph AS (SELECT h.*, CASE WHEN ts <= t1 THEN 'history' WHEN ts <= t2 THEN 'train' ELSE 'test' END AS phase FROM h JOIN cut USING (player))
 SELECT phase, player, count(*) AS n, round(avg(acc), 4) AS acc_mean, round(avg(CASE WHEN lamp = 1 THEN 1.0 ELSE 0 END), 4) AS fail_rate,
 round(avg(m0), 4) AS hist_acc, round(avg(CASE WHEN n0 > 1 THEN s0 END), 4) AS hist_std, round(avg(f0), 4) AS hist_fail
 FROM ph WHERE phase <> 'history' GROUP BY phase, player""")
def flagship(spark, sf):
    fp, hot = fp_hot(spark, sf)
    h = causal.history(fp, ORD, hot)
    ph = causal.phase(h, hot).filter(F.col("phase") != "history")
    fail = (F.col("lamp") == 1).cast("double")
    return ph.groupBy("phase", "player").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("acc"), 4).alias("acc_mean"), r(F.avg(fail), 4).alias("fail_rate"),
        r(F.avg("h_acc_mean"), 4).alias("hist_acc"), r(F.avg("h_acc_std"), 4).alias("hist_std"),
        r(F.avg("h_fail_rate"), 4).alias("hist_fail"),
    )


KEY = ["player", "item"]


@query("win_first_play", f"WITH {S.LOG} SELECT player, item, ts, acc, lamp, bp FROM (SELECT *, row_number() OVER (PARTITION BY player, item ORDER BY ts, seq, price) AS rn FROM log) WHERE rn = 1")
def win_first_play(spark, sf):
    return causal.first_play(t.play_log(spark, sf), t.PLAY_ORDER).select(*KEY, "ts", "acc", "lamp", "bp")


@query("flt_attempt", f"WITH {S.FP} SELECT player, item, ts, acc, lamp FROM fp")
def flt_attempt(spark, sf):
    return causal.attempts(causal.first_play(t.play_log(spark, sf), t.PLAY_ORDER)).select(*KEY, "ts", "acc", "lamp")


@query("agg_group_summary", f"""WITH {S.FP}, cut AS (SELECT player, quantile_cont(ts, 0.5) AS t1, quantile_cont(ts, 0.75) AS t2 FROM fp GROUP BY player)
 SELECT CASE WHEN ts <= t1 THEN 'history' WHEN ts <= t2 THEN 'train' ELSE 'test' END AS phase, player, count(*) AS n, round(avg(acc), 4) AS acc_mean,
 round(avg(CAST(lamp = 1 AS INT)), 4) AS fail_rate FROM fp JOIN cut USING (player) GROUP BY 1, 2""")
def agg_group_summary(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.phase(fp, hot).groupBy("phase", "player").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("acc"), 4).alias("acc_mean"), r(F.avg((F.col("lamp") == 1).cast("int")), 4).alias("fail_rate"))


@query("agg_cut_quantile", f"WITH {S.FP} SELECT player, quantile_cont(ts, 0.5) AS t_train, quantile_cont(ts, 0.75) AS t_test FROM fp GROUP BY player")
def agg_cut_quantile(spark, sf):
    return causal.cutoffs(*fp_hot(spark, sf))


@query("win_phase", f"""WITH {S.FP}, cut AS (SELECT player, quantile_cont(ts, 0.5) AS t1, quantile_cont(ts, 0.75) AS t2 FROM fp GROUP BY player)
 SELECT player, item, CASE WHEN ts <= t1 THEN 'history' WHEN ts <= t2 THEN 'train' ELSE 'test' END AS phase FROM fp JOIN cut USING (player)""")
def win_phase(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.phase(fp, hot).select(*KEY, "phase")


@query("win_prior_counts", f"WITH {S.FP} SELECT player, item, count(*) {W_SQL} AS h_n_firstplays, count(acc) {W_SQL} AS h_n_known_acc FROM fp")
def win_prior_counts(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.history(fp, ORD, hot).select(*KEY, "h_n_firstplays", F.col("h_n_known_acc").cast("long").alias("h_n_known_acc"))


@query("win_prior_mean_std", f"""WITH {S.FP} SELECT player, item, round(avg(acc) {W_SQL}, 4) AS h_acc_mean,
 round(CASE WHEN count(acc) {W_SQL} > 1 THEN stddev_pop(acc) {W_SQL} END, 4) AS h_acc_std FROM fp""")
def win_prior_mean_std(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.history(fp, ORD, hot).select(*KEY, r("h_acc_mean", 4).alias("h_acc_mean"), r("h_acc_std", 4).alias("h_acc_std"))


@query("win_prior_rates", f"""WITH {S.SAMPLES} SELECT player, item, round(avg(CAST(lamp = 1 AS INT)) {W_SQL}, 4) AS h_fail_rate,
 round(avg(CAST(lamp >= 8 AS INT)) {W_SQL}, 4) AS h_fc_rate, round(avg(bp) {W_SQL}, 4) AS h_bp_mean,
 round(avg(bp / notes) {W_SQL}, 4) AS h_bp_ratio_mean FROM smp""")
def win_prior_rates(spark, sf):
    h = causal.history(t.samples(spark, sf), ORD, t.hot(spark, sf, "player"))
    return h.select(*KEY, *[r(c, 4).alias(c) for c in ("h_fail_rate", "h_fc_rate", "h_bp_mean", "h_bp_ratio_mean")])


@query("win_days_span", f"WITH {S.FP} SELECT player, item, CASE WHEN count(*) {W_SQL} > 0 THEN (ts - min(ts) OVER (PARTITION BY player)) / 86400.0 END AS h_days_span FROM fp")
def win_days_span(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.history(fp, ORD, hot).select(*KEY, "h_days_span")


# acc is treated as unknown where bp = 3, so that "last 10 known" differs from "last 10"
LAST10 = f"""WITH {S.FP}, k AS (SELECT * EXCLUDE (acc), CASE WHEN bp <> 3 THEN acc END AS acc FROM fp),
 l AS (SELECT player, item, ts, seq, list(acc) FILTER (WHERE acc IS NOT NULL) {W_SQL} AS xs FROM k)
 SELECT player, item, round(list_avg(xs[-10:]), 4) AS h_acc_last10 FROM l"""


@query("win_last10", LAST10)
def win_last10(spark, sf):
    fp, hot = fp_hot(spark, sf)
    fp = fp.withColumn("acc", F.when(F.col("bp") != 3, F.col("acc")))
    return causal.last_known(fp, ORD, 10, hot).select(*KEY, r("h_acc_last10", 4).alias("h_acc_last10"))


ACT = f"""WITH {S.FP}, lg AS (SELECT player, ts, count(*) AS c FROM log GROUP BY 1, 2),
 d AS (SELECT player, ts, lag(ts) OVER (PARTITION BY player ORDER BY ts) AS prev,
 sum(c) OVER (PARTITION BY player ORDER BY ts RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS c30 FROM lg)
 SELECT player, item, (ts - prev) / 86400.0 AS h_days_since_active, CAST(coalesce(c30, 0) AS BIGINT) AS h_plays_last30d FROM fp JOIN d USING (player, ts)"""


@query("win_activity", ACT)
def win_activity(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.activity(fp, t.play_log(spark, sf), hot)


@query("jn_asof_last", f"""WITH {S.FP}, d AS (SELECT DISTINCT player, ts FROM log)
 SELECT fp.player, fp.item, (fp.ts - d.ts) / 86400.0 AS days_since_last FROM fp ASOF LEFT JOIN d ON fp.player = d.player AND fp.ts > d.ts""")
def jn_asof_last(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.activity(fp, t.play_log(spark, sf), hot).select(*KEY, F.col("h_days_since_active").alias("days_since_last"))


@query("jn_range_30d", f"""WITH {S.FP} SELECT player, item, (SELECT count(*) FROM log l WHERE l.player = fp.player AND l.ts >= fp.ts - 2592000 AND l.ts < fp.ts) AS plays_30d FROM fp""")
def jn_range_30d(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return causal.activity(fp, t.play_log(spark, sf), hot).select(*KEY, F.col("h_plays_last30d").alias("plays_30d"))


@query("win_synthetic_time", f"WITH {S.LOG} SELECT player, seq, item, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item, price) * 86400 AS ts FROM log")
def win_synthetic_time(spark, sf):
    return causal.synthetic_time(t.play_log(spark, sf), ["ts", "seq", "item", "price"], t.hot(spark, sf, "player")).select("player", "seq", "item", "ts")


@query("win_time_shuffle", f"""WITH {S.FP}, a AS (SELECT player, ts, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS i FROM fp),
 b AS (SELECT player, item, acc, row_number() OVER (PARTITION BY player ORDER BY {S.draw_hex("'7'", "player", "item")}, ts, seq, item) AS i FROM fp)
 SELECT player, item, acc, ts AS new_ts FROM b JOIN a USING (player, i)""")
def win_time_shuffle(spark, sf):
    from ..functions.columns import draw_long

    fp, hot = fp_hot(spark, sf)
    return causal.shuffle_time(fp, ORD, draw_long("7", F.col("player"), F.col("item")), hot).select(*KEY, "acc", "new_ts")


MASKED = S.draw_hex("'mask'", "player", "seq", "item")


@query("win_time_mask", f"""WITH {S.FP}, kept AS (SELECT * FROM log WHERE {MASKED} >= '4ccccccc'), lg AS (SELECT player, ts, count(*) AS c FROM kept GROUP BY 1, 2),
 q AS (SELECT player, ts FROM fp UNION SELECT player, ts FROM lg), g AS (SELECT player, ts, coalesce(c, 0) AS c FROM q LEFT JOIN lg USING (player, ts)),
 d AS (SELECT player, ts, max(CASE WHEN c > 0 THEN ts END) {W_SQL.replace(', seq, item', '')} AS prev,
 sum(c) OVER (PARTITION BY player ORDER BY ts RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS c30 FROM g)
 SELECT player, item, (ts - prev) / 86400.0 AS h_days_since_active, CAST(coalesce(c30, 0) AS BIGINT) AS h_plays_last30d FROM fp JOIN d USING (player, ts)""")
def win_time_mask(spark, sf):
    fp, hot = fp_hot(spark, sf)
    kept = t.play_log(spark, sf).filter(draw_hex("mask", F.col("player"), F.col("seq"), F.col("item")) >= "4ccccccc")
    return causal.activity(fp, kept, hot)


@query("win_drift", f"""WITH {S.FP}, r AS (SELECT player, rank() OVER (PARTITION BY player ORDER BY acc) + (count(*) OVER (PARTITION BY player, acc) - 1) / 2.0 AS ra,
 rank() OVER (PARTITION BY player ORDER BY ts) + (count(*) OVER (PARTITION BY player, ts) - 1) / 2.0 AS rt FROM fp)
 SELECT player, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rt) > 0 THEN corr(ra, rt) END, 4) AS rho FROM r GROUP BY player""")
def win_drift(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return ranks.spearman(fp, ["player"], "acc", "ts", None if hot is None else hot).select("player", "n", r("rho", 4).alias("rho"))


@query("win_event_seq", f"""WITH {S.FP}, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY player ORDER BY ts, seq, item), 0) AS gap FROM fp),
 e AS (SELECT player, item, list(concat_ws('/', item, lamp, gap)) OVER (PARTITION BY player ORDER BY ts, seq, item ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS ev FROM g)
 SELECT player, item, CAST(100 - coalesce(len(ev), 0) AS INT) AS n_pad, md5(coalesce(array_to_string(ev, ','), '')) AS ev_hash FROM e""")
def win_event_seq(spark, sf):
    fp, hot = fp_hot(spark, sf)
    e = causal.prior_events(fp.withColumn("it", F.col("item")), ORD, 100, ["it", "lamp"], hot)
    txt = F.array_join(F.transform("events", lambda x: F.concat_ws("/", x["it"], x["lamp"], x["gap"])), ",")
    return e.select(*KEY, F.col("n_pad").cast("int").alias("n_pad"), F.md5(txt).alias("ev_hash"))


@query("win_fewshot_k", f"""WITH {S.FP}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS rk FROM fp),
 ks AS (SELECT unnest([0, 1, 5, 10, 20, 50, 100, 200]) AS k)
 SELECT player, k, count(*) FILTER (WHERE rk <= k) AS n_prefix, count(*) FILTER (WHERE rk > k AND rk <= k + 150) AS n_target,
 round(avg(acc) FILTER (WHERE rk > k AND rk <= k + 150), 4) AS target_acc FROM r, ks GROUP BY player, k""")
def win_fewshot_k(spark, sf):
    fp, hot = fp_hot(spark, sf)
    rk = skew.prefix(fp, ["player"], ORD, {"rk": ("rank",)}, hot)
    aggs = []
    ks = [0, 1, 5, 10, 20, 50, 100, 200]
    for k in ks:  # all k in one aggregation pass instead of one copy of the rows per k
        tg = (F.col("rk") > k) & (F.col("rk") <= k + 150)
        aggs += [F.count(F.when(F.col("rk") <= k, 1)).alias(f"p{k}"), F.count(F.when(tg, 1)).alias(f"t{k}"), F.avg(F.when(tg, F.col("acc"))).alias(f"a{k}")]
    wide = rk.groupBy("player").agg(*aggs)
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("n_prefix"), F.col(f"t{k}").alias("n_target"), r(f"a{k}", 4).alias("target_acc")) for k in ks]))
    return wide.select("player", long.alias("s")).select("player", "s.*")


@query("win_prefix_hist", f"""WITH {S.SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS rk FROM smp), p AS (SELECT * FROM r WHERE rk <= 20)
 SELECT player, count(*) AS n, round(avg(acc), 4) AS acc_mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(acc) END, 4) AS acc_std,
 round(avg(acc) FILTER (WHERE rk > cnt - 10), 4) AS acc_last10, round(avg(CAST(lamp = 1 AS INT)), 4) AS fail_rate, round(avg(CAST(lamp >= 8 AS INT)), 4) AS fc_rate,
 round(avg(bp), 4) AS bp_mean, round(avg(bp / notes), 4) AS bp_ratio_mean, (max(ts) - min(ts)) / 86400.0 AS days_span
 FROM (SELECT *, count(*) OVER (PARTITION BY player) AS cnt FROM p) GROUP BY player""")
def win_prefix_hist(spark, sf):
    smp = t.samples(spark, sf)
    p = ranks.top_n(smp, ["player"], ORD, 20, "rk")
    n = F.count(F.lit(1))
    # the prefix is at most 20 rows per player, so the tail mean reads one short sorted array
    last = F.array_sort(F.collect_list(F.struct("rk", "acc")))
    acc = F.transform(last, lambda x: x["acc"])
    recent = F.slice(acc, F.greatest(F.size(acc) - 9, F.lit(1)), 10)
    mean_recent = F.aggregate(recent, F.lit(0.0), lambda a, x: a + x) / F.size(recent)
    return p.groupBy("player").agg(
        n.alias("n"), r(F.avg("acc"), 4).alias("acc_mean"), r(F.when(n > 1, F.stddev_pop("acc")), 4).alias("acc_std"),
        r(mean_recent, 4).alias("acc_last10"), r(F.avg((F.col("lamp") == 1).cast("int")), 4).alias("fail_rate"),
        r(F.avg((F.col("lamp") >= 8).cast("int")), 4).alias("fc_rate"), r(F.avg("bp"), 4).alias("bp_mean"),
        r(F.avg(F.col("bp") / F.col("notes")), 4).alias("bp_ratio_mean"), ((F.max("ts") - F.min("ts")) / 86400.0).alias("days_span"))


@query("top_stable_sort", f"""WITH {S.FP} SELECT player, item, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) AS pos FROM fp""")
def top_stable_sort(spark, sf):
    fp, hot = fp_hot(spark, sf)
    return skew.prefix(fp, ["player"], ORD, {"pos": ("rank",)}, hot).select(*KEY, "pos")


@query("prj_acc_first", f"WITH {S.SAMPLES} SELECT player, item, round(CASE WHEN notes > 0 THEN ex * 50.0 / notes END, 6) AS acc_notes FROM smp")
def prj_acc_first(spark, sf):
    return t.samples(spark, sf).select(*KEY, r(acc_first("ex", "notes")).alias("acc_notes"))
