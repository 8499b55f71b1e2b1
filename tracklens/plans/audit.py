"""Audit and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import draw_long, r
from ..operators import audit, joins, ranks
from ..session import cut
from ..sources import tables as t
from . import sqlparts as S
from .joins import LV, level_tables, levels, team_items
from .registry import query

KEY = ["player", "item"]
AUTO = "auto"  # low-cardinality keys: hot groups are detected on the compressed rows


@query("agg_collapse_best", f"WITH {S.BEST} SELECT player, item, acc, lamp, bp, plays FROM best")
def agg_collapse_best(spark, sf):
    return t.best_rows(spark, sf)


@query("agg_first_last", f"""WITH {S.LOG} SELECT player, item, arg_min(acc, (ts, seq, price)) AS first_acc, arg_max(acc, (ts, seq, price)) AS last_acc FROM log GROUP BY 1, 2""")
def agg_first_last(spark, sf):
    o = F.struct(*t.PLAY_ORDER)
    return t.play_log(spark, sf).groupBy(*KEY).agg(F.min_by("acc", o).alias("first_acc"), F.max_by("acc", o).alias("last_acc"))


def hashed_docs(spark, sf):
    return t.table(spark, sf, "documents", "doc_id", "text", "lang").select("doc_id", "lang", F.md5("text").alias("h"))


@query("agg_canonical_dup", """WITH d AS (SELECT doc_id, lang, md5(text) AS h FROM documents) SELECT doc_id, count(*) OVER (PARTITION BY h) AS group_size,
 row_number() OVER (PARTITION BY h ORDER BY doc_id) AS group_rank, bool_or(lang = 'en') OVER (PARTITION BY h) AS any_flag, min(doc_id) OVER (PARTITION BY h) AS canonical FROM d""")
def agg_canonical_dup(spark, sf):
    return audit.canonical(hashed_docs(spark, sf), "h", "doc_id", F.col("lang") == "en").select("doc_id", "group_size", "group_rank", "any_flag", "canonical")


@query("agg_dedupe_report", """SELECT h, n, n - 1 AS extra, first_id, last_id FROM (SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1)
 WHERE n > 1 ORDER BY n DESC, h LIMIT 20""")
def agg_dedupe_report(spark, sf):
    return audit.duplicate_report(hashed_docs(spark, sf), "h", "doc_id", 20)


PROF = "count({v}) AS n, min({v}) AS min, max({v}) AS max, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(quantile_cont({v}, 0.1), 4) AS p10, round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.75), 4) AS p75, round(quantile_cont({v}, 0.9), 4) AS p90"


@query("agg_quantiles", f"WITH {S.BEST}, {S.CLIENTS} SELECT client, {PROF.format(v='acc')} FROM best JOIN clients USING (player) GROUP BY client")
def agg_quantiles(spark, sf):
    p = audit.profile(t.best_rows(spark, sf).join(t.clients(spark, sf), "player"), ["client"], "acc", AUTO)
    return p.select("client", "n", "min", "max", *[r(x, 4).alias(x) for x in ("mean", "std", "p10", "p25", "median", "p75", "p90")])


@query("agg_matrix_audit", f"""WITH {S.BEST}, i AS (SELECT item, count(*) AS n FROM best GROUP BY item), s AS (SELECT count(DISTINCT player) AS players, count(DISTINCT item) AS items, count(*) AS n,
 count(*) FILTER (WHERE plays > 1) AS dup, count(*) FILTER (WHERE acc IS NULL) AS missing, count(*) FILTER (WHERE bp > 6 AND lamp >= 5) AS anomalies FROM best),
 m AS (SELECT players, items, n, dup, missing, anomalies, n / (players * items) AS density, (SELECT avg(CAST(n >= 2 AS INT)) FROM i) AS share2, (SELECT avg(CAST(n >= 3 AS INT)) FROM i) AS share3 FROM s)
 SELECT metric, round(value, 6) AS value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM m) UNPIVOT (value FOR metric IN (players, items, n, dup, missing, anomalies, density, share2, share3))""")
def agg_matrix_audit(spark, sf):
    b = t.best_rows(spark, sf)
    base = b.agg(F.countDistinct("player").alias("players"), F.countDistinct("item").alias("items"), F.count(F.lit(1)).alias("n"),
                 F.count(F.when(F.col("plays") > 1, 1)).alias("dup"), F.count(F.when(F.col("acc").isNull(), 1)).alias("missing"),
                 F.count(F.when((F.col("bp") > 6) & (F.col("lamp") >= 5), 1)).alias("anomalies"))
    per = b.groupBy("item").agg(F.count(F.lit(1)).alias("c"))
    share = per.agg(F.avg((F.col("c") >= 2).cast("int")).alias("share2"), F.avg((F.col("c") >= 3).cast("int")).alias("share3"))
    wide = base.withColumn("density", F.col("n") / (F.col("players") * F.col("items")))
    return audit.metrics_long(wide).unionByName(audit.metrics_long(share)).select("metric", r("value").alias("value"))


BINS = ["satellite", "stella", "insane", "normal", "none"]
BIN_SQL = f"WITH {S.FP}, {S.CLIENTS}, {LV}, b AS (SELECT fp.*, team, coalesce(\"table\", 'none') AS bin FROM fp JOIN clients USING (player) LEFT JOIN lv ON fp.item = lv.item)"


@query("agg_pivot_cover", BIN_SQL + " SELECT team, " + ", ".join(f"count(*) FILTER (WHERE bin = '{x}') AS {x}" for x in BINS) + " FROM b GROUP BY team")
def agg_pivot_cover(spark, sf):
    return team_items(spark, sf).groupBy("team").pivot("bin", BINS).count().fillna(0)


@query("agg_sparsity_verdict", BIN_SQL + """, i AS (SELECT bin, item, count(DISTINCT team) AS teams, count(*) AS n FROM b GROUP BY 1, 2),
 s AS (SELECT bin, count(*) FILTER (WHERE teams >= 20) AS shared_items, CAST(sum(n) AS BIGINT) AS n_rows FROM i GROUP BY bin)
 SELECT bin, shared_items, n_rows, CASE WHEN shared_items >= 150 AND n_rows >= 8000 THEN 'ok' WHEN shared_items >= 50 THEN 'sparse' ELSE 'very sparse' END AS verdict FROM s""")
def agg_sparsity_verdict(spark, sf):
    i = team_items(spark, sf).groupBy("bin", "item").agg(F.size(F.collect_set("team")).cast("long").alias("teams"), F.count(F.lit(1)).alias("n"))
    s = i.groupBy("bin").agg(F.count(F.when(F.col("teams") >= 20, 1)).alias("shared_items"), F.sum("n").alias("n_rows"))
    return s.withColumn("verdict", F.when((F.col("shared_items") >= 150) & (F.col("n_rows") >= 8000), "ok").when(F.col("shared_items") >= 50, "sparse").otherwise("very sparse"))


@query("agg_corpus_report", """WITH g AS (SELECT md5(text) AS h, count(*) AS c FROM documents GROUP BY 1)
 SELECT 'lang' AS report, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
 UNION ALL SELECT 'copies', CAST(c AS VARCHAR), count(*) FROM g GROUP BY c""")
def agg_corpus_report(spark, sf):
    d = t.table(spark, sf, "documents", "text", "lang", "source")

    def hist(df, name, key):
        return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("report", F.lit(name))

    copies = d.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return hist(d, "lang", "lang").unionByName(hist(d, "source", "source")).unionByName(hist(copies, "copies", "c"))


@query("agg_song_summary", f"""WITH {S.ITEMS}, g AS (SELECT title, count(*) AS n, min(x2) AS dur_min, max(x2) AS dur_max, min(notes) AS notes_min, max(notes) AS notes_max FROM items GROUP BY title)
 SELECT title, n, dur_min, dur_max, notes_min, notes_max, n >= 2 AND ((dur_max - dur_min) / greatest(dur_min, 1e-6) > 0.5 OR notes_max / greatest(notes_min, 1e-6) > 5) AS flagged FROM g""")
def agg_song_summary(spark, sf):
    g = t.items(spark, sf).groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("x2").alias("dur_min"), F.max("x2").alias("dur_max"), F.min("notes").alias("notes_min"), F.max("notes").alias("notes_max"))
    span = (F.col("dur_max") - F.col("dur_min")) / F.greatest("dur_min", F.lit(1e-6))
    ratio = F.col("notes_max") / F.greatest(F.col("notes_min").cast("double"), F.lit(1e-6))
    return g.withColumn("flagged", (F.col("n") >= 2) & ((span > 0.5) | (ratio > 5)))


@query("agg_song_level_range", f"""WITH {S.ITEMS}, l AS (SELECT title, 'satellite' AS "table", CAST(notes % 13 AS DOUBLE) AS level FROM items WHERE kind = 'PROMO' OR brand IN ('Brand#1', 'Brand#2', 'Brand#3')
 UNION ALL SELECT title, 'stella', notes % 15 FROM items WHERE kind IN ('LARGE', 'PROMO') UNION ALL SELECT title, 'insane', notes % 25 FROM items WHERE kind IN ('MEDIUM', 'LARGE') UNION ALL SELECT title, 'normal', notes % 12 FROM items WHERE kind = 'STANDARD')
 SELECT title, "table", count(*) AS n, min(level) AS lo, max(level) AS hi FROM l GROUP BY 1, 2""")
def agg_song_level_range(spark, sf):
    labels = t.items(spark, sf).select("item", "title")
    out = None
    for name, df in level_tables(spark, sf):
        part = df.withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(labels, "item").groupBy("title", "table").agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("lo"), F.max("level").alias("hi"))


PAIRS = [("acc", "bp"), ("acc", "ratio"), ("acc", "lamp"), ("bp", "lamp")]


def _corr_sql():
    def pr(x):
        return f"rank() OVER (PARTITION BY scope ORDER BY {x}) + (count(*) OVER (PARTITION BY scope, {x}) - 1) / 2.0 AS r_{x}"

    def c(a, b):
        return f"CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END"

    sel = " UNION ALL ".join(f"SELECT scope, '{a}_{b}' AS pair, count(*) AS n, round({c(a, b)}, 4) AS pearson, round(CASE WHEN count(*) >= 3 THEN {c('r_' + a, 'r_' + b)} END, 4) AS spearman FROM q GROUP BY scope" for a, b in PAIRS)
    return f"""WITH {S.SAMPLES}, {S.CLIENTS}, b AS (SELECT client AS scope, acc, bp, lamp, bp / notes AS ratio FROM smp JOIN clients USING (player)), a AS (SELECT * FROM b UNION ALL SELECT 'all', acc, bp, lamp, ratio FROM b),
 q AS (SELECT *, {', '.join(pr(x) for x in ('acc', 'bp', 'lamp', 'ratio'))} FROM a) {sel}"""


@query("agg_corr_block", _corr_sql())
def agg_corr_block(spark, sf):
    b = t.samples(spark, sf).join(t.clients(spark, sf), "player").select("client", "acc", "bp", "lamp", (F.col("bp") / F.col("notes")).alias("ratio"))
    # both scopes and all pairs read this one copy
    scoped = cut(b.select(F.explode(F.array("client", F.lit("all"))).alias("scope"), "acc", "bp", "lamp", "ratio"))
    out = None
    for x, y in PAIRS:
        p = scoped.groupBy("scope").agg(ranks.pearson(x, y).alias("pearson"))
        s = ranks.spearman(scoped, ["scope"], x, y, AUTO).join(p, "scope").select(
            "scope", F.lit(f"{x}_{y}").alias("pair"), "n", r("pearson", 4).alias("pearson"), r("rho", 4).alias("spearman"))
        out = s if out is None else out.unionByName(s)
    return out


@query("agg_skew", f"""WITH {S.SAMPLES} SELECT round(skewness(bp), 3) AS raw, round(skewness(ln(1 + bp)), 3) AS log1p_raw, round(skewness(bp / notes), 3) AS ratio, round(skewness(ln(1 + bp / notes)), 3) AS log1p_ratio FROM smp""")
def agg_skew(spark, sf):
    s = t.samples(spark, sf).select(F.col("bp").cast("double").alias("bp"), (F.col("bp") / F.col("notes")).alias("ra"))
    return s.agg(r(audit.adjusted_skew("bp"), 3).alias("raw"), r(audit.adjusted_skew(F.log1p("bp")), 3).alias("log1p_raw"),
                 r(audit.adjusted_skew("ra"), 3).alias("ratio"), r(audit.adjusted_skew(F.log1p("ra")), 3).alias("log1p_ratio"))


@query("agg_cond_spread", f"""WITH {S.FP}, b AS (SELECT CAST(ceil((acc - 40) / 5) AS BIGINT) AS bin, acc, lamp, bp FROM fp WHERE acc > 40 AND acc <= 100)
 SELECT bin, count(*) AS n, {', '.join(f'quantile_cont({v}, {p}) AS {v}_p{int(p * 100)}' for v in ('lamp', 'bp') for p in (0.1, 0.5, 0.9))}, round(avg(CAST(lamp = 1 AS INT)), 4) AS fail_rate FROM b GROUP BY bin""")
def agg_cond_spread(spark, sf):
    b = t.first_plays(spark, sf).filter((F.col("acc") > 40) & (F.col("acc") <= 100)).withColumn("bin", F.ceil((F.col("acc") - 40) / 5))
    out = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg((F.col("lamp") == 1).cast("int")), 4).alias("fail_rate"))
    for v in ("lamp", "bp"):
        out = out.join(ranks.quantiles(b, ["bin"], v, {f"{v}_p10": 0.1, f"{v}_p50": 0.5, f"{v}_p90": 0.9}, AUTO), "bin")
    return out


@query("agg_between_spread", f"""WITH {S.FP}, {LV}, m AS (SELECT "table", level, median(acc) AS m FROM fp JOIN lv USING (item) GROUP BY 1, 2), l AS (SELECT level, stddev_samp(m) AS s, count(*) AS c FROM m GROUP BY level HAVING count(*) >= 3)
 SELECT round(median(s), 4) AS median_std, count(*) AS n_levels FROM l""")
def agg_between_spread(spark, sf):
    j = t.first_plays(spark, sf).join(levels(spark, sf), "item")
    m = ranks.quantiles(j, ["table", "level"], "acc", {"m": 0.5}, AUTO)
    lv = m.groupBy("level").agg(F.stddev_samp("m").alias("s"), F.count(F.lit(1)).alias("c")).filter("c >= 3")
    # one row per level from here on
    return lv.agg(r(F.percentile("s", F.lit(0.5)), 4).alias("median_std"), F.count(F.lit(1)).alias("n_levels"))


@query("agg_bin_verdict_low", f"""WITH {S.SAMPLES} SELECT bp, count(*) AS n, (SELECT count(*) FROM smp WHERE bp <= 1) AS n_le_1, (SELECT count(*) FROM smp WHERE bp <= 5) AS n_le_5,
 (SELECT count(DISTINCT round(bp / notes, 6)) FROM smp WHERE bp / notes < 0.1) AS distinct_ratio, (SELECT count(*) FROM smp WHERE bp / notes < 0.1) AS n_ratio FROM smp WHERE bp <= 10 GROUP BY bp""")
def agg_bin_verdict_low(spark, sf):
    c = t.samples(spark, sf).groupBy("bp", "notes").agg(F.count(F.lit(1)).alias("n"))  # everything below needs only (bp, notes) counts
    ratio = F.col("bp") / F.col("notes")
    tot = c.agg(F.sum(F.when(F.col("bp") <= 1, F.col("n"))).alias("n_le_1"), F.sum(F.when(F.col("bp") <= 5, F.col("n"))).alias("n_le_5"),
                F.countDistinct(F.when(ratio < 0.1, F.round(ratio, 6))).alias("distinct_ratio"), F.sum(F.when(ratio < 0.1, F.col("n"))).alias("n_ratio"))
    vals = c.filter("bp <= 10").groupBy("bp").agg(F.sum("n").alias("n"))
    return vals.select("bp", "n", *[tot.select(x).scalar().alias(x) for x in tot.columns])


FEATS = ["x1", "x2", "ex", "bp"]


def _single_sql():
    lf = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, lamp, bp AS yb, acc AS y, player, item FROM smp" for f in FEATS)
    return f"""WITH {S.SAMPLES}, l AS ({lf}), st AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY feature),
 rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l),
 a AS (SELECT feature, count(*) AS n, round(corr(v, y), 4) AS r, round(corr(rv, ry), 4) AS rho, round(any_value(m), 4) AS mean, round(median(v), 4) AS median, round(avg(CAST(v = 0 AS INT)), 4) AS zero_share,
 count(*) FILTER (WHERE abs(v - m) / s > 1.7) AS outliers FROM rk JOIN st USING (feature) GROUP BY feature),
 lm AS (SELECT feature, lamp, avg(v) AS m, lag(avg(v)) OVER (PARTITION BY feature ORDER BY lamp) AS p FROM l GROUP BY feature, lamp)
 SELECT a.*, (SELECT bool_and(m >= p) OR bool_and(m <= p) FROM lm WHERE lm.feature = a.feature AND p IS NOT NULL) AS monotone FROM a"""


@query("agg_single_feature", _single_sql())
def agg_single_feature(spark, sf):
    smp = t.samples(spark, sf)
    lf = audit.long_form(smp.select(F.col("acc").alias("y"), "lamp", *FEATS), ["y", "lamp"], FEATS, "feature", "v")
    # everything follows from the counts of equal rows, so no key of four values deals the rows
    cells = cut(lf.groupBy("feature", "v", "y", "lamp").agg(F.count(F.lit(1)).alias("n")))
    n, v, y = F.col("n"), F.col("v"), F.col("y")
    known = F.when(v.isNotNull(), n)
    st = cells.groupBy("feature").agg((F.sum(n * v) / F.sum(known)).alias("m"), (F.sum(n * y) / F.sum(n)).alias("my"))
    d, e = v - F.col("m"), y - F.col("my")
    both = F.when(v.isNotNull() & y.isNotNull(), n)
    mid = cells.join(F.broadcast(st), "feature")  # a row a feature
    s = mid.groupBy("feature").agg(
        F.sum(n).alias("n"), F.first("m").alias("m"), F.sum(known).alias("k"), F.sum(known * (v == 0).cast("int")).alias("zero"), F.sum(known * d * d).alias("dd"),
        F.sum(both).alias("b"), F.sum(both * d).alias("bd"), F.sum(both * e).alias("be"), F.sum(both * d * d).alias("bdd"), F.sum(both * e * e).alias("bee"), F.sum(both * d * e).alias("bde"))
    vd, ve = F.col("bdd") - F.col("bd") * F.col("bd") / F.col("b"), F.col("bee") - F.col("be") * F.col("be") / F.col("b")
    sd = s.select("feature", F.sqrt(F.col("dd") / F.col("k")).alias("s"))
    far = F.when(F.abs(d) / F.nullif(F.col("s"), F.lit(0.0)) > 1.7, n).otherwise(0)
    outliers = mid.join(F.broadcast(sd), "feature").groupBy("feature").agg(F.sum(far).alias("outliers"))
    pearson = F.when((vd > 0) & (ve > 0), (F.col("bde") - F.col("bd") * F.col("be") / F.col("b")) / F.sqrt(vd * ve))
    base = s.select("feature", "n", r(pearson, 4).alias("r"), r("m", 4).alias("mean"), r(F.col("zero") / F.col("k"), 4).alias("zero_share"))
    rho = ranks.spearman_of_counts(cells.filter("v is not null and y is not null").groupBy("feature", "v", "y").agg(F.sum("n").alias("_n")), ["feature"], "v", "y", AUTO).select("feature", r("rho", 4).alias("rho"))
    med = ranks.quantiles_of_counts(cells.filter("v is not null").groupBy("feature", "v").agg(F.sum("n").alias("_n")), ["feature"], "v", {"median": 0.5}, AUTO).select("feature", r("median", 4).alias("median"))
    lm = cells.groupBy("feature", "lamp").agg((F.sum(n * v) / F.sum(known)).alias("m"))  # one row per (feature, lamp)
    prev = F.lag("m").over(W.partitionBy("feature").orderBy("lamp"))
    mono = lm.withColumn("p", prev).filter("p is not null").groupBy("feature").agg((F.bool_and(F.col("m") >= F.col("p")) | F.bool_and(F.col("m") <= F.col("p"))).alias("monotone"))
    return base.join(outliers, "feature").join(rho, "feature").join(med, "feature").join(mono, "feature")


@query("top_abs_rho", f"""WITH {S.SAMPLES}, l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS v, acc AS y FROM smp" for f in ('x1', 'x2', 'lamp', 'bp', 'notes'))}),
 rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l)
 SELECT feature, round(corr(rv, ry), 4) AS rho FROM rk GROUP BY feature ORDER BY abs(corr(rv, ry)) DESC, feature LIMIT 3""")
def top_abs_rho(spark, sf):
    lf = audit.long_form(t.samples(spark, sf).withColumnRenamed("acc", "y"), ["y"], ["x1", "x2", "lamp", "bp", "notes"], "feature", "v")
    return ranks.spearman(lf, ["feature"], "v", "y", AUTO).orderBy(F.desc(F.abs("rho")), "feature").limit(3).select("feature", r("rho", 4).alias("rho"))


@query("agg_maxabs_corr", f"""WITH {S.SAMPLES} SELECT 'ex' AS feature, round(greatest(abs(corr(ex, x1)), abs(corr(ex, x2)), abs(corr(ex, lamp))), 4) AS max_abs FROM smp
 UNION ALL SELECT 'bp', round(greatest(abs(corr(bp, x1)), abs(corr(bp, x2)), abs(corr(bp, lamp))), 4) FROM smp""")
def agg_maxabs_corr(spark, sf):
    smp = t.samples(spark, sf)
    wide = smp.agg(*[F.greatest(*[F.abs(F.corr(n, b)) for b in ("x1", "x2", "lamp")]).alias(n) for n in ("ex", "bp")])
    return audit.long_form(wide, [], ["ex", "bp"], "feature", "max_abs").select("feature", r("max_abs", 4).alias("max_abs"))


@query("agg_coverage", f"""WITH {S.FP}, {LV}, j AS (SELECT fp.*, level, CASE WHEN notes > 10 THEN x1 END AS x1, x2 FROM fp LEFT JOIN items ON fp.item = items.item LEFT JOIN lv ON fp.item = lv.item)
 SELECT 'axes' AS metric, round(avg(CAST(x1 IS NOT NULL AND x2 IS NOT NULL AS INT)), 6) AS value FROM j UNION ALL SELECT 'labels', round(avg(CAST(level IS NOT NULL AS INT)), 6) FROM j
 UNION ALL SELECT 'common', round(avg(CAST(x1 IS NOT NULL AND x2 IS NOT NULL AND level IS NOT NULL AS INT)), 6) FROM j""")
def agg_coverage(spark, sf):
    j = t.samples(spark, sf).join(levels(spark, sf), "item", "left").withColumn("x1", F.when(F.col("notes") > 10, F.col("x1")))
    return audit.coverage(j, {"axes": ["x1", "x2"], "labels": ["level"]}).select("metric", r("value").alias("value"))


@query("agg_saturation", f"""WITH {LV}, j AS (SELECT items.item, x1, x2, "table", level, abs(x1 - 50) <= 0.001 AS c1, abs(x2 - 999.9) <= 0.001 AS c2 FROM items LEFT JOIN lv USING (item)),
 rk AS (SELECT *, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2.0 AS rx, rank() OVER (ORDER BY level) + (count(*) OVER (PARTITION BY level) - 1) / 2.0 AS rl FROM j WHERE level IS NOT NULL AND NOT c1)
 SELECT 'x1' AS scope, count(*) AS n, count(*) FILTER (WHERE c1) AS capped, round(avg(CAST(c1 AS INT)), 4) AS frac, CAST(NULL AS DOUBLE) AS rho FROM j
 UNION ALL SELECT 'x2', count(*), count(*) FILTER (WHERE c2), round(avg(CAST(c2 AS INT)), 4), NULL FROM j UNION ALL SELECT 'any', count(*), count(*) FILTER (WHERE c1 OR c2), round(avg(CAST(c1 OR c2 AS INT)), 4), NULL FROM j
 UNION ALL SELECT concat("table", '|', CAST(CAST(level AS INT) AS VARCHAR)), count(*), count(*) FILTER (WHERE c1 OR c2), round(avg(CAST(c1 OR c2 AS INT)), 4), NULL FROM j WHERE level IS NOT NULL GROUP BY "table", level HAVING count(*) >= 3
 UNION ALL SELECT 'below_cap', count(*), 0, 0, round(corr(rx, rl), 4) FROM rk""")
def agg_saturation(spark, sf):
    j = t.items(spark, sf).select("item", "x1", "x2").join(levels(spark, sf), "item", "left")
    j = j.withColumn("c1", F.abs(F.col("x1") - 50) <= 0.001).withColumn("c2", F.abs(F.col("x2") - 999.9) <= 0.001)
    flags = F.array(F.struct(F.lit("x1").alias("scope"), F.col("c1").alias("c")), F.struct(F.lit("x2").alias("scope"), F.col("c2").alias("c")), F.struct(F.lit("any").alias("scope"), (F.col("c1") | F.col("c2")).alias("c")),
                    F.struct(F.concat_ws("|", "table", F.col("level").cast("int").cast("string")).alias("scope"), (F.col("c1") | F.col("c2")).alias("c")))
    g = j.select("level", F.posexplode(flags).alias("i", "s")).filter((F.col("i") < 3) | F.col("level").isNotNull()).groupBy("i", "s.scope").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("s.c"), 1)).alias("capped"), r(F.avg(F.col("s.c").cast("int")), 4).alias("frac"))
    rho = ranks.spearman(j.filter(~F.col("c1")), [], "x1", "level").select(F.lit("below_cap").alias("scope"), "n", F.lit(0).cast("long").alias("capped"), F.lit(0.0).alias("frac"), r("rho", 4).alias("rho"))
    return g.filter((F.col("i") < 3) | (F.col("n") >= 3)).select("scope", "n", "capped", "frac", F.lit(None).cast("double").alias("rho")).unionByName(rho)


@query("agg_dead_axis", f"""WITH {S.SAMPLES} SELECT 'lamp' AS axis, count(DISTINCT lamp) AS n_distinct, count(DISTINCT lamp) > 7 AS live FROM smp UNION ALL SELECT 'bp', count(DISTINCT bp), count(DISTINCT bp) > 7 FROM smp
 UNION ALL SELECT 'x1', count(DISTINCT x1), count(DISTINCT x1) > 7 FROM smp UNION ALL SELECT 'x2', count(DISTINCT x2), count(DISTINCT x2) > 7 FROM smp""")
def agg_dead_axis(spark, sf):
    cols = ["lamp", "bp", "x1", "x2"]
    w = t.samples(spark, sf).agg(*[F.countDistinct(x).alias(x) for x in cols])
    lf = audit.long_form(w, [], cols, "axis", "d")
    return lf.select("axis", F.col("d").cast("long").alias("n_distinct"), (F.col("d") > 7).alias("live"))


@query("agg_version_diff", f"""WITH {S.ITEMS}, v AS (SELECT x1, CASE WHEN item % 10 = 0 THEN x1 + 1 ELSE x1 END AS y1, x2, CASE WHEN item % 4 = 0 THEN x2 * 2 ELSE x2 END AS y2 FROM items)
 SELECT 'x1' AS "column", count(*) AS n, count(*) FILTER (WHERE x1 <> y1) AS changed, max(abs(x1 - y1)) AS max_delta, max(x1) AS max_old, max(y1) AS max_new FROM v
 UNION ALL SELECT 'x2', count(*), count(*) FILTER (WHERE x2 <> y2), max(abs(x2 - y2)), max(x2), max(y2) FROM v""")
def agg_version_diff(spark, sf):
    old = t.items(spark, sf).select("item", "x1", "x2")
    new = old.select("item", F.when(F.col("item") % 10 == 0, F.col("x1") + 1).otherwise(F.col("x1")).alias("x1"), F.when(F.col("item") % 4 == 0, F.col("x2") * 2).otherwise(F.col("x2")).alias("x2"))
    return audit.version_diff(old, new, "item", ["x1", "x2"])


@query("agg_log_audit", f"""WITH {S.LOG}, k AS (SELECT player, item, count(*) AS n FROM log GROUP BY 1, 2), m AS (SELECT (SELECT count(*) FROM log) AS n_rows, (SELECT count(*) FROM k) AS keys, (SELECT count(*) FROM k WHERE n > 1) AS dup_keys,
 (SELECT max(n) FROM k) AS plays_max, (SELECT avg(n) FROM k) AS plays_mean, (SELECT min(ts) FROM log) AS ts_min, (SELECT max(ts) FROM log) AS ts_max, (SELECT count(*) FROM log WHERE acc IS NULL) AS null_acc)
 SELECT metric, round(value, 6) AS value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM m) UNPIVOT (value FOR metric IN (n_rows, keys, dup_keys, plays_max, plays_mean, ts_min, ts_max, null_acc))
 UNION ALL SELECT concat('lamp_', lamp), CAST(count(*) AS DOUBLE) FROM log GROUP BY lamp""")
def agg_log_audit(spark, sf):
    log = t.play_log(spark, sf)
    k = log.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.when(F.col("acc").isNull(), 1)).alias("na"))
    m = k.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("dup_keys"), F.max("n").alias("plays_max"), F.avg("n").alias("plays_mean"),
              F.min("lo").alias("ts_min"), F.max("hi").alias("ts_max"), F.sum("na").alias("null_acc"))
    lamps = log.groupBy(F.concat(F.lit("lamp_"), F.col("lamp").cast("string")).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return audit.metrics_long(m).select("metric", r("value").alias("value")).unionByName(lamps)


@query("agg_overlap_sets", f"""WITH {S.LOG}, {S.CLIENTS}, p AS (SELECT DISTINCT item, client FROM log JOIN clients USING (player))
 SELECT concat_ws('&', a.client, b.client) AS sets, count(*) AS n_both, any_value((SELECT count(DISTINCT item) FROM p WHERE client IN (a.client, b.client))) AS n_union FROM p a JOIN p b ON a.item = b.item AND a.client < b.client GROUP BY a.client, b.client
 UNION ALL SELECT concat_ws('&', a.client, b.client, c.client), count(*), any_value((SELECT count(DISTINCT item) FROM p WHERE client IN (a.client, b.client, c.client))) FROM p a JOIN p b ON a.item = b.item AND a.client < b.client JOIN p c ON a.item = c.item AND b.client < c.client GROUP BY a.client, b.client, c.client""")
def agg_overlap_sets(spark, sf):
    log = t.play_log(spark, sf).join(t.clients(spark, sf), "player")
    sets = joins.roster_sets(log, "item", "client")  # as many rows as there are sets of clients
    m = sets.select("members", "n_items")
    by_one = m.select("n_items", F.explode("members").alias("a"), "members")
    two = by_one.select("n_items", "a", F.explode(F.filter("members", lambda x: x > F.col("a"))).alias("b"), "members")
    three = two.select("n_items", "a", "b", F.explode(F.filter("members", lambda x: x > F.col("b"))).alias("c"))
    n_two = two.groupBy("a", "b").agg(F.sum("n_items").alias("n2"))
    n_three = three.groupBy("a", "b", "c").agg(F.sum("n_items").alias("n3"))
    n_one = by_one.groupBy("a").agg(F.sum("n_items").alias("n1"))
    one = lambda k: n_one.select(F.col("a").alias(k), F.col("n1").alias(f"n_{k}"))
    pair = lambda x, y: n_two.select(F.col("a").alias(x), F.col("b").alias(y), F.col("n2").alias(f"n_{x}{y}"))
    # sizes of unions by inclusion and exclusion
    pairs = n_two.join(one("a"), "a").join(one("b"), "b").select(F.concat_ws("&", "a", "b").alias("sets"), F.col("n2").alias("n_both"), (F.col("n_a") + F.col("n_b") - F.col("n2")).alias("n_union"))
    x = n_three.join(one("a"), "a").join(one("b"), "b").join(one("c"), "c").join(pair("a", "b"), ["a", "b"]).join(pair("a", "c"), ["a", "c"]).join(pair("b", "c"), ["b", "c"])
    whole = F.col("n_a") + F.col("n_b") + F.col("n_c") - F.col("n_ab") - F.col("n_ac") - F.col("n_bc") + F.col("n3")
    return pairs.unionByName(x.select(F.concat_ws("&", "a", "b", "c").alias("sets"), F.col("n3").alias("n_both"), whole.alias("n_union")))


@query("agg_weekly", f"""WITH {S.FP}, w AS (SELECT 'week' AS unit, strftime(date_trunc('week', make_timestamp(ts * 1000000)), '%Y-%m-%d') AS period, count(*) AS n FROM log GROUP BY 2),
 m AS (SELECT strftime(date_trunc('month', make_timestamp(ts * 1000000)), '%Y-%m-%d') AS period, count(*) AS n FROM fp GROUP BY 1) SELECT * FROM w UNION ALL SELECT 'month_cumulative', period, CAST(sum(n) OVER (ORDER BY period) AS BIGINT) FROM m""")
def agg_weekly(spark, sf):
    def day(unit):
        return F.date_format(F.date_trunc(unit, F.timestamp_seconds("ts")), "yyyy-MM-dd")

    week = t.play_log(spark, sf).groupBy(day("week").alias("period")).agg(F.count(F.lit(1)).alias("n")).withColumn("unit", F.lit("week"))
    month = t.first_plays(spark, sf).groupBy(day("month").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("period"))  # one row per calendar month
    return week.unionByName(month.select("period", run.alias("n"), F.lit("month_cumulative").alias("unit")))


@query("agg_stratified_probe", f"""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {S.draw_hex("'probe'", "doc_id")}, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
 SELECT doc_id, source FROM d WHERE rn <= CASE WHEN n <= 45 THEN n ELSE greatest(round(n * 0.1), 1) END""")
def agg_stratified_probe(spark, sf):
    d = t.table(spark, sf, "documents", "doc_id", "source").withColumn("u", draw_long("probe", F.col("doc_id")))
    return audit.stratified_probe(d, "source", "u", 0.1, 45).select("doc_id", "source")


MEAS = ["n_chars", "n_words", "n_lines", "n_digits", "n_upper", "n_commas"]
DOCM = "docm AS (SELECT doc_id, n_chars, len(string_split(text, ' ')) AS n_words, len(string_split(text, chr(10))) AS n_lines, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^,]', '', 'g')) AS n_commas FROM documents)"


def doc_measures(spark, sf):
    d = t.table(spark, sf, "documents", "doc_id", "text", "n_chars")
    only = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", ""))
    return d.select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines"), only("0-9").alias("n_digits"), only("A-Z").alias("n_upper"), only(",").alias("n_commas"))


UNP = f"UNPIVOT (value FOR measure IN ({', '.join(MEAS)}))"


@query("agg_extremes", f"WITH {DOCM}, l AS (SELECT doc_id, measure, CAST(value AS DOUBLE) AS value FROM (SELECT doc_id, {', '.join(f'CAST({m} AS BIGINT) AS {m}' for m in MEAS)} FROM docm) {UNP}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, doc_id) AS rank FROM l) WHERE rank <= 10")
def agg_extremes(spark, sf):
    lf = audit.long_form(doc_measures(spark, sf), ["doc_id"], MEAS)
    return ranks.top_n(lf, ["measure"], [F.desc("value"), "doc_id"], 10)


@query("agg_distribution", f"WITH {DOCM}, l AS (SELECT measure, CAST(value AS DOUBLE) AS value FROM (SELECT {', '.join(f'CAST({m} AS BIGINT) AS {m}' for m in MEAS)} FROM docm) {UNP}) SELECT measure, min(value) AS min, list_sort(list(value))[count(*) // 2 + 1] AS median_hi, max(value) AS max FROM l GROUP BY measure")
def agg_distribution(spark, sf):
    return ranks.upper_median(audit.long_form(doc_measures(spark, sf), [], MEAS), ["measure"], "value", AUTO)


@query("agg_value_share", f"""WITH {S.FP}, s AS (SELECT player, lamp, count(*) AS n, count(*) FILTER (WHERE acc >= 80 AND acc < 86) AS n_slice FROM fp GROUP BY 1, 2),
 q AS (SELECT player, quantile_cont(bp, 0.1) AS bp_p10, quantile_cont(bp, 0.5) AS bp_p50, quantile_cont(bp, 0.9) AS bp_p90 FROM fp WHERE acc >= 80 AND acc < 86 GROUP BY player)
 SELECT player, lamp, n, round(n / sum(n) OVER (PARTITION BY player), 6) AS share, n_slice, round(bp_p10, 6) AS bp_p10, round(bp_p50, 6) AS bp_p50, round(bp_p90, 6) AS bp_p90 FROM s LEFT JOIN q USING (player)""")
def agg_value_share(spark, sf):
    fp = t.first_plays(spark, sf)
    inside = (F.col("acc") >= 80) & (F.col("acc") < 86)
    s = fp.groupBy("player", "lamp").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(inside, 1)).alias("n_slice"))
    total = F.sum("n").over(W.partitionBy("player"))  # at most one row per lamp code
    q = ranks.quantiles(fp.filter(inside), ["player"], "bp", {"bp_p10": 0.1, "bp_p50": 0.5, "bp_p90": 0.9}, t.hot(spark, sf, "player"))
    return s.withColumn("share", r(F.col("n") / total)).join(q.select("player", *[r(x).alias(x) for x in ("bp_p10", "bp_p50", "bp_p90")]), "player", "left")
