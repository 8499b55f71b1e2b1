"""Joins, set operations, filters and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.columns import r
from ..operators import joins, ranks, scoring
from ..sources import tables as t
from . import sqlparts as S
from .registry import query

KEY = ["player", "item"]
SHA = "md5(concat('item:', CAST(p_partkey AS VARCHAR)))"

# level tables: overlapping slices of the catalogue, highest priority first
LEVELS_SQL = """lv AS (SELECT item, "table", level FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY prio, level) AS rn FROM (
 SELECT item, 'satellite' AS "table", CAST(notes % 13 AS DOUBLE) AS level, 0 AS prio FROM items WHERE kind = 'PROMO' OR brand IN ('Brand#1', 'Brand#2', 'Brand#3')
 UNION ALL SELECT item, 'stella', CAST(notes % 15 AS DOUBLE), 1 FROM items WHERE kind IN ('LARGE', 'PROMO')
 UNION ALL SELECT item, 'insane', CAST(notes % 25 AS DOUBLE), 2 FROM items WHERE kind IN ('MEDIUM', 'LARGE')
 UNION ALL SELECT item, 'normal', CAST(notes % 12 AS DOUBLE), 3 FROM items WHERE kind = 'STANDARD')) WHERE rn = 1)"""
LV = S.ITEMS + ", " + LEVELS_SQL


def level_tables(spark, sf):
    it = t.items(spark, sf)

    def part(cond, mod):
        return it.filter(cond).select("item", (F.col("notes") % mod).cast("double").alias("level"))

    return [
        ("satellite", part((F.col("kind") == "PROMO") | F.col("brand").isin("Brand#1", "Brand#2", "Brand#3"), 13)),
        ("stella", part(F.col("kind").isin("LARGE", "PROMO"), 15)),
        ("insane", part(F.col("kind").isin("MEDIUM", "LARGE"), 25)),
        ("normal", part(F.col("kind") == "STANDARD", 12)),
    ]


def levels(spark, sf):
    return joins.priority_union(level_tables(spark, sf), "item").select("item", "table", "level")


@query("jn_priority_union", f"WITH {LV} SELECT item, \"table\", level FROM lv")
def jn_priority_union(spark, sf):
    return levels(spark, sf)


@query("jn_dim_left", f"""WITH {S.FP}, {LV} SELECT player, fp.item, notes, "table", level FROM fp LEFT JOIN items ON fp.item = items.item LEFT JOIN lv ON fp.item = lv.item""")
def jn_dim_left(spark, sf):
    fp = t.first_plays(spark, sf)
    return joins.dim_left(fp, [t.items(spark, sf).select("item", "notes"), levels(spark, sf)], "item").select(*KEY, "notes", "table", "level")


@query("jn_dim_unique", """SELECT 'stacked' AS dim, count(*) AS dup_keys, CAST(max(n) AS BIGINT) AS max_rows FROM (SELECT item, count(*) AS n FROM (
 SELECT p_partkey AS item FROM part WHERE p_type = 'PROMO' OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') UNION ALL SELECT p_partkey FROM part WHERE p_type IN ('LARGE', 'PROMO')
 UNION ALL SELECT p_partkey FROM part WHERE p_type IN ('MEDIUM', 'LARGE') UNION ALL SELECT p_partkey FROM part WHERE p_type = 'STANDARD') GROUP BY item HAVING count(*) > 1)
 UNION ALL SELECT 'resolved', 0, NULL""")
def jn_dim_unique(spark, sf):
    stacked = reduce(lambda a, b: a.unionByName(b), [d for _, d in level_tables(spark, sf)])
    resolved = levels(spark, sf)

    def rep(name, df):
        return joins.duplicate_keys(df, ["item"]).agg(F.lit(name).alias("dim"), F.count(F.lit(1)).alias("dup_keys"), F.max("n").alias("max_rows"))

    return rep("stacked", stacked).unionByName(rep("resolved", resolved))


@query("jn_composite", f"""WITH {S.FP}, b AS (SELECT player, item, acc - 50 AS h_a FROM fp WHERE lamp >= 2), m AS (SELECT player, item, bp * 2 AS m_a FROM fp WHERE bp >= 2)
 SELECT player, item, h_a, m_a FROM b JOIN m USING (player, item)""")
def jn_composite(spark, sf):
    fp = t.first_plays(spark, sf)
    a = fp.filter("lamp >= 2").select(*KEY, (F.col("acc") - 50).alias("h_a"))
    b = fp.filter("bp >= 2").select(*KEY, (F.col("bp") * 2).alias("m_a"))
    return a.join(b, KEY)


@query("jn_indicator", f"""WITH {S.FP}, {LV} SELECT count(*) AS n, count(lv.item) AS matched, count(*) - count(lv.item) AS unmatched,
 count(DISTINCT CASE WHEN lv.item IS NULL THEN fp.item END) AS unmatched_items FROM fp LEFT JOIN lv ON fp.item = lv.item""")
def jn_indicator(spark, sf):
    j = joins.with_indicator(t.first_plays(spark, sf), levels(spark, sf), ["item"])
    return j.groupBy("item", "matched").agg(F.count(F.lit(1)).alias("c")).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("matched"), F.col("c")).otherwise(0)).alias("matched"),
        F.sum(F.when(~F.col("matched"), F.col("c")).otherwise(0)).alias("unmatched"), F.count(F.when(~F.col("matched"), 1)).alias("unmatched_items"))


@query("jn_hash_bridge", """WITH e AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE sha256(CAST(p_partkey AS VARCHAR)) END AS sha, md5(CAST(p_partkey AS VARCHAR)) AS md FROM part),
 a AS (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS sha, p_size AS level FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT md5(CAST(p_partkey AS VARCHAR)) AS md, -p_size AS level FROM part WHERE p_partkey % 2 = 0)
 SELECT item, coalesce(a.level, b.level) AS level FROM e LEFT JOIN a ON e.sha = a.sha LEFT JOIN b ON e.md = b.md""")
def jn_hash_bridge(spark, sf):
    p = t.table(spark, sf, "part", "p_partkey", "p_size")
    k = F.col("p_partkey").cast("string")
    sha, md = F.sha2(k, 256), F.md5(k)
    entries = p.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 3 != 0, sha).alias("sha"), md.alias("md"))
    primary = p.filter("p_partkey % 5 <> 0").select(sha.alias("sha"), F.col("p_size").alias("level"))
    fallback = p.filter("p_partkey % 2 = 0").select(md.alias("md"), (-F.col("p_size")).alias("level"))
    return joins.bridge(entries, primary, fallback, "sha", "md", "level").select("item", "level")


@query("jn_anti_candidates", f"""WITH {S.LOG}, {S.ITEMS}, {S.CLIENTS}, tp AS (SELECT DISTINCT team, item FROM log JOIN clients USING (player))
 SELECT team, item FROM (SELECT DISTINCT team FROM clients) CROSS JOIN items WHERE (team, item) NOT IN (SELECT (team, item) FROM tp)""")
def jn_anti_candidates(spark, sf):
    """Catalogue minus played for every roster member."""
    log = t.play_log(spark, sf).join(t.clients(spark, sf), "player")
    roster = t.clients(spark, sf).agg(F.array_sort(F.collect_set("team"))).scalar()
    return scoring.candidates(t.items(spark, sf).select("item"), log, roster, "team")


@query("jn_semi_scope", f"WITH {S.FP}, {LV} SELECT player, item, acc FROM fp WHERE item IN (SELECT item FROM lv)")
def jn_semi_scope(spark, sf):
    return t.first_plays(spark, sf).join(levels(spark, sf), "item", "left_semi").select(*KEY, "acc")


OVER = f"""WITH {S.FP}, {S.CLIENTS}, {LV}, p AS (SELECT DISTINCT team, fp.item, coalesce("table", 'none') AS bin FROM fp JOIN clients USING (player) LEFT JOIN lv ON fp.item = lv.item)
 SELECT a.bin, a.team AS a, b.team AS b, count(*) AS n_both FROM p a JOIN p b ON a.item = b.item AND a.team < b.team GROUP BY 1, 2, 3"""


def team_items(spark, sf):
    fp = t.first_plays(spark, sf).join(t.clients(spark, sf), "player")
    return fp.join(levels(spark, sf), "item", "left").withColumn("bin", F.coalesce("table", F.lit("none")))


@query("jn_multi_overlap", OVER)
def jn_multi_overlap(spark, sf):
    return joins.pair_overlap(joins.roster_sets(team_items(spark, sf), "item", "team", ["bin"]), ["bin"])


@query("jn_best_vs_log", f"""WITH {S.BEST}, last AS (SELECT player, item, acc AS l_acc, lamp AS l_lamp, bp AS l_bp FROM (SELECT *, row_number() OVER (PARTITION BY player, item ORDER BY ts DESC, seq DESC, price DESC) AS rn FROM log) WHERE rn = 1)
 SELECT count(*) AS n, count(*) FILTER (WHERE acc = l_acc) AS same_acc, count(*) FILTER (WHERE lamp = l_lamp) AS same_lamp, count(*) FILTER (WHERE bp = l_bp) AS same_bp,
 count(*) FILTER (WHERE acc = l_acc AND lamp = l_lamp AND bp = l_bp) AS same_all FROM best JOIN last USING (player, item)""")
def jn_best_vs_log(spark, sf):
    last = ranks.top_n(t.play_log(spark, sf), KEY, [F.desc("ts"), F.desc("seq"), F.desc("price")], 1, "_rn").select(
        *KEY, F.col("acc").alias("l_acc"), F.col("lamp").alias("l_lamp"), F.col("bp").alias("l_bp"))
    j = t.best_rows(spark, sf).join(last, KEY)
    eq = {k: F.col(k) == F.col(f"l_{k}") for k in ("acc", "lamp", "bp")}
    return j.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(e, 1)).alias(f"same_{k}") for k, e in eq.items()],
                 F.count(F.when(eq["acc"] & eq["lamp"] & eq["bp"], 1)).alias("same_all"))


@query("jn_key_match", f"""WITH {S.LOG}, a AS (SELECT player, item, ts, max(acc) AS acc, max(lamp) AS lamp FROM log WHERE seq % 4 <> 0 GROUP BY 1, 2, 3), b AS (SELECT player, item, ts, max(acc) AS acc, min(lamp) AS lamp FROM log WHERE seq % 5 <> 0 GROUP BY 1, 2, 3)
 SELECT count(*) AS matched, count(*) FILTER (WHERE a.acc = b.acc) AS same_acc, count(*) FILTER (WHERE a.lamp = b.lamp) AS same_lamp, count(*) FILTER (WHERE a.acc <> b.acc OR a.lamp <> b.lamp) AS conflicts FROM a JOIN b USING (player, item, ts)""")
def jn_key_match(spark, sf):
    log, k = t.play_log(spark, sf), ["player", "item", "ts"]
    a = log.filter("seq % 4 <> 0").groupBy(*k).agg(F.max("acc").alias("acc"), F.max("lamp").alias("lamp"))
    b = log.filter("seq % 5 <> 0").groupBy(*k).agg(F.max("acc").alias("b_acc"), F.min("lamp").alias("b_lamp"))
    sa, sl = F.col("acc") == F.col("b_acc"), F.col("lamp") == F.col("b_lamp")
    return a.join(b, k).agg(F.count(F.lit(1)).alias("matched"), F.count(F.when(sa, 1)).alias("same_acc"),
                            F.count(F.when(sl, 1)).alias("same_lamp"), F.count(F.when(~sa | ~sl, 1)).alias("conflicts"))


@query("jn_cross_client", f"""WITH {S.BEST}, {S.CLIENTS}, m AS (SELECT item, avg(acc) FILTER (WHERE client = 'BUILDING') AS a, avg(acc) FILTER (WHERE client = 'MACHINERY') AS b FROM best JOIN clients USING (player) GROUP BY item)
 SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS only_b,
 round(avg(a - b), 4) AS gap_mean, round(stddev_samp(a - b), 4) AS gap_sd, round(avg(CASE WHEN a - b IS NOT NULL THEN CAST(abs(a - b) > 5 AS INT) END), 4) AS gap_over5 FROM m""")
def jn_cross_client(spark, sf):
    j = t.best_rows(spark, sf).join(t.clients(spark, sf), "player")
    m = j.groupBy("item").agg(F.avg(F.when(F.col("client") == "BUILDING", F.col("acc"))).alias("a"), F.avg(F.when(F.col("client") == "MACHINERY", F.col("acc"))).alias("b"))
    a, b, gap = F.col("a").isNotNull(), F.col("b").isNotNull(), F.col("a") - F.col("b")
    return m.agg(F.count(F.when(a & b, 1)).alias("shared"), F.count(F.when(a & ~b, 1)).alias("only_a"), F.count(F.when(~a & b, 1)).alias("only_b"),
                 r(F.avg(gap), 4).alias("gap_mean"), r(F.stddev_samp(gap), 4).alias("gap_sd"), r(F.avg((F.abs(gap) > 5).cast("int")), 4).alias("gap_over5"))


# ---- set operations ----
@query("set_union_sources", f"""WITH {S.FP}, {S.CLIENTS} SELECT client AS src, count(*) AS n, CAST(sum(acc) AS DOUBLE) AS acc_sum FROM fp JOIN clients USING (player) GROUP BY 1""")
def set_union_sources(spark, sf):
    """All clients' frames as one, told apart by their source; whatever clients there are."""
    fp = t.first_plays(spark, sf).join(t.clients(spark, sf), "player")
    return fp.groupBy(F.col("client").alias("src")).agg(F.count(F.lit(1)).alias("n"), F.sum("acc").alias("acc_sum"))


@query("set_union_distinct", f"WITH {S.LOG}, {LV} SELECT item FROM lv UNION SELECT item FROM log")
def set_union_distinct(spark, sf):
    return levels(spark, sf).select("item").union(t.play_log(spark, sf).select("item")).distinct()


@query("set_intersect", f"WITH {S.LOG}, {LV} SELECT item FROM lv INTERSECT SELECT item FROM log WHERE lamp >= 5")
def set_intersect(spark, sf):
    return levels(spark, sf).select("item").intersect(t.play_log(spark, sf).filter("lamp >= 5").select("item"))


@query("set_except", f"WITH {S.LOG} SELECT player, item FROM log EXCEPT SELECT player, item FROM log WHERE acc >= 30")
def set_except(spark, sf):
    log = t.play_log(spark, sf)
    return log.select(*KEY).subtract(log.filter("acc >= 30").select(*KEY))


# ---- filters and projections ----
HASH64 = "CASE WHEN l_suppkey % 10 = 0 THEN repeat(md5(CAST(l_partkey AS VARCHAR)), 3) ELSE repeat(md5(CAST(l_partkey AS VARCHAR)), 2) END"


@query("flt_course_rows", f"SELECT sha, mode, count(*) AS n FROM (SELECT {HASH64} AS sha, l_linenumber * 20 AS mode FROM lineitem) WHERE length(sha) = 64 AND mode < 100 GROUP BY 1, 2")
def flt_course_rows(spark, sf):
    li = t.table(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_linenumber")
    h = F.md5(F.col("l_partkey").cast("string"))
    df = li.select(F.when(F.col("l_suppkey") % 10 == 0, F.repeat(h, F.lit(3))).otherwise(F.repeat(h, F.lit(2))).alias("sha"), (F.col("l_linenumber") * 20).alias("mode"))
    return df.filter((F.length("sha") == 64) & (F.col("mode") < 100)).groupBy("sha", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("flt_plausible", f"WITH {S.SAMPLES} SELECT player, item, bp, notes FROM smp WHERE notes IS NOT NULL AND notes > 0 AND bp <= notes + 5")
def flt_plausible(spark, sf):
    return t.samples(spark, sf).filter(F.col("notes").isNotNull() & (F.col("notes") > 0) & (F.col("bp") <= F.col("notes") + 5)).select(*KEY, "bp", "notes")


@query("flt_survival", f"WITH {S.FP} SELECT player, item, acc, lamp FROM fp WHERE lamp BETWEEN 4 AND 6 AND acc >= 50")
def flt_survival(spark, sf):
    return t.first_plays(spark, sf).filter(F.col("lamp").between(4, 6) & (F.col("acc") >= 50)).select(*KEY, "acc", "lamp")


RULES = [("no_play", "lamp = 0"), ("low_acc", "acc < 20"), ("bp_high", "bp > 6"), ("few_notes", "notes < 5")]


@query("flt_ledger", f"""WITH {S.BEST}, {S.ITEMS}, x AS (SELECT CASE {' '.join(f"WHEN {e} THEN '{i}_{n}'" for i, (n, e) in enumerate(RULES))} ELSE '9_kept' END AS rule FROM best JOIN items USING (item))
 SELECT rule, count(*) AS n FROM x GROUP BY rule""")
def flt_ledger(spark, sf):
    df = t.best_rows(spark, sf).join(t.items(spark, sf), "item")
    return ledger(df, RULES)


def ledger(df, rules):
    """Rows dropped by each rule of an ordered filter chain, in one pass."""
    rule = F
    for i, (name, expr) in enumerate(rules):
        rule = rule.when(F.expr(expr), f"{i}_{name}")
    return df.groupBy(rule.otherwise("9_kept").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_acc_judge", """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(CASE WHEN l_quantity + l_linenumber + l_suppkey % 7 > 0 THEN (2 * l_quantity + l_linenumber) * 100.0 / (2 * (l_quantity + l_linenumber + l_suppkey % 7)) END, 6) AS acc FROM lineitem""")
def prj_acc_judge(spark, sf):
    li = t.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_suppkey").withColumn("miss", F.col("l_suppkey") % 7)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", r(c.acc_judge({"l_quantity": 2, "l_linenumber": 1}, ["miss"])).alias("acc"))


@query("prj_acc_lr2", f"WITH {S.SAMPLES} SELECT player, item, round(CASE WHEN notes > 0 THEN (2 * ex + lamp) * 100.0 / (2 * notes) END, 6) AS acc2 FROM smp")
def prj_acc_lr2(spark, sf):
    return t.samples(spark, sf).select(*KEY, r(c.acc_two_counter("ex", "lamp", "notes")).alias("acc2"))


@query("prj_acc_alt", f"WITH {S.SAMPLES} SELECT player, item, round(acc * 25.0 / notes, 6) AS acc_alt, notes = 25 AS notes_match FROM smp WHERE notes > 0")
def prj_acc_alt(spark, sf):
    return t.samples(spark, sf).filter("notes > 0").select(*KEY, r(F.col("acc") * 25.0 / F.col("notes")).alias("acc_alt"), (F.col("notes") == 25).alias("notes_match"))


@query("prj_lamp_map", f"WITH {S.LOG} SELECT lamp, CASE lamp WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 8 WHEN 7 THEN 9 WHEN 8 THEN 10 WHEN 9 THEN 2 WHEN 10 THEN 3 END AS mapped, count(*) AS n FROM log GROUP BY 1, 2")
def prj_lamp_map(spark, sf):
    return t.play_log(spark, sf).groupBy("lamp", c.map_lamp("lamp").alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_region", f"""WITH {LV} SELECT item, CASE WHEN "table" = 'satellite' THEN 'SL' WHEN "table" = 'stella' THEN (CASE WHEN level <= 3 THEN 'ST0-3' WHEN level <= 7 THEN 'ST4-7' ELSE 'ST8+' END) ELSE 'insane' END AS region,
 CASE "table" WHEN 'satellite' THEN (CASE WHEN level <= 2 THEN 'SL0-2' WHEN level <= 5 THEN 'SL3-5' WHEN level <= 8 THEN 'SL6-8' ELSE 'SL9-12' END)
 WHEN 'stella' THEN (CASE WHEN level <= 3 THEN 'ST0-3' WHEN level <= 7 THEN 'ST4-7' WHEN level <= 12 THEN 'ST8-12' ELSE 'ST13+' END) WHEN 'insane' THEN 'insane' ELSE 'none' END AS coord FROM lv""")
def prj_region(spark, sf):
    return levels(spark, sf).select("item", c.region("table", "level").alias("region"), c.coordinate("table", "level").alias("coord"))


RAWLV = "CASE p_partkey % 5 WHEN 0 THEN '??' WHEN 1 THEN concat(CAST(p_size AS VARCHAR), '+') WHEN 2 THEN concat(' ', CAST(p_size AS VARCHAR), '- ') WHEN 3 THEN '★' ELSE concat(CAST(p_size AS VARCHAR), '.5') END"


@query("prj_level_parse", f"SELECT item, level FROM (SELECT p_partkey AS item, TRY_CAST(rtrim(trim({RAWLV}), '+-') AS DOUBLE) AS level FROM part) WHERE level IS NOT NULL")
def prj_level_parse(spark, sf):
    p = t.table(spark, sf, "part", "p_partkey", "p_size").select(F.col("p_partkey").alias("item"), F.expr(RAWLV.replace("VARCHAR", "STRING")).alias("raw"))
    return p.select("item", c.parse_level("raw").alias("level")).filter("level is not null")


@query("prj_quarantine", """WITH x AS (SELECT page_id, list_filter([CASE WHEN length(html) > 8000 THEN 'too_long' END, CASE WHEN length(html) < 1000 THEN 'too_short' END, CASE WHEN contains(html, '<script') THEN 'script' END,
 CASE WHEN NOT contains(html, '<title>') THEN 'no_title' END, CASE WHEN contains(url, '?') THEN 'query_url' END], lambda z: z IS NOT NULL) AS q FROM pages)
 SELECT page_id, array_to_string(list_sort(q), '|') AS reasons, CAST(len(q) AS INT) AS n_reasons FROM x""")
def prj_quarantine(spark, sf):
    rules = {"too_long": F.length("html") > 8000, "too_short": F.length("html") < 1000, "script": F.contains("html", F.lit("<script")),
             "no_title": ~F.contains("html", F.lit("<title>")), "query_url": F.contains("url", F.lit("?"))}
    q = reasons(rules)
    return t.table(spark, sf, "pages").select("page_id", F.array_join(q, "|").alias("reasons"), F.size(q).alias("n_reasons"))


def reasons(rules):
    """Sorted list of the names of all rules that hold for the row."""
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*[F.when(e, n) for n, e in rules.items()]))))


# fixed values: outlier limits
FLAG_LIMITS = {"many_notes": ("total_notes", 10000), "long": ("duration_sec", 600), "fast": ("max_bpm", 600), "many_stops": ("stop_count", 100), "ln_heavy": ("ln_ratio", 0.8)}


@query("prj_flags", f"""WITH {S.ITEMS}, x AS (SELECT item, notes * 300 AS total_notes, x2 - 350 AS duration_sec, notes * 15 AS max_bpm, notes * 3 AS stop_count, notes / 50.0 AS ln_ratio, CASE WHEN item % 7 = 0 THEN -1 ELSE 1 END * notes AS min_bpm FROM items),
 f AS (SELECT item, list_filter([CASE WHEN total_notes > 10000 THEN 'many_notes' END, CASE WHEN duration_sec > 600 THEN 'long' END, CASE WHEN max_bpm > 600 THEN 'fast' END, CASE WHEN stop_count > 100 THEN 'many_stops' END,
 CASE WHEN ln_ratio > 0.8 THEN 'ln_heavy' END, CASE WHEN min_bpm < 0 THEN 'negative_bpm' END], lambda z: z IS NOT NULL) AS q FROM x) SELECT item, array_to_string(list_sort(q), '|') AS flags FROM f""")
def prj_flags(spark, sf):
    it = t.items(spark, sf)
    x = it.select("item", (F.col("notes") * 300).alias("total_notes"), (F.col("x2") - 350).alias("duration_sec"), (F.col("notes") * 15).alias("max_bpm"),
                  (F.col("notes") * 3).alias("stop_count"), (F.col("notes") / 50.0).alias("ln_ratio"), (F.when(F.col("item") % 7 == 0, -1).otherwise(1) * F.col("notes")).alias("min_bpm"))
    rules = {n: F.col(col) > lim for n, (col, lim) in FLAG_LIMITS.items()} | {"negative_bpm": F.col("min_bpm") < 0}
    return x.select("item", F.array_join(reasons(rules), "|").alias("flags"))


@query("flt_label_gate", """SELECT quality, count(*) AS n, count(*) >= 10 AS enough FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 AND quality IS NOT NULL GROUP BY quality""")
def flt_label_gate(spark, sf):
    """Rows with a usable label, flagged rows dropped, and whether a class has enough rows to train on."""
    lab = t.table(spark, sf, "labels").filter((F.col("toxic") == 0) & F.col("quality").isNotNull())
    return lab.join(t.table(spark, sf, "documents", "doc_id"), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 10).alias("enough"))
