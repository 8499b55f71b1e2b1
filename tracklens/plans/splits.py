"""Held-out splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import draw_hex, draw_long, r
from ..operators import audit, skew, splits
from ..session import cut
from ..sources import tables as t
from . import sqlparts as S
from .registry import query

KEY = ["player", "item"]


def hexq(*p):
    return S.draw_hex(*p)


RI = f"{hexq(chr(39) + 'ri' + chr(39), chr(39) + '0' + chr(39), 'player', 'item')} < '{splits.below(0.2)}'"


@query("spl_random", f"WITH {S.BEST} SELECT player, item, {RI} AS is_test FROM best")
def spl_random(spark, sf):
    return splits.random_mask(t.best_rows(spark, sf), 0, 0.2).select(*KEY, "is_test")


def loo_sql(k):
    u = hexq(f"'loo{k}'", "'0'", "player", "item")
    return f"SELECT {k} AS k, player, item FROM (SELECT player, item, row_number() OVER (PARTITION BY player ORDER BY {u}, item) AS rn FROM best) WHERE rn <= {k}"


@query("spl_loo_k", f"WITH {S.BEST} " + " UNION ALL ".join(loo_sql(k) for k in (1, 5, 10)))
def spl_loo_k(spark, sf):
    b = cut(t.best_rows(spark, sf).select(*KEY))
    parts = [splits.leave_k_out(b, k, 0).withColumn("k", F.lit(k)) for k in (1, 5, 10)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cold_sql(g, salt):
    return f"""WITH {S.BEST}, g AS (SELECT {g}, row_number() OVER (ORDER BY {hexq(f"'{salt}'", "'0'", g)}, {g}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT {g} FROM best))
 SELECT player, item, acc FROM best WHERE {g} IN (SELECT {g} FROM g WHERE rn <= greatest(1, round(n * 0.1)))"""


@query("spl_cold_player", cold_sql("player", "cold_player"))
def spl_cold_player(spark, sf):
    b = t.best_rows(spark, sf)
    return b.join(splits.cold_groups(b, "player", 0.1, 0, "cold_player"), "player", "left_semi").select(*KEY, "acc")


@query("spl_cold_item", cold_sql("item", "cold_item"))
def spl_cold_item(spark, sf):
    b = t.best_rows(spark, sf)
    return b.join(splits.cold_groups(b, "item", 0.1, 0, "cold_item"), "item", "left_semi").select(*KEY, "acc")


@query("spl_inner", f"""WITH {S.BEST}, tr AS (SELECT * FROM best WHERE NOT {RI}) SELECT player, item FROM (SELECT player, item, count(*) OVER (PARTITION BY player) AS n,
 row_number() OVER (PARTITION BY player ORDER BY {hexq("'ri_inner'", "'0'", 'player', 'item')}, item) AS rn FROM tr) WHERE rn <= greatest(1, round(n * 0.1))""")
def spl_inner(spark, sf):
    tr = splits.random_mask(t.best_rows(spark, sf), 0, 0.2).filter("not is_test")
    return splits.per_player_quota(tr, 0.1, 0, "ri_inner", t.hot(spark, sf, "player")).select(*KEY)


@query("spl_report", f"""WITH {S.BEST}, s AS (SELECT *, {RI} AS is_test FROM best), m AS (SELECT count(*) FILTER (WHERE is_test) AS n_test, count(*) FILTER (WHERE NOT is_test) AS n_train, count(DISTINCT player) FILTER (WHERE is_test) AS test_players,
 count(DISTINCT item) FILTER (WHERE is_test) AS test_items, count(DISTINCT player) FILTER (WHERE NOT is_test) AS train_players, count(DISTINCT item) FILTER (WHERE NOT is_test) AS train_items,
 (SELECT count(*) FROM (SELECT player FROM s WHERE is_test EXCEPT SELECT player FROM s WHERE NOT is_test)) AS cold_players, (SELECT count(*) FROM (SELECT item FROM s WHERE is_test EXCEPT SELECT item FROM s WHERE NOT is_test)) AS cold_items,
 count(*) FILTER (WHERE is_test) / count(DISTINCT player) FILTER (WHERE is_test) AS rows_per_player FROM s)
 SELECT metric, round(value, 6) AS value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM m) UNPIVOT (value FOR metric IN (n_test, n_train, test_players, test_items, train_players, train_items, cold_players, cold_items, rows_per_player))""")
def spl_report(spark, sf):
    return split_report(splits.random_mask(t.best_rows(spark, sf), 0, 0.2)).select("metric", r("value").alias("value"))


def split_report(s):
    """Sizes, distinct and cold keys of a split, from two per-key aggregates."""
    def keyed(k):
        return s.groupBy(k).agg(F.count(F.when(F.col("is_test"), 1)).alias("te"), F.count(F.when(~F.col("is_test"), 1)).alias("tr"))

    te, tr = F.col("te") > 0, F.col("tr") > 0
    p = keyed("player").agg(F.sum("te").alias("n_test"), F.sum("tr").alias("n_train"), F.count(F.when(te, 1)).alias("test_players"), F.count(F.when(tr, 1)).alias("train_players"),
                            F.count(F.when(te & ~tr, 1)).alias("cold_players")).withColumn("rows_per_player", F.try_divide("n_test", "test_players"))
    i = keyed("item").agg(F.count(F.when(te, 1)).alias("test_items"), F.count(F.when(tr, 1)).alias("train_items"), F.count(F.when(te & ~tr, 1)).alias("cold_items"))
    return audit.metrics_long(p).unionByName(audit.metrics_long(i))


def song_sql(parts, rest, seed="0"):
    case, edge = [], "0"
    for n, f in parts:
        edge = f"{edge} + round(n * {f})"
        case.append(f"WHEN rn <= {edge} THEN '{n}'")
    return f"""g AS (SELECT title, rn, CASE {' '.join(case)} ELSE '{rest}' END AS part FROM (SELECT title, row_number() OVER (ORDER BY {hexq("'song'", f"'{seed}'", 'title')}, title) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT title FROM items)))"""


@query("spl_song", f"""WITH {S.ITEMS}, {song_sql([('val', 0.2)], 'train')}, h AS ({song_sql([('train', 0.7), ('val', 0.15)], 'test', '1').replace('g AS (', '', 1)[:-1]})
 SELECT item, g.part AS two_way, h.part AS three_way FROM items JOIN g USING (title) JOIN h USING (title)""")
def spl_song(spark, sf):
    it = t.items(spark, sf)
    two = splits.group_assign(it, "title", 0, [("val", 0.2)], "train").select("title", F.col("part").alias("two_way"))
    three = splits.group_assign(it, "title", 1, [("train", 0.7), ("val", 0.15)], "test").select("title", F.col("part").alias("three_way"))
    return it.select("item", "title").join(two, "title").join(three, "title").select("item", "two_way", "three_way")


@query("spl_song_guard", f"""WITH {S.ITEMS}, {song_sql([('train', 0.9), ('val', 0.05)], 'test')}, p AS (SELECT DISTINCT title FROM items WHERE brand = 'Brand#7' AND notes > 47),
 mv AS (SELECT title, row_number() OVER (ORDER BY rn) AS i FROM g WHERE part = 'train' AND title IN (SELECT title FROM p)), dn AS (SELECT title, row_number() OVER (ORDER BY rn) AS i FROM g WHERE part = 'test' AND title NOT IN (SELECT title FROM p)),
 ch AS (SELECT mv.title, CASE WHEN dn.title IS NULL THEN 'val' ELSE 'test' END AS np FROM mv LEFT JOIN dn USING (i) UNION ALL SELECT dn.title, 'train' FROM mv JOIN dn USING (i))
 SELECT title, coalesce(np, part) AS part FROM g LEFT JOIN ch USING (title)""")
def spl_song_guard(spark, sf):
    it = t.items(spark, sf)
    a = splits.group_assign(it, "title", 0, [("train", 0.9), ("val", 0.05)], "test")
    return splits.guard_swap(a, it.filter("brand = 'Brand#7' and notes > 47").select("title"), "title")


@query("spl_player_time", f"""WITH {S.FP} SELECT player, item, row_number() OVER (PARTITION BY player ORDER BY ts, seq, item) <= greatest(1, floor(count(*) OVER (PARTITION BY player) * 0.8)) AS is_fit FROM fp""")
def spl_player_time(spark, sf):
    fp, hot = t.first_plays(spark, sf), t.hot(spark, sf, "player")
    n = fp.groupBy("player").agg(F.count(F.lit(1)).alias("n"))
    rk = skew.prefix(fp, ["player"], t.FP_ORDER, {"rk": ("rank",)}, hot).join(n, "player")
    return rk.select(*KEY, (F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.8))).alias("is_fit"))


@query("spl_lopo", f"""WITH {S.BEST}, {S.CLIENTS}, t AS (SELECT team, count(*) AS n, sum(acc) AS s FROM best JOIN clients USING (player) GROUP BY team)
 SELECT team, n AS n_test, CAST((SELECT sum(n) FROM t) - n AS BIGINT) AS n_train, round(((SELECT sum(s) FROM t) - s) / ((SELECT sum(n) FROM t) - n), 6) AS train_mean, round(s / n, 6) AS test_mean FROM t""")
def spl_lopo(spark, sf):
    """Leave one roster member out: totals minus own share, no per-fold copy of the rows."""
    b = t.best_rows(spark, sf).join(t.clients(spark, sf), "player")
    g = b.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.sum("acc").alias("s"))
    n, s = g.agg(F.sum("n")).scalar(), g.agg(F.sum("s")).scalar()
    return g.select("team", F.col("n").alias("n_test"), (n - F.col("n")).alias("n_train"), r((s - F.col("s")) / (n - F.col("n"))).alias("train_mean"), r(F.col("s") / F.col("n")).alias("test_mean"))


@query("spl_kfold", f"""WITH {S.BEST} SELECT player, item, CAST('0x' || {hexq("'fold'", "'3'", 'item')} AS BIGINT) % 5 AS fold FROM best WHERE NOT {RI}""")
def spl_kfold(spark, sf):
    tr = splits.random_mask(t.best_rows(spark, sf), 0, 0.2).filter("not is_test")
    return tr.select(*KEY, splits.fold(5, 3, "item").alias("fold"))


@query("set_leak_check", f"""WITH {S.ITEMS}, s AS (SELECT regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS k, {hexq("'leak'", 'item')} < '33333333' AS is_val FROM items)
 SELECT k FROM s WHERE is_val INTERSECT SELECT k FROM s WHERE NOT is_val""")
def set_leak_check(spark, sf):
    """Normalised titles that appear on both sides of a per-item (not per-title) split."""
    s = t.items(spark, sf).select(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "").alias("k"), (draw_hex("leak", F.col("item")) < "33333333").alias("v"))
    return s.filter("v").select("k").intersect(s.filter("not v").select("k"))
