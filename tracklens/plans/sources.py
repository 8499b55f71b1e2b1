"""Readers and sinks, driven by data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r
from ..operators import audit
from ..operators.corpus import STATS
from ..sources import files, sinks
from ..sources import tables as t
from . import sqlparts as S
from .registry import query


def manifest_records(spark, sf, extra: bool = False):
    """One manifest record per item; with ``extra`` every 50th carries a surplus feature."""
    it = t.items(spark, sf)
    n = F.when(F.lit(extra) & (F.col("item") % 50 == 0), 27).otherwise(26)
    feats = F.transform(F.sequence(F.lit(1), n), lambda i: F.col("notes") * i / 2.0)
    key = F.col("item").cast("string")
    return it.select(
        F.concat(F.lit("packs/"), "kind", F.lit("/"), key).alias("path"), F.md5(key).alias("md5"), F.sha2(key, 256).alias("sha256"), "title", F.lit("g").alias("group_id"), feats.alias("features"),
        F.array(F.struct(F.lit("sl").alias("table"), key.alias("level"), F.col("x1").alias("value"))).alias("labels"), F.struct(F.col("notes").cast("long").alias("total_notes"), F.col("x2").alias("duration_sec")).alias("meta"))


@query("src_manifest_json", f"""SELECT concat('packs/', p_type, '/', CAST(p_partkey AS VARCHAR)) AS path, md5(CAST(p_partkey AS VARCHAR)) AS md5, sha256(CAST(p_partkey AS VARCHAR)) AS sha256, p_name AS title, CAST(p_size AS BIGINT) AS notes, p_retailprice AS duration_sec,
 {', '.join(f'p_size * {i + 1} / 2.0 AS c_{n}' for i, n in enumerate(STATS))} FROM part""")
def src_manifest_json(spark, sf):
    path = sinks.scratch(spark, "manifest")
    manifest_records(spark, sf).write.json(path)
    return files.flatten_manifest(files.require_arity(files.read_manifest(spark, path)))


@query("src_manifest_arity", "SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 50 = 0) AS n_bad FROM part")
def src_manifest_arity(spark, sf):
    path = sinks.scratch(spark, "manifest")
    manifest_records(spark, sf, extra=True).write.json(path)
    return files.arity_report(files.read_manifest(spark, path))


@query("src_table_json", """SELECT concat('t', CAST(p_partkey // 100 AS VARCHAR)) AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE sha256(CAST(p_partkey AS VARCHAR)) END AS sha256, md5(CAST(p_partkey AS VARCHAR)) AS md5, CAST(p_size AS DOUBLE) AS level FROM part WHERE p_partkey % 7 <> 0""")
def src_table_json(spark, sf):
    it = t.table(spark, sf, "part", "p_partkey", "p_size")
    k = F.col("p_partkey").cast("string")
    lv = F.when(F.col("p_partkey") % 7 == 0, "?").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("+")))
    entry = F.struct(F.upper(F.md5(k)).alias("md5"), F.when(F.col("p_partkey") % 3 != 0, F.upper(F.sha2(k, 256))).alias("sha256"), lv.alias("level"))
    docs = it.groupBy(F.concat(F.lit("t"), F.floor(F.col("p_partkey") / 100).cast("string")).alias("name")).agg(F.collect_list(entry).alias("data"))  # 100 entries per document
    bare = F.floor(F.col("k")) % 2 == 1  # every other table is a bare array in a folder of its name
    docs = docs.withColumn("k", F.substring("name", 2, 20).cast("long"))
    objects, arrays = sinks.scratch(spark, "levels"), sinks.scratch(spark, "level-arrays")
    docs.filter(~bare).select("name", "data", F.lit("s").alias("symbol")).write.json(objects)
    docs.filter(bare).select("name", F.to_json("data").alias("value")).write.partitionBy("name").text(arrays)
    both = files.read_level_table(spark, objects).unionByName(files.read_level_table(spark, arrays))
    return both.select("name", "sha256", "md5", "level")


@query("src_log_scan", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def src_log_scan(spark, sf):
    return t.table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax")


@query("src_file_listing")
def src_file_listing(spark, sf):
    return files.list_files(spark, sf)


@query("sink_parquet", f"WITH {S.FP} SELECT lamp, count(*) AS n, round(avg(acc), 4) AS acc FROM fp GROUP BY lamp")
def sink_parquet(spark, sf):
    back = sinks.write_parquet(t.first_plays(spark, sf).select("player", "item", "ts", "acc", "lamp"), sinks.scratch(spark, "first_plays"), ["lamp"])
    return back.groupBy("lamp").agg(F.count(F.lit(1)).alias("n"), r(F.avg("acc"), 4).alias("acc"))


@query("sink_report", f"WITH {S.FP} SELECT 'run-1' AS run_id, 1 AS seed, metric, value FROM (SELECT 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fp UNION ALL SELECT 'acc_mean', round(avg(acc), 4) FROM fp)")
def sink_report(spark, sf):
    m = audit.metrics_long(t.first_plays(spark, sf).agg(F.count(F.lit(1)).alias("n"), r(F.avg("acc"), 4).alias("acc_mean")))
    return sinks.write_report({"run_id": "run-1", "seed": 1}, m, sinks.scratch(spark, "report"))


@query("sink_csv_ranked", f"""WITH {S.FP}, {S.ITEMS} SELECT item, concat(title, ', "', brand, '"') AS label, round(avg(acc), 4) AS score FROM fp JOIN items USING (item) GROUP BY item, title, brand""")
def sink_csv_ranked(spark, sf):
    j = t.first_plays(spark, sf).groupBy("item").agg(r(F.avg("acc"), 4).alias("score")).join(t.items(spark, sf), "item")
    out = j.select("item", F.concat("title", F.lit(', "'), "brand", F.lit('"')).alias("label"), "score")
    return sinks.write_ranked_csv(out, [F.desc("score"), "item"], sinks.scratch(spark, "ranked"))


@query("sink_incremental", f"""WITH {S.LOG}, s AS (SELECT item, count(*) AS n, round(avg(acc), 4) AS acc FROM log GROUP BY item) SELECT item, n, acc, CASE WHEN item % 3 = 0 THEN 1 WHEN item % 3 = 1 THEN 2 ELSE 3 END AS version FROM s""")
def sink_incremental(spark, sf):
    """First run stores a third of the items, a second run only adds the missing ones, a late update replaces a third."""
    log = t.play_log(spark, sf)

    def stat(df, v):
        return df.groupBy("item").agg(F.count(F.lit(1)).alias("n"), r(F.avg("acc"), 4).alias("acc")).withColumn("version", F.lit(v))

    stored = sinks.write_parquet(stat(log.filter("item % 3 <> 1"), 1), sinks.scratch(spark, "stats"))
    todo = sinks.missing(log, stored, ["item"])
    grown = sinks.merge_latest(stored, stat(todo, 2), ["item"], "version")
    return sinks.merge_latest(grown, stat(log.filter("item % 3 = 2"), 3), ["item"], "version")
