"""Readers with declared schemas: chart manifest, level tables, file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_level
from ..operators.corpus import STATS

MANIFEST = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("md5", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("group_id", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("labels", T.ArrayType(T.StructType([T.StructField("table", T.StringType()), T.StructField("level", T.StringType()), T.StructField("value", T.DoubleType())]))),
    T.StructField("issues", T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())]))),
    T.StructField("quarantine", T.ArrayType(T.StringType())), T.StructField("flags", T.ArrayType(T.StringType())),
    T.StructField("meta", T.StructType([T.StructField("total_notes", T.LongType()), T.StructField("duration_sec", T.DoubleType())])),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def flatten_manifest(man: DataFrame, names: list[str] = STATS) -> DataFrame:
    """Feature array -> named columns, meta struct -> columns."""
    cols = [F.try_element_at("features", F.lit(i + 1)).alias(f"c_{n}") for i, n in enumerate(names)]
    return man.select("path", "md5", "sha256", "title", F.col("meta.total_notes").alias("notes"), F.col("meta.duration_sec").alias("duration_sec"), *cols)


def arity_report(man: DataFrame, names: list[str] = STATS) -> DataFrame:
    bad = F.coalesce(F.size("features"), F.lit(-1)) != len(names)
    return man.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("n_bad"))


def require_arity(man: DataFrame, names: list[str] = STATS) -> DataFrame:
    r = arity_report(man, names).first()
    if r.n_bad:
        raise ValueError(f"{r.n_bad} of {r.n} records do not carry {len(names)} features")
    return man


def read_level_table(spark: SparkSession, path: str, name: str | None = None, whole_files: bool = False) -> DataFrame:
    """(name, sha256, md5, level) from JSON documents, one a line or (``whole_files``) one a file.

    A document is an object with a ``data`` array, or the bare array.  Its name is the object's, else ``name`` (the header's), else that of
    a folder ``name=...``, else that of its file.  Hashes are lower-cased; entries that are no objects, have no hash or
    no readable level are dropped, as are lines that are no JSON.
    """
    raw = spark.read.text(path, wholetext=whole_files)
    folder = F.col("name") if "name" in raw.columns else F.lit(None).cast("string")
    doc = raw.select(F.try_parse_json("value").alias("v"), folder.alias("folder"), F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("file"))
    get = lambda at, kind, of="v": F.try_variant_get(of, at, kind)
    own = doc.select(F.coalesce(get("$.name", "string"), F.lit(name), "folder", "file").alias("name"), F.coalesce(get("$.data", "array<variant>"), get("$", "array<variant>")).alias("data"))
    e = own.select("name", F.explode("data").alias("d"))
    out = e.select("name", F.lower(get("$.sha256", "string", "d")).alias("sha256"), F.lower(get("$.md5", "string", "d")).alias("md5"), get("$.level", "string", "d").alias("lv"))
    return out.withColumn("level", parse_level("lv")).drop("lv").filter("level is not null and coalesce(sha256, md5) is not null")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes per extension.  Only metadata columns are selected, so no content is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return f.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))
