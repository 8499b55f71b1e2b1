"""The document pipeline: quality rules, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns
of ``documents``.  Rows with null in any column pass through the same rules: a null text counts as empty and fails the quality
rules; a null key is treated as in ``near.one_of_each``.  Columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import decontam, near, packing, pii, quality
from tracklens.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    judged = quality.line_quality(docs.select(*COLUMNS), carry=["doc_id", "lang", "source"])
    kept = judged.filter("kept").select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    return kept.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    return near.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    out = pii.pseudonymise(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, one row a piece with its token ids."""
    import public_tokenizers

    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_dedup), ("benchmark decontamination", decontaminate), ("personal data", surrogates), ("packing", pack)]

ORACLE_SQL = None  # signatures, edit distances, keyed surrogates and tokens are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
