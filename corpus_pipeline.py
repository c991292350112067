"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
and read again as the next one's documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import jaccard, langid, mixing, packing, secrets
from runweave.llm.common import bitmap, bound_batches, in_bitmap, materialize, scratch, table

#: Words of a shingle and the least similarity, in per cent, of near duplicates; op9's own are stricter.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without a letter go, and a missing `lang` is the predicted one.

    A short text may be unsure and clean, so it stays whatever its score.
    """
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    found = langid.label(docs, docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), list(COLUMNS))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one: that with the smallest id, and of these that with the smallest key; rows without id come last.

    A row's key is a hash of its id and text, so rows that repeat an id with
    other texts are told apart, and rows that repeat both are one. Most texts
    stay where they are: only those whose key may go, or comes again, are dealt
    by it, as a bitmap of such keys tells.
    """
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()))
    linked = jaccard.join_components(keyed.select(F.col("row_key").alias("doc_id"), "text"), width=NEAR_WIDTH, percent=NEAR_PERCENT).select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = keyed.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    known = materialize(ids.join(linked, "row_key"), "near-keys")
    first = known.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias("row_key"), F.lit(True).alias("stays"))
    open_ = known.select("row_key", "times").join(first, "row_key", "left").where("stays is null or times > 1").select("row_key", F.coalesce("stays", F.lit(False)).alias("stays"))
    open_ = materialize(open_, "near-open", small=True)
    shared = spark.sparkContext.broadcast(bitmap(open_.select("row_key"), open_.count()))

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, keys.to_numpy()))

    rows = keyed.withColumn("hit", hit("row_key"))
    met = rows.where("hit").join(open_, "row_key", "left")
    # a row that comes again may do so very often, so the least of them is taken where they are
    again = met.where("stays").groupBy("row_key").agg(F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("r")).select("r.*")
    return rows.where("not hit").select(*COLUMNS).unionByName(met.where("stays is null").select(*COLUMNS)).unionByName(again.select(*COLUMNS))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.redact_secrets(docs.select(*COLUMNS))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]

#: SQL can express no stage but the second and fourth in part; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    with scratch("pack-tokens"):
        for name, stage in STAGES[:-1]:
            with scratch(f"pipeline-{name}"):
                docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
