"""A corpus-cleaning pipeline: quality, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents.  run() writes
every stage to the shared folder and reads it back for the next one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import mixing, quality_rules, queries, simhash, substring_dedup
from riskflow.llm.common import settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _h, a hash of the text, and _n, which tells identical (doc_id, text) rows apart."""
    d = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("lang", "source", "n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.judge(docs, COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the least doc_id (null last), then the least text hash."""
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    found = simhash.near_duplicates(keyed, shingle=3, radius=3, keep=("_h",))
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_h")).alias("x")) \
        .select(F.col("x.doc_id").alias("_id"), F.col("x._h").alias("_s"))
    d = _numbered(docs).filter("_n = 1")
    return d.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_s")), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur earlier go; a document may become empty but stays."""
    d = substring_dedup.dedup_substrings(docs, [c for c in COLUMNS if c not in ("text", "n_chars")])
    return d.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as many times as the mix takes it."""
    d = docs.withColumn("_key", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
    taken = mixing.mix(d, doc_id="_key").select(F.col("_id.doc_id").alias("_id"), F.col("_id.h").alias("_s"), "copies")
    taken = taken.groupBy("_id", "_s").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    d = _numbered(docs).filter("_n = 1")
    d = d.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_s")))
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and the proof that they decode to its text."""
    return queries.encoded_digests(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeated_passages),
          ("mixing sources to target weights", mix), ("SentencePiece encoding and decoding", encode)]

#: XXH64 fingerprints, dependent rounding and the piece model are outside SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
