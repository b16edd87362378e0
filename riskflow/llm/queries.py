"""Registered queries opN_<name> of the numbered operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole table.
"""
from __future__ import annotations

import hashlib

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import chat_trees, divergence, fingerprints, mixing, oracles, packing, quality_rules, ranked_search, sentence_pieces, simhash, substring_dedup, suffix_dedup, token_counts, url_filters
from riskflow.llm.common import table

#: verdict, host, path prefix
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is the doc_id whose label it carries; bad is junk or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]+)[^/]*/?(?:[?#]|$)', 1) as bigint)")
    labels = pages.select("page_id", number.alias("_doc")).join(labels, F.col("_doc") == F.col("doc_id")) \
        .select(F.col("page_id").alias("key"),
                F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("bad"))
    return url_filters.filter_urls(pages, labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), ["doc_id"])
    return d.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"), ["doc_id"])
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))


def encoded_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as 32-bit little-endian), decoded_sha256, exact round trip."""
    return sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], proof=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation reply to the turn before; the digests are read back from the formatted text."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    rows = rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    nodes = rows.select("tree", at.alias("node"), "role", "text").withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)) \
        .withColumn("score", F.lit(0.0))
    formatted = chat_trees.format_paths(nodes).select("tree", "formatted", "loss")

    def digest(batches):
        for b in batches:
            out = []
            for tree, text, loss in zip(b["tree"], b["formatted"], b["loss"], strict=True):
                turns = chat_trees.read_back(text)
                trained = chat_trees.loss_text(text, [(s["start"], s["length"]) for s in loss])
                every = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((int(tree) if tree else None, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(trained),
                            hashlib.sha256(trained.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]) \
                .astype({"conv_id": "Int64"})

    return formatted.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, ["doc_id"]).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents"))
    return d.select(F.col("_id").alias("doc_id"), "size", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cut_1024: code points of the longest prefix within 1024 tokens."""
    d = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"], budget=1024)
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.col("cut").alias("cut_1024"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
    return d.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_substring_dedup, op3_suffix_dedup, op4_sentence_pieces, op5_simhash, op6_chat_formatting, op7_quality_rules, op8_mixing, op9_fingerprints,
                                   op10_token_counts, op11_source_divergence, op12_ranked_search, op13_packing)}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": oracles.url_filters(URL_RULES),
    "op6_chat_formatting": oracles.chat(),
    "op7_quality_rules": oracles.quality(),
    "op11_source_divergence": oracles.divergence(),
    "op12_ranked_search": oracles.ranked(),
}
