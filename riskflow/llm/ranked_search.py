"""Ranked lexical search by pipelined term partitioning (operator 12).

Postings are held by owners of terms, one owner after the other: the bundles of
items travel through the owners, and at each stop the owner's postings add
their integer contributions to the bundles' sparse accumulators, until the last
stop selects the best documents.

Documents are numbered in blocks of bounded size where they are read, so a
bundle is carried block by block: (block, bundle) is the key by which a stage
cogroups accumulators and postings, and a term in every document is spread over
all blocks.  Owners take terms from rare to frequent, each about the same number
of postings, so that the accumulators grow late.  Only postings of terms that
items may ask for leave the texts: a filter of fixed size, filled by Spark, says
which; its false positives end in the join with the terms of the items.

Each (block, bundle) keeps the best documents of every item, and the best of
those are the result; nothing is left out before.

Defined cases: null texts have no term; such documents count neither in N nor
in L, such items have no result; repeated items and documents are ranked each;
equal scores go by ascending doc_id, null last; very long texts are read whole,
in stretches; empty tables give an empty result; other columns are not read.
"""
from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import settle, shared_folder
from riskflow.llm.terms import WORDS_DIGITS, split_texts

#: documents of a block, items of a bundle, owners of terms
BLOCK, ITEMS, OWNERS = 4096, 32, 4
#: bits of the filter of asked terms (1 MiB), whatever the number of items
BITS = 1 << 23
#: terms that one worker remembers
REMEMBERED = 400_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def asked_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item, item_id, bundle, term, q: the terms of every numbered item and how often it has them."""
    i = settle(items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
               .withColumn("item", F.monotonically_increasing_id()), "items")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = i.select("item_id", "item", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return settle(terms.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("q"))
                  .withColumn("bundle", F.floor(F.col("item") / ITEMS)), "asked")


def _filter(asked: DataFrame) -> bytes:
    """BITS bits, set at the CRC of every asked term."""
    at = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BITS))
    words = asked.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()  # BITS / 64 rows at most
    out = np.zeros(BITS // 64, dtype=np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.tobytes()


class _Asked(dict):
    """Whether a term may be asked for, remembered."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        at = zlib.crc32(term) % BITS
        known = self[term] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return known


def postings(docs: DataFrame, asked: bytes, doc_id: str, text: str) -> DataFrame:
    """Rows of blocks: term null with ids and ns of the block's documents, or a term with its docs, tfs and ns.

    Documents are numbered within a block by doc_id, null last; docs, tfs, ns
    of a term are little-endian 16, 32 and 32-bit numbers.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def rows(no, held):
        held.sort(key=lambda x: (x[0] is None, x[0] or 0))
        at, tf = defaultdict(list), defaultdict(list)
        for i, (_, _, terms) in enumerate(held):
            for term, n in terms.items():
                at[term].append(i)
                tf[term].append(n)
        ns = np.array([n for _, n, _ in held], dtype=np.int64)
        short = ns.astype("<u4")
        docs = [np.array(x, dtype="<u2") for x in at.values()]
        none = [None] * len(docs)
        return pa.RecordBatch.from_arrays([
            pa.array([no] * (len(docs) + 1), pa.int64()), pa.array([None, *at], pa.binary()).cast(pa.string()),
            pa.array([len(held), *map(len, docs)], pa.int64()), pa.array([None, *(x.tobytes() for x in docs)], pa.binary()),
            pa.array([None, *(np.array(x, dtype="<u4").tobytes() for x in tf.values())], pa.binary()),
            pa.array([None, *(short[x].tobytes() for x in docs)], pa.binary()),
            pa.array([[i for i, _, _ in held], *none], pa.list_(pa.int64())), pa.array([int(ns.sum()), *none], pa.int64()),
            pa.array([int((ns > 0).sum()), *none], pa.int64())],
            names=["block", "term", "df", "docs", "tfs", "ns", "ids", "terms", "with_terms"])

    def read(batches):
        known, held, no = _Asked(asked), [], TaskContext.get().partitionId() << 33
        for b in batches:
            for i, parts in zip(b.column(0).to_pylist(), split_texts(b.column(1), WORDS_DIGITS)):
                n, found = 0, Counter()
                for words in parts:
                    n += len(words)
                    found.update(filter(known.__getitem__, words))
                held.append((i, n, found))
                if len(known) > REMEMBERED:
                    known.clear()
                if len(held) == BLOCK:
                    yield rows(no, held)
                    held, no = [], no + 1
        if held:
            yield rows(no, held)

    kinds = "block long, term string, df long, docs binary, tfs binary, ns binary, ids array<long>, terms long, with_terms long"
    return settle(src.mapInArrow(read, kinds), "postings")


def _stage(docs: int, terms: int, best: int | None):
    """Adds an owner's contributions to the accumulators of a (block, bundle); best: selects that many of every item."""

    def add(acc: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
        first = owned if len(owned) else acc
        block, bundle = int(first["block"].iloc[0]), int(first["bundle"].iloc[0])
        items: dict[int, np.ndarray] = {}
        for item, at, score in zip(acc["item"], acc["docs"], acc["scores"]):
            items[item] = np.zeros(BLOCK, dtype=np.int64)
            items[item][np.frombuffer(at, "<u2")] = np.frombuffer(score, "<i8")
        for w, at, tf, n, who, q in zip(owned["w"], owned["docs"], owned["tfs"], owned["ns"], owned["items"], owned["qs"]):
            at, tf = np.frombuffer(at, "<u2"), np.frombuffer(tf, "<u4").astype(np.int64)
            m = 25 + (75 * np.frombuffer(n, "<u4").astype(np.int64) * docs) // terms
            given = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            for item, times in zip(who, q):
                if item not in items:
                    items[item] = np.zeros(BLOCK, dtype=np.int64)
                items[item][at] += times * given
        out = []
        for item, scores in items.items():
            at = np.flatnonzero(scores)
            if best is not None:  # equal scores: the lower number has the lower doc_id
                at = at[np.lexsort((at, -scores[at]))[:best]]
            out.append((block, bundle, item, at.astype("<u2").tobytes(), scores[at].astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["block", "bundle", "item", "docs", "scores"])

    return add


def _unpack(batches):
    """item, block, at, score of selected documents."""
    for b in batches:
        for item, block, docs, scores in zip(b["item"], b["block"], b["docs"], b["scores"]):
            at = np.frombuffer(docs, "<u2").astype(np.int32)
            yield pd.DataFrame({"item": item, "block": block, "at": at, "score": np.frombuffer(scores, "<i8")})


def search(docs: DataFrame, items: DataFrame, best: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item, of all documents."""
    spark = docs.sparkSession
    asked = asked_terms(items, item_id, text)
    blocks = postings(docs, _filter(asked), doc_id, text)
    total = blocks.filter("term IS NULL").agg(F.sum("with_terms").alias("n"), F.sum("terms").alias("l")).first()
    n, length = total["n"] or 0, max(total["l"] or 0, 1)

    held = blocks.filter("term IS NOT NULL")
    df = held.groupBy("term").agg(F.sum("df").alias("df"), F.count(F.lit(1)).alias("rows"))
    weighed = settle(asked.select("term").distinct().join(df, "term")
                     .withColumn("w", F.floor(1000 * F.log((2 * F.lit(n) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")), "terms")
    # powers of two of df, at most 64: postings in rarer ones decide the owner
    sizes = sorted((r["power"], r["n"]) for r in weighed.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).agg(F.sum("df").alias("n")).collect())
    every, before, owner_of = sum(x for _, x in sizes), 0, {}
    for power, x in sizes:
        owner_of[power] = min(OWNERS - 1, OWNERS * before // every)
        before += x
    owner: Column = F.lit(0)
    for power, at in owner_of.items():
        owner = F.when(F.floor(F.log2("df")).cast("int") == power, at).otherwise(owner)
    sent = asked.groupBy("bundle", "term").agg(F.collect_list("item").alias("items"), F.collect_list("q").alias("qs")) \
        .join(weighed.select("term", "w", owner.alias("owner")), "term")
    routed = held.select("block", "term", "docs", "tfs", "ns").join(sent, "term").drop("term")
    path = f"{shared_folder(spark)}/owners-{uuid.uuid4().hex[:12]}"
    routed.write.partitionBy("owner").parquet(path)
    owners = spark.read.schema(routed.schema).parquet(path)

    shape = "block long, bundle long, item long, docs binary, scores binary"
    acc = spark.createDataFrame([], shape)
    for k in range(OWNERS):
        stage = _stage(n, length, best if k == OWNERS - 1 else None)
        owned = owners.filter(F.col("owner") == k).drop("owner")
        acc = acc.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle")).applyInPandas(stage, shape)

    found = acc.mapInPandas(_unpack, "item long, block long, at int, score long")
    ids = blocks.filter("term IS NULL").select("block", "ids")
    found = found.join(ids, "block").select("item", F.get("ids", F.col("at")).alias("doc_id"), "score").filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= best)
    return top.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
