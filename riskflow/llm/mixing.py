"""Mixing sources to target weights by pivotal rounding (operator 8, native).

Each source has a target in words; a document's fractional copy count is
target / source size.  Whole copies are taken outright; the fractions are
rounded dependently: two documents with fractions p, q exchange mass (in words)
at random until one of them is 0 or 1, so the words of a source are kept in
every step.  Documents are dealt into bounded blocks by hash; each block is one
fold and leaves at most one fractional document, which goes up to the next
level of the reduction tree until one is left per source.  That last one goes
to the nearer whole number, so a source misses its target by at most half of
one document.

Defined cases: a null or blank text has size 0 and takes 0 words; a null source
is a source of its own, last in order; repeated rows are separate documents; an
empty table gives an empty result.  Choices follow hashes of doc_id and a seed,
so reruns agree.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.llm.common import n_words, settle

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64
EPS = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: _source, _docs, source_size, target (words).

    Weights repeat over the sources in code point order, null last.  Targets
    share all words by weight; the water level is found in one pass over the
    sources sorted by the level at which they reach their cap.
    """
    per = sizes.groupBy(F.col("_source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_weight", weight).withColumn("_most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("_most") / F.col("_weight"), F.col("_source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("_most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("_level", (total - before) / rest).withColumn("_rank", F.row_number().over(order))
    free = F.when(F.col("_most") > F.col("_level") * F.col("_weight"), F.struct("_rank", "_level"))
    level = F.min(free).over(Window.partitionBy())["_level"]
    target = F.when(level.isNull(), F.col("_most")).otherwise(F.least(F.col("_most"), level * F.col("_weight")))
    return per.select("_source", "_docs", "source_size", target.alias("target"))


def _pivot(acc: Column, x: Column) -> Column:
    """One step of the fold: acc = (live unit or null, done units), x the next unit."""
    a = acc["live"]
    up = F.least(1 - a["p"], x["p"] * x["size"] / a["size"])
    down = F.least(a["p"], (1 - x["p"]) * x["size"] / a["size"])
    move = F.when(x["u"] * (up + down) < down, up).otherwise(-down)
    a2 = a["p"] + move
    x2 = x["p"] - move * a["size"] / x["size"]

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(u["order"].alias("order"), u["u"].alias("u"), u["id"].alias("id"), u["size"].alias("size"),
                        p.alias("p"), u["rest"].alias("rest"))

    whole = lambda p: (p < EPS) | (p > 1 - EPS)
    none = F.when(F.lit(False), x)
    a_done, x_done = whole(a2), whole(x2)
    live = F.when(~a_done, with_p(a, a2)).when(~x_done, with_p(x, x2)).otherwise(none)
    fresh = F.when(a_done & x_done, F.array(with_p(a, F.round(a2)), with_p(x, F.round(x2)))) \
        .when(a_done, F.array(with_p(a, F.round(a2)))) \
        .when(x_done, F.array(with_p(x, F.round(x2)))) \
        .otherwise(F.slice(acc["done"], 1, 0))
    return F.when(a.isNull(), F.struct(x.alias("live"), acc["done"].alias("done"))) \
        .otherwise(F.struct(live.alias("live"), F.concat(acc["done"], fresh).alias("done")))


def _round_level(units: DataFrame) -> DataFrame:
    """Fold each (source, block): one row with its done units and its live one."""
    kind = units.schema["unit"].dataType.simpleString()
    start = F.expr(f"named_struct('live', cast(null as {kind}), 'done', cast(array() as array<{kind}>))")
    folded = units.groupBy("_source", "_block", "_blocks").agg(F.sort_array(F.collect_list("unit")).alias("us"))
    return folded.select("_source", "_block", "_blocks", F.aggregate("us", start, _pivot).alias("r"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
        cap: int = CAP, seed: int = 8) -> DataFrame:
    """_row (doc_id), _source, size, source_size, target, copies of every document.

    Only ids and sizes are shuffled.  copies is the whole number of times that
    the mix takes the document.
    """
    sizes = settle(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"),
                               n_words(F.col(text)).alias("size")), "mix-sizes")
    targets = settle(source_targets(sizes, weights, cap), "mix-targets")
    # one row per source, of measured size; beyond the bound Spark joins by shuffle and splits a hot source
    few = targets.count() <= 100_000
    d = sizes.join(F.broadcast(targets) if few else targets, sizes["_source"].eqNullSafe(targets["_source"])) \
        .drop(targets["_source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.withColumn("_rate", rate).withColumn("_whole", F.floor(F.col("_rate") + EPS))
    d = d.withColumn("_p", F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0)))
    out = ["_id", "_source", "size", "source_size", "target"]
    split = (F.col("_p") > EPS) & (F.col("size") > 0)
    done = [d.filter(~split).select(*out, F.col("_whole").alias("copies"))]

    draw = F.xxhash64(F.lit(seed), F.col("_id"), F.col("size"))
    unit = F.struct((-F.col("size")).alias("order"), (F.pmod(F.xxhash64(F.lit(seed + 1), draw), F.lit(1 << 30)) / float(1 << 30)).alias("u"),
                    F.col("_id").alias("id"), F.col("size").cast("double").alias("size"), F.col("_p").alias("p"),
                    F.struct("_whole", "source_size", "target", F.col("size").alias("words")).alias("rest"))
    blocks = F.ceil(F.col("_docs") / BLOCK).cast("long")
    units = d.filter(split).select("_source", F.pmod(draw, blocks).alias("_block"), blocks.alias("_blocks"), unit.alias("unit"))
    most = targets.agg(F.max("_docs")).first()[0] or 0
    levels = 1 + math.ceil(math.log(max(1, most / BLOCK), BLOCK)) + (1 if most > BLOCK else 0)

    def rows(units: DataFrame, p: Column) -> DataFrame:
        u = F.col("unit")
        return units.select(u["id"].alias("_id"), "_source", u["rest"]["words"].alias("size"),
                            u["rest"]["source_size"].alias("source_size"), u["rest"]["target"].alias("target"),
                            (u["rest"]["_whole"] + p.cast("long")).alias("copies"))

    for _ in range(levels):
        level = settle(_round_level(units), "mix-level")
        done.append(rows(level.select("_source", F.explode("r.done").alias("unit")), F.round(F.col("unit")["p"])))
        above = F.ceil(F.col("_blocks") / BLOCK).cast("long")
        units = level.filter("r.live is not null").select(
            "_source", F.floor(F.col("_block") / BLOCK).alias("_block"), above.alias("_blocks"), F.col("r.live").alias("unit"))
    done.append(rows(units, F.round(F.col("unit")["p"])))  # one per source is left
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
