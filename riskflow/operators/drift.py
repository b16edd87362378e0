"""Drift and data-quality measures.

PSI of a column: 10 equal-frequency bins cut at the reference sample's
percentiles (NumPy "linear" interpolation), outer edges open; a bin's share is
its count over the sample size, empty shares become 1e-8; PSI = sum (a-e) ln(a/e).

Exact percentiles are computed without gathering a column in one place: the
reference values are counted per distinct value (partial aggregation), running
counts over the distinct values are taken per feature with the skew-safe
blocked helper, and each wanted rank is matched to the distinct value whose
count range covers it (a broadcast of the few wanted ranks).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.operators.ordered import prefix_scan, store

# Monitored features, bucket count, empty-bin share, thresholds.
MONITORED = ["amount", "velocity", "merchant_risk"]
BUCKETS = 10
EMPTY_SHARE = 1e-8
PSI_WARNING = 0.1
PSI_THRESHOLD = 0.25


def psi_status(psi: Column) -> list[Column]:
    """colour and label by PSI."""
    return [F.when(psi < PSI_WARNING, "green").when(psi < PSI_THRESHOLD, "amber").otherwise("red").alias("color"),
            F.when(psi < PSI_WARNING, "STABLE").when(psi < PSI_THRESHOLD, "WARNING")
             .otherwise("DRIFT DETECTED").alias("status")]


def long_form(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) for the given numeric columns, nulls and NaN dropped."""
    d = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    return d.unpivot([], features, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def quantile_probs(buckets: int = BUCKETS) -> list[float]:
    return [i * 100 / buckets / 100 for i in range(buckets + 1)]


def quantile_arrays(long: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, qs) : NumPy-linear percentiles ``probs`` of each feature's values, as one array."""
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    return _quantiles(prefix_scan(counts, ["feature"], [F.col("value")], sums={"cum": F.col("c")}, position=None), probs)


def _quantiles(dv: DataFrame, probs: list[float]) -> DataFrame:
    """The same from counts c of distinct values and their running sums cum."""
    spark = dv.sparkSession
    n = dv.groupBy("feature").agg(F.sum("c").alias("n"))
    p = spark.createDataFrame([(i, float(q)) for i, q in enumerate(probs)], "i int, p double")
    pos = n.crossJoin(F.broadcast(p)).select(
        F.col("feature").alias("_wf"), "i", ((F.col("n") - 1) * F.col("p")).alias("pos"), "n")
    lo = F.floor("pos") + 1
    wanted = (pos.select("_wf", "i", "pos", lo.alias("k"), F.lit(0).alias("side"))
              .unionByName(pos.select("_wf", "i", "pos", F.least(lo + 1, F.col("n")).alias("k"),
                                      F.lit(1).alias("side"))))
    # `wanted` has 2 * len(probs) rows per feature: a proven small side.
    hit = dv.join(F.broadcast(wanted), (F.col("feature") == F.col("_wf"))
                  & (F.col("k") > F.col("cum") - F.col("c")) & (F.col("k") <= F.col("cum")), "inner")
    g = hit.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("i", "side", "value", "pos"))).alias("_h"))

    def q_at(i: int):
        lo_v = F.element_at("_h", 2 * i + 1)["value"]
        hi_v = F.element_at("_h", 2 * i + 2)["value"]
        pos_i = F.element_at("_h", 2 * i + 1)["pos"]
        d = pos_i - F.floor(pos_i)
        diff = hi_v - lo_v
        return F.when(d < 0.5, lo_v + diff * d).otherwise(hi_v - diff * (1 - d))
    return g.select("feature", F.array(*[q_at(i) for i in range(len(probs))]).alias("qs"))


def exact_quantiles(long: DataFrame, probs: list[float]) -> DataFrame:
    """(feature, i, q) long form of :func:`quantile_arrays`."""
    return quantile_arrays(long, probs).select("feature", F.posexplode("qs").alias("i", "q"))


def bin_edges(reference_long: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, inner) : the ``buckets - 1`` inner edges per feature, ascending."""
    q = quantile_arrays(reference_long, quantile_probs(buckets))
    return q.select("feature", F.slice("qs", 2, buckets - 1).alias("inner"))


def _tagged(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of both samples in one table, with _e for those of the reference."""
    return reference.withColumn("_e", F.lit(True)).unionByName(current.withColumn("_e", F.lit(False)))


def psi_by_feature(reference: DataFrame, current: DataFrame, features: list[str] | None = None,
                   buckets: int = BUCKETS) -> DataFrame:
    """(feature, psi) for the features present in both inputs.

    Both samples are read once, into counts of distinct values; one prefix scan
    over these gives the reference's quantiles, and the stored counts the bins.
    """
    feats = [f for f in (features or MONITORED) if f in reference.columns and f in current.columns]
    both = _tagged(reference.select(*[F.col(f).cast("double").alias(f) for f in feats]), current.select(*[F.col(f).cast("double").alias(f) for f in feats]))
    long = both.unpivot(["_e"], feats, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy("feature", "value").agg(F.count_if("_e").alias("c"), F.count_if(~F.col("_e")).alias("a"))
    dv = prefix_scan(counts, ["feature"], [F.col("value")], sums={"cum": F.col("c")}, position=None)
    edges = _quantiles(dv, quantile_probs(buckets)).select("feature", F.slice("qs", 2, buckets - 1).alias("inner"))   # one row per feature
    binned = dv.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    cnt = binned.groupBy("feature", "bin").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))
    # at most `buckets` counts per feature: finish the formula in one grouped pass
    per = cnt.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("c", "a")))).alias("m"),
                                     F.sum("c").alias("ne"), F.sum("a").alias("na"))
    return per.select("feature", _psi(lambda b: F.element_at("m", b)["c"], lambda b: F.element_at("m", b)["a"], buckets).alias("psi"))


def _psi(expected, actual, buckets: int) -> Column:
    """PSI over the counts of ``buckets`` bins, of ne and na rows in all; an empty bin counts as EMPTY_SHARE."""
    def share(c, n):
        c = F.coalesce(c, F.lit(0))
        return F.when(c == 0, F.lit(EMPTY_SHARE)).otherwise(c / n)

    def term(b):
        e, a = share(expected(b), F.col("ne")), share(actual(b), F.col("na"))
        return (a - e) * F.log(a / e)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), term), F.lit(0.0), lambda acc, x: acc + x)


def sketch_psi(reference: DataFrame, current: DataFrame, features: list[str] | None = None, buckets: int = BUCKETS, k: int = 800) -> DataFrame:
    """A8/A9 in a single aggregate: (feature, psi) from mergeable quantile sketches of both samples.

    For columns of so many distinct values that their counts are as large as
    the data; a sketch's size depends on k only, its rank error at k = 800 is
    about half a percent.
    """
    feats = [f for f in (features or MONITORED) if f in reference.columns and f in current.columns]
    both = _tagged(reference.select(*feats), current.select(*feats))

    def sketch(f: str, e: Column) -> Column:
        v = F.col(f).cast("double")
        return F.kll_sketch_agg_double(F.when(e & ~F.isnan(v), v), F.lit(k))
    e = F.col("_e")
    one = both.agg(*[x for f in feats for x in (sketch(f, e).alias(f"e_{f}"), sketch(f, ~e).alias(f"a_{f}"))])
    one = store(one, "sketches")   # one row
    inner = one.select(*[F.array(*[F.kll_sketch_get_quantile_double(f"e_{f}", F.lit(q)) for q in quantile_probs(buckets)[1:-1]]).alias(f) for f in feats]).first()

    def counts(f: str, side: str) -> Column:
        """Rows of a sketch in each bin; a bin begins with its edge, which the rank exclusive of it leaves to the next."""
        at = [F.lit(0.0), *[F.kll_sketch_get_rank_double(f"{side}_{f}", F.lit(float(np.nextafter(x, -np.inf)))) for x in inner[f]], F.lit(1.0)]
        return F.array(*[(y - x) * F.kll_sketch_get_n_double(f"{side}_{f}") for x, y in zip(at, at[1:])])
    rows = [F.struct(F.lit(f).alias("feature"), counts(f, "e").alias("ec"), counts(f, "a").alias("ac"), F.kll_sketch_get_n_double(f"e_{f}").alias("ne"),
                     F.kll_sketch_get_n_double(f"a_{f}").alias("na")) for f in feats if inner[f] is not None and None not in inner[f]]
    d = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return d.select("feature", _psi(lambda b: F.get("ec", b), lambda b: F.get("ac", b), buckets).alias("psi"))


def drift_check(reference: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, kind, psi, color, status) of every column that both samples have.

    Numeric columns by quantile bins of the reference (booleans and all others
    by their values, null as a value of its own); P12 leaves out the rest.
    """
    shared = [c for c in (columns or reference.columns) if c in reference.columns and c in current.columns]
    numeric = [c for c in shared if isinstance(reference.schema[c].dataType, T.NumericType) and isinstance(current.schema[c].dataType, T.NumericType)]
    parts = []
    if numeric:
        parts.append(psi_by_feature(reference, current, numeric).withColumn("kind", F.lit("numeric")))
    if other := [c for c in shared if c not in numeric]:
        parts.append(category_psi(reference, current, other).withColumn("kind", F.lit("categorical")))
    if not parts:
        raise ValueError("the samples share no column")
    d = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    r = F.round("psi", 6)
    return d.select("feature", "kind", r.alias("psi"), *psi_status(r))


def drift_status(psi: DataFrame) -> DataFrame:
    """Per-feature PSI rounded to 6, with colour and label."""
    r = F.round("psi", 6)
    return psi.select("feature", r.alias("psi"), *psi_status(r))


def drift_decision(psi: DataFrame, threshold: float = PSI_THRESHOLD) -> DataFrame:
    """A10: max PSI (0.0 if none), retrain flag, reason, and the PSI map."""
    r = F.round("psi", 6)
    d = psi.agg(F.coalesce(F.max(r), F.lit(0.0)).alias("max_psi"),
                F.map_from_entries(F.collect_list(F.struct("feature", r))).alias("psi_scores"))
    return d.select("max_psi", (F.col("max_psi") >= threshold).alias("retrain"),
                    F.when(F.col("max_psi") >= threshold, F.lit("PSI threshold breached"))
                     .otherwise(F.lit("All PSI scores below threshold")).alias("reason"), "psi_scores")


def quality_profile(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Per column and sample: nulls, min, max, mean, stddev; current rows outside reference range.

    Both samples are read once; the narrow long form is stored for the second look, at the ranges.
    """
    both = _tagged(*(df.select(*[F.col(c).cast("double").alias(c) for c in columns]) for df in (reference, current)))
    lf = store(both.unpivot(["_e"], columns, "column", "v"), "profile")
    prof = lf.groupBy("column", "_e").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("stddev"), F.approx_count_distinct("v").alias("approx_distinct"))
    rng = prof.filter("_e").select("column", F.col("min").alias("_lo"), F.col("max").alias("_hi"))   # one row per column
    oor = lf.filter(~F.col("_e")).join(F.broadcast(rng), "column").groupBy("column").agg(
        F.count_if((F.col("v") < F.col("_lo")) | (F.col("v") > F.col("_hi"))).alias("out_of_range"))
    return prof.join(oor, "column", "left").withColumns({
        "out_of_range": F.when(F.col("_e"), F.lit(0)).otherwise(F.col("out_of_range")),
        "sample": F.when(F.col("_e"), "reference").otherwise("current")}).drop("_e")


def target_drift(reference: DataFrame, current: DataFrame, label: str = "isFraud") -> DataFrame:
    """Label rate of both samples, their difference, and PSI over the two classes."""
    def rate(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.avg(F.col(label).cast("double")).alias(f"rate_{tag}"))
    d = rate(reference, "reference").crossJoin(rate(current, "current"))
    e1, a1 = F.col("rate_reference"), F.col("rate_current")

    def fix(x: Column) -> Column:
        return F.when(x == 0, F.lit(EMPTY_SHARE)).otherwise(x)
    e0, a0 = fix(1 - e1), fix(1 - a1)
    e1f, a1f = fix(e1), fix(a1)
    psi = (a0 - e0) * F.log(a0 / e0) + (a1f - e1f) * F.log(a1f / e1f)
    return d.select("rate_reference", "rate_current", (a1 - e1).alias("rate_change"), psi.alias("target_psi"))


def category_psi(reference: DataFrame, current: DataFrame, columns: str | list[str]) -> DataFrame:
    """A21 (categorical): (feature, psi) over category shares (categories of either sample), all columns in one aggregate."""
    columns = [columns] if isinstance(columns, str) else columns
    both = _tagged(*(df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias(c) for c in columns]) for df in (reference, current)))
    counts = both.unpivot(["_e"], columns, "feature", "cat").groupBy("feature", "cat") \
        .agg(F.count_if("_e").alias("c"), F.count_if(~F.col("_e")).alias("a"))
    total = both.agg(F.count_if("_e").alias("ne"), F.count_if(~F.col("_e")).alias("na"))
    d = counts.crossJoin(F.broadcast(total))

    def share(c: str, n: str) -> Column:
        return F.when(F.col(c) == 0, F.lit(EMPTY_SHARE)).otherwise(F.col(c) / F.col(n))
    e, a = share("c", "ne"), share("a", "na")
    return d.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
