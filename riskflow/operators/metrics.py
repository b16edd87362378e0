"""Model-evaluation metrics on (label, score) tables.

All curve metrics start from one table with a row per distinct score:
(score, pos, neg), built by partial aggregation.  Cumulative true/false
positives from the top score down are a prefix scan over the scores, so no
single task holds the whole curve.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.operators.ordered import prefix_scan

# Threshold-search targets and fallbacks.
RECALL_RANGE = (0.90, 0.95)
PRECISION_RANGE = (0.70, 0.85)
F1_EPS = 1e-8
DEFAULT_THRESHOLD = 0.5
THRESHOLD_CAP = 0.8


def class_balance(df: DataFrame, y: str = "y") -> DataFrame:
    """Negatives / positives, 1.0 without positives."""
    return df.agg(F.coalesce(F.try_divide(F.count_if(F.col(y) == 0).cast("double"),
                                          F.nullif(F.count_if(F.col(y) == 1), F.lit(0)).cast("double")),
                             F.lit(1.0)).alias("scale_pos_weight"))


def curve(df: DataFrame, y: str = "y", score: str = "prob") -> DataFrame:
    """Per distinct score (descending): pos, neg, cumulative tp/fp, precision, recall, and totals."""
    g = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    c = prefix_scan(g, [], [F.col("score").desc()], sums={"tp": F.col("pos"), "fp": F.col("neg")}, position="rank_desc")
    tot = c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = c.crossJoin(F.broadcast(tot))
    return c.withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0)),
    })


def average_precision(c: DataFrame) -> DataFrame:
    """Sum over distinct scores of (recall step) * precision (step-wise)."""
    return c.agg(F.sum(F.when(F.col("P") > 0, F.col("pos") / F.col("P")).otherwise(F.lit(0.0))
                       * F.col("precision")).alias("pr_auc"))


def roc_auc(c: DataFrame) -> DataFrame:
    """Trapezoid over distinct thresholds (ties count one half)."""
    area = F.col("neg") * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2.0)
    return c.agg(F.sum(area).alias("_a"), F.first("P").alias("_P"), F.first("N").alias("_N")).select(
        F.try_divide(F.col("_a"), F.col("_P") * F.col("_N")).alias("roc_auc"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f1.alias("f1")]


def at_threshold(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, y: str = "y", score: str = "prob") -> DataFrame:
    """Precision, recall, F1 of the positive class at ``score >= threshold``."""
    pred = F.col(score) >= threshold
    pos = F.col(y) == 1
    d = df.agg(F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"),
               F.count_if(~pred & pos).alias("fn"))
    return d.select(F.lit(float(threshold)).alias("threshold"), *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def class_report(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, y: str = "y", score: str = "prob") -> DataFrame:
    """Precision, recall, F1, support for Legit (0) and Fraud (1)."""
    pred = F.col(score) >= threshold
    pos = F.col(y) == 1
    d = df.agg(F.count_if(pred & pos).alias("tp"), F.count_if(pred & ~pos).alias("fp"),
               F.count_if(~pred & pos).alias("fn"), F.count_if(~pred & ~pos).alias("tn"))
    fraud = d.select(F.lit("Fraud").alias("class"), *_prf(F.col("tp"), F.col("fp"), F.col("fn")),
                     (F.col("tp") + F.col("fn")).alias("support"))
    legit = d.select(F.lit("Legit").alias("class"), *_prf(F.col("tn"), F.col("fn"), F.col("fp")),
                     (F.col("tn") + F.col("fp")).alias("support"))
    return legit.unionByName(fraud)


def pr_curve(c: DataFrame) -> DataFrame:
    """(threshold, precision, recall) per distinct score plus the closing point (null, 1, 0)."""
    pts = c.select(F.col("score").alias("threshold"), "precision", "recall")
    close = c.limit(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                              F.lit(0.0).alias("recall"))
    return pts.unionByName(close)


def best_threshold(c: DataFrame) -> DataFrame:
    """Threshold search with recall/precision targets, F1 fallback, 0.5 default, cap 0.8."""
    pts = pr_curve(c)
    rlo, rhi = RECALL_RANGE
    plo, phi = PRECISION_RANGE
    in_r = (F.col("recall") >= rlo) & (F.col("recall") <= rhi)
    in_p = (F.col("precision") >= plo) & (F.col("precision") <= phi)
    f1 = 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F1_EPS)
    # ascending thresholds with the closing point last: ties go to the lowest threshold
    order = F.coalesce(F.col("threshold"), F.lit(float("inf")))
    agg = pts.agg(
        F.max(in_r & in_p).alias("has_pref"), F.max(in_r).alias("has_range"),
        F.max_by(F.struct("threshold", "precision", "recall"),
                 F.when(in_r & in_p, F.struct(F.col("precision"), -order))).alias("pref"),
        F.max_by(F.struct("threshold", "precision", "recall"),
                 F.when(in_r, F.struct(F.col("precision"), -order))).alias("rng"),
        F.max_by(F.struct("threshold", "precision", "recall"), F.struct(f1, -order)).alias("f1"),
    )
    pick = (F.when(F.col("has_pref"), F.col("pref")).when(F.col("has_range"), F.col("rng"))
            .otherwise(F.col("f1")))
    t = F.coalesce(pick["threshold"], F.lit(DEFAULT_THRESHOLD))
    return agg.select(F.least(t, F.lit(THRESHOLD_CAP)).alias("threshold"),
                      pick["precision"].alias("precision"), pick["recall"].alias("recall"),
                      F.when(F.col("has_pref"), "preferred").when(F.col("has_range"), "recall_range")
                       .otherwise("f1_fallback").alias("rule"))


def mean_ignoring_missing(col: str) -> Column:
    """Mean of non-null values, 0.5 when all are missing."""
    return F.coalesce(F.avg(col), F.lit(0.5))
