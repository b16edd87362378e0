"""Model registry as tables.

``runs``: run_id, metric, value.  ``model_versions``: name, version, run_id, stage.
A promotion step is a table transform giving the next ``model_versions``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGE_PRODUCTION, STAGE_STAGING, STAGE_ARCHIVED = "Production", "Staging", "Archived"


def best_run(runs: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Run with the highest value of ``metric`` (run_id breaks ties); one row or none."""
    r = runs.filter(F.col("metric") == metric)
    return r.agg(F.min_by(F.struct("run_id", "value"), F.struct(-F.col("value"), F.col("run_id")))
                 .alias("b")).filter(F.col("b").isNotNull()).select("b.run_id", "b.value")


def production_metric(versions: DataFrame, runs: DataFrame, name: str, metric: str = "pr_auc") -> DataFrame:
    """Current Production version of ``name`` with its run metric (0.0 when absent)."""
    prod = versions.filter((F.col("name") == name) & (F.col("stage") == STAGE_PRODUCTION))
    prod = prod.agg(F.max_by(F.struct("version", "run_id"), F.col("version")).alias("p")).filter(
        F.col("p").isNotNull()).select("p.version", "p.run_id")
    m = runs.filter(F.col("metric") == metric).select("run_id", F.col("value").alias("prod_value"))
    return prod.join(m, "run_id", "left").select("version", "run_id",
                                                 F.coalesce("prod_value", F.lit(0.0)).alias("prod_value"))


def promote(versions: DataFrame, runs: DataFrame, name: str, metric: str = "pr_auc") -> DataFrame:
    """M9: register the best run as a new version; it beats Production -> Production (old -> Archived),
    otherwise Staging; no Production yet -> Production.  Returns the next ``model_versions``."""
    best = best_run(runs, metric).select(F.col("run_id").alias("_brun"), F.col("value").alias("_bval"))
    prod = production_metric(versions, runs, name, metric).select(
        F.col("version").alias("_pver"), F.col("prod_value").alias("_pval"))
    nextv = versions.filter(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0)).alias("_max"))
    ctx = best.crossJoin(nextv).join(prod, F.lit(True), "left")
    has_prod = F.col("_pver").isNotNull()
    wins = ~has_prod | (F.col("_bval") > F.col("_pval"))
    new = ctx.select(F.lit(name).alias("name"), (F.col("_max") + 1).cast("int").alias("version"),
                     F.col("_brun").alias("run_id"),
                     F.when(wins, F.lit(STAGE_PRODUCTION)).otherwise(F.lit(STAGE_STAGING)).alias("stage"))
    decision = ctx.select(F.col("_pver"), wins.alias("_wins"))
    old = versions.join(decision, F.lit(True), "left").select(
        "name", "version", "run_id",
        F.when((F.col("name") == name) & (F.col("version") == F.col("_pver")) & F.col("_wins"),
               F.lit(STAGE_ARCHIVED)).otherwise(F.col("stage")).alias("stage"))
    return old.unionByName(new)
