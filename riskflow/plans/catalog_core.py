"""Registered queries: ledger scoring, features, parser, audit reads."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.plans.registry import query
from riskflow.plans.sqlparts import scored_ledger_ctes
from riskflow.sources.views import ML_PROB_SQL, ml_prob_standin, txn_ledger, with_sql
from riskflow.operators.scoring import score_transactions


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def scored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_transactions(txn_ledger(spark, sf_dir))


SCORED_COLS_SQL = """SELECT row_id, nameOrig, nameDest, burst, round(merchant_risk, 6) AS merchant_risk,
       round(behavioral_score, 6) AS behavioral_score, round(final_risk_score, 6) AS final_risk_score,
       risk_level, action, confidence_score, indicators_text, reasons_text, pattern_summary
FROM scored"""


@query("W12_feedback_scoring", sql=with_sql(*scored_ledger_ctes(), body=SCORED_COLS_SQL, recursive=True))
def q_w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored_ledger(spark, sf_dir)
    return d.select("row_id", "nameOrig", "nameDest", "burst", r6("merchant_risk"), r6("behavioral_score"),
                    r6("final_risk_score"), "risk_level", "action", "confidence_score",
                    F.array_join("indicators", "|").alias("indicators_text"),
                    F.array_join("reasons", "|").alias("reasons_text"), "pattern_summary")


# F14/F17/F18/F19 are columns of the same scoring plan
for _name in ["F14_heuristic_score", "F17_indicators", "F18_reasons_summary", "F19_confidence_score"]:
    query(_name, sql=with_sql(*scored_ledger_ctes(), body=SCORED_COLS_SQL, recursive=True))(q_w12)


HYBRID_SQL = with_sql(*scored_ledger_ctes(ml_prob=ML_PROB_SQL), body=SCORED_COLS_SQL.replace(
    "SELECT row_id,", "SELECT row_id, 'Hybrid' AS scoring_mode,"), recursive=True)


@query("F15_hybrid_scoring", sql=HYBRID_SQL)
def q_f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = txn_ledger(spark, sf_dir).withColumn("ml_prob", ml_prob_standin(F.col("row_id")))
    d = score_transactions(led, ml_prob="ml_prob")
    return d.select("row_id", "scoring_mode", "nameOrig", "nameDest", "burst", r6("merchant_risk"),
                    r6("behavioral_score"), r6("final_risk_score"), "risk_level", "action", "confidence_score",
                    F.array_join("indicators", "|").alias("indicators_text"),
                    F.array_join("reasons", "|").alias("reasons_text"), "pattern_summary")
