"""Audit store: records, alerts, behavioural logs and their reads.

S7-S9 (append with first-write-wins), J1/J2 (alert lookups), J5, L1-L3,
P5-P8 (read-side columns), A6 (summary), F27 (JSON at the edges).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions import scoring as S

RAW_FIELDS = ["step", "amount", "type", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
              "nameOrig", "nameDest"]
ALERT_CAP = 50
HEALTH_ALERT_LIMIT = 100
#: full-width key of a record; the 12-character transaction_id is what readers see
KEY = "record_key"


def store_key(*tables: DataFrame) -> str:
    """KEY where every table has it, else transaction_id."""
    return KEY if all(KEY in t.columns for t in tables) else "transaction_id"


def to_records(scored: DataFrame, ts: Column, txn_id: Column, source: Column | str = "API_DIRECT",
               ml_prob: str | None = None, record_key: Column | None = None) -> DataFrame:
    """Scored transactions -> stored record rows (one per transaction).

    Without record_key the store tells records apart by transaction_id, which
    then must be unique.
    """
    src = F.lit(source) if isinstance(source, str) else source
    raw = [c for c in RAW_FIELDS if c in scored.columns]
    if "behavioral_intents" in scored.columns:
        raw.append("behavioral_intents")
    mlp = F.col(ml_prob) if ml_prob else F.lit(0.0)
    key = [] if record_key is None else [record_key.alias(KEY)]
    return scored.select(
        *key, txn_id.alias("transaction_id"), ts.alias("timestamp"), src.alias("input_text"),
        F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"),
        F.coalesce(F.col("type"), F.lit("UNKNOWN")).alias("type"),
        S.round4(mlp).alias("ml_probability"),
        S.round4(F.col("behavioral_score")).alias("behavioral_score"),
        S.round4(F.col("final_risk_score")).alias("final_risk_score"),
        "scoring_mode", "risk_level", "action", "reasons", "indicators", "pattern_summary",
        F.to_json(F.struct(*[F.col(c) for c in raw])).alias("metadata"))


def first_write_wins(batch: DataFrame, key: str | None = None, order: str = "timestamp") -> DataFrame:
    """One row per key, the earliest in ``order`` (partial aggregation, no window)."""
    key = key or store_key(batch)
    cols = batch.columns
    rest = [c for c in cols if c not in (key, order)]
    # the struct leads with the order column, so min() is the earliest row; the
    # remaining fields only make ties deterministic
    best = batch.groupBy(key).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in [order] + rest]).select(*cols)


def append_records(batch: DataFrame, existing: DataFrame | None, key: str | None = None) -> DataFrame:
    """Rows of ``batch`` that the store accepts: deduplicated, and not already stored."""
    key = key or store_key(batch)
    new = first_write_wins(batch, key)
    if existing is not None:
        new = new.join(existing.select(key), key, "left_anti")
    return new


def alerts_of(records: DataFrame) -> DataFrame:
    """Alert rows for High records (5 columns, and the store's key where records have one)."""
    return records.filter(F.col("risk_level") == S.LEVEL_HIGH).select(
        *[c for c in (KEY,) if c in records.columns], "transaction_id", "timestamp", "amount", "risk_level", "reasons")


def behavioral_logs(records: DataFrame) -> DataFrame:
    """Who paid whom, with UNKNOWN defaults, from the record metadata."""
    return records.select(
        "transaction_id", "timestamp",
        F.coalesce(F.get_json_object("metadata", "$.nameOrig"), F.lit("UNKNOWN")).alias("entity"),
        F.coalesce(F.get_json_object("metadata", "$.nameDest"), F.lit("UNKNOWN")).alias("merchant"))


def read_side(records: DataFrame) -> DataFrame:
    """P5: fraud_probability and truncated confidence_score from the stored score."""
    return records.withColumns({
        "fraud_probability": F.col("final_risk_score"),
        "confidence_score": S.confidence_score(F.col("final_risk_score")),
    })


def _check_limit(n: int) -> int:
    if n < 0:
        raise ValueError("limit must be >= 0")
    return n


def fetch_history(records: DataFrame, limit: int = 50) -> DataFrame:
    """L1: newest first (transaction_id breaks ties), top ``limit`` (TakeOrderedAndProject)."""
    return read_side(records).orderBy(F.col("timestamp").desc(), F.col("transaction_id")).limit(_check_limit(limit))


def _parties(meta: Column) -> list[Column]:
    return [F.coalesce(F.get_json_object(meta, "$.nameOrig"), F.lit("UNKNOWN")).alias("nameOrig"),
            F.coalesce(F.get_json_object(meta, "$.nameDest"), F.lit("UNKNOWN")).alias("nameDest")]


def fetch_alerts(alerts: DataFrame, records: DataFrame, limit: int = 50) -> DataFrame:
    """Alerts joined (inner) with their records, newest first; the limit is taken as given."""
    n = _check_limit(limit)
    key = store_key(alerts, records)
    r = records.select(key, F.col("final_risk_score").alias("fraud_probability"),
                       "action", "indicators", F.col("metadata").alias("_meta"))
    j = alerts.join(r, key, "inner")
    return (j.select("transaction_id", "timestamp", "amount", "risk_level", "fraud_probability", "action",
                     "reasons", "indicators", *_parties(F.col("_meta")))
            .orderBy(F.col("timestamp").desc(), F.col("transaction_id")).limit(n))


def fetch_alerts_lookup(alerts: DataFrame, records: DataFrame, limit: int = 50) -> DataFrame:
    """Newest alerts first, then a left lookup of their records with fallbacks."""
    n = _check_limit(limit)
    top = alerts.orderBy(F.col("timestamp").desc(), F.col("transaction_id")).limit(n)
    key = store_key(alerts, records)
    r = records.select(key, F.col("final_risk_score").alias("_p"), F.col("action").alias("_a"),
                       F.col("indicators").alias("_i"), F.col("metadata").alias("_meta"), F.lit(True).alias("_hit"))
    j = top.join(r, key, "left")
    found = F.col("_hit").isNotNull()
    return j.select(
        "transaction_id", "timestamp", "amount", "risk_level", "reasons",
        F.when(found, F.col("_p")).otherwise(F.lit(0.0)).alias("fraud_probability"),
        F.when(found, F.coalesce(F.col("_a"), F.lit("UNKNOWN"))).otherwise(F.lit("UNKNOWN")).alias("action"),
        F.when(found, F.coalesce(F.col("_i"), F.array().cast("array<string>")))
         .otherwise(F.array().cast("array<string>")).alias("indicators"),
        *_parties(F.col("_meta")))


def first_reasons(reasons: Column, n: int = 3) -> Column:
    """L3: first ``n`` reasons."""
    return F.slice(reasons, 1, n)


def search_history(records: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring on id or level; empty text keeps everything."""
    q = (text or "").lower()
    if not q:
        return records
    return records.filter(F.lower("transaction_id").contains(q) | F.lower("risk_level").contains(q))


def time_of_day(ts: Column) -> Column:
    """HH:mm:ss of the stored time."""
    return F.date_format(ts, "HH:mm:ss")


def system_summary(records: DataFrame) -> DataFrame:
    """Scored total, alert total, and the alert figure as the health endpoint reports it."""
    return records.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(F.col("risk_level") == S.LEVEL_HIGH).alias("total_alerts_true"),
    ).withColumn("total_alerts", F.least(F.col("total_alerts_true"), F.lit(HEALTH_ALERT_LIMIT)).cast("long"))
