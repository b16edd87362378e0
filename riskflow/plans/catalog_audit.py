"""Registered queries: audit store writes and reads, velocity tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions import scoring as S
from riskflow.operators import audit as AU
from riskflow.operators import velocity as VE
from riskflow.operators.scoring import score_transactions
from riskflow.plans.registry import query
from riskflow.session import cut_lineage
from riskflow.plans.sqlparts import scored_ledger_ctes
from riskflow.sources.views import EVENT_SQL, step_time, txn_event, txn_ledger, with_sql

BATCH_CUTOFF_STEP = 28000   # records up to here are "already stored"
OVERLAP_STEPS = 24 * 30     # the next batch re-sends 30 days


def records_with_step(spark: SparkSession, sf: str) -> DataFrame:
    """The stored records table: scored ledger, materialised once (read by several branches)."""
    scored = score_transactions(txn_ledger(spark, sf))
    return cut_lineage(AU.to_records(scored, ts=step_time(F.col("step")), txn_id=S.record_id(F.col("row_id")),
                                     record_key=S.record_key(F.col("row_id"))))


RECORDS_SQL = """
records AS (
  SELECT upper(substr(sha256(CAST(row_id AS VARCHAR)), 1, 12)) AS transaction_id,
         TIMESTAMP '1995-01-01 00:00:00' + to_hours(CAST(step AS BIGINT)) AS timestamp,
         step, amount, type, 0e0 AS ml_probability, round(behavioral_score, 4) AS behavioral_score,
         round(final_risk_score, 4) AS final_risk_score, risk_level, action, reasons_text, indicators_text,
         nameOrig, nameDest
  FROM scored
)"""
ALERTS_SQL = """
alerts AS (SELECT transaction_id, timestamp, amount, risk_level, reasons_text FROM records WHERE risk_level = 'High')"""


def audit_sql(body: str, *extra: str) -> str:
    return with_sql(*scored_ledger_ctes(), RECORDS_SQL, ALERTS_SQL, *extra, body=body, recursive=True)


ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ')"


def iso(c: str = "timestamp"):
    return S.iso_utc(F.col(c)).alias(c)


def joined(c: str):
    return F.array_join(F.col(c), "|").alias(f"{c}_text")


@query("S7_append_records", sql=audit_sql(f"""
SELECT transaction_id, {ISO} AS timestamp, risk_level, round(final_risk_score, 6) AS final_risk_score
FROM records WHERE step > {BATCH_CUTOFF_STEP - OVERLAP_STEPS}
  AND transaction_id NOT IN (SELECT transaction_id FROM records WHERE step <= {BATCH_CUTOFF_STEP})"""))
def q_s7(spark, sf):
    rec = records_with_step(spark, sf)
    cut = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    stored = rec.filter(F.col("timestamp") <= F.timestamp_add("HOUR", F.lit(BATCH_CUTOFF_STEP), cut))
    batch = rec.filter(F.col("timestamp") > F.timestamp_add("HOUR", F.lit(BATCH_CUTOFF_STEP - OVERLAP_STEPS), cut))
    out = AU.append_records(batch, stored)
    return out.select("transaction_id", iso(), "risk_level", F.round("final_risk_score", 6).alias("final_risk_score"))


query("J5_duplicate_suppression", sql=audit_sql(f"""
SELECT transaction_id, {ISO} AS timestamp, risk_level, round(final_risk_score, 6) AS final_risk_score
FROM records WHERE step > {BATCH_CUTOFF_STEP - OVERLAP_STEPS}
  AND transaction_id NOT IN (SELECT transaction_id FROM records WHERE step <= {BATCH_CUTOFF_STEP})"""))(q_s7)


@query("S8_alert_rows", sql=audit_sql(f"""
SELECT transaction_id, {ISO} AS timestamp, round(amount, 6) AS amount, risk_level, reasons_text FROM alerts"""))
def q_s8(spark, sf):
    a = AU.alerts_of(records_with_step(spark, sf))
    return a.select("transaction_id", iso(), F.round("amount", 6).alias("amount"), "risk_level", joined("reasons"))


@query("S9_behavioral_logs", sql=audit_sql(f"""
SELECT transaction_id, {ISO} AS timestamp, coalesce(nameOrig, 'UNKNOWN') AS entity,
       coalesce(nameDest, 'UNKNOWN') AS merchant FROM records"""))
def q_s9(spark, sf):
    return AU.behavioral_logs(records_with_step(spark, sf)).select("transaction_id", iso(), "entity", "merchant")


@query("L1_history_newest_first", sql=audit_sql(f"""
SELECT transaction_id, {ISO} AS timestamp, risk_level, final_risk_score AS fraud_probability,
       CAST(trunc(final_risk_score * 100) AS INT) AS confidence_score
FROM records ORDER BY timestamp DESC, transaction_id LIMIT 50"""))
def q_l1(spark, sf):
    h = AU.fetch_history(records_with_step(spark, sf), 50)
    return h.select("transaction_id", iso(), "risk_level", "fraud_probability", "confidence_score")


query("P5_read_side_columns", sql=audit_sql("""
SELECT transaction_id, final_risk_score AS fraud_probability,
       CAST(trunc(final_risk_score * 100) AS INT) AS confidence_score FROM records"""))(
    lambda spark, sf: AU.read_side(records_with_step(spark, sf)).select(
        "transaction_id", "fraud_probability", "confidence_score"))


J1_BODY = f"""
SELECT a.transaction_id, strftime(a.timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, round(a.amount, 6) AS amount,
       a.risk_level, r.final_risk_score AS fraud_probability, r.action, a.reasons_text,
       r.indicators_text, coalesce(r.nameOrig, 'UNKNOWN') AS nameOrig, coalesce(r.nameDest, 'UNKNOWN') AS nameDest
FROM alerts a JOIN records r ON a.transaction_id = r.transaction_id
ORDER BY a.timestamp DESC, a.transaction_id LIMIT 50"""


def _alerts_out(d: DataFrame) -> DataFrame:
    return d.select("transaction_id", iso(), F.round("amount", 6).alias("amount"), "risk_level",
                    "fraud_probability", "action", joined("reasons"), joined("indicators"), "nameOrig", "nameDest")


@query("J1_alerts_join_records", sql=audit_sql(J1_BODY))
def q_j1(spark, sf):
    rec = records_with_step(spark, sf)
    return _alerts_out(AU.fetch_alerts(AU.alerts_of(rec), rec, 50))


@query("L2_alerts_capped", sql=audit_sql(J1_BODY))
def q_l2(spark, sf):
    rec = records_with_step(spark, sf)
    return _alerts_out(AU.fetch_alerts(AU.alerts_of(rec), rec, min(500, AU.ALERT_CAP)))   # the endpoint caps what is asked


@query("J2_alerts_left_lookup", sql=audit_sql(J1_BODY))
def q_j2(spark, sf):
    rec = records_with_step(spark, sf)
    return _alerts_out(AU.fetch_alerts_lookup(AU.alerts_of(rec), rec, 50))


@query("L3_first_three_reasons", sql=audit_sql("""
SELECT transaction_id, array_to_string(list_slice(string_split(reasons_text, '|'), 1, 3), '|') AS reasons3
FROM records"""))
def q_l3(spark, sf):
    rec = records_with_step(spark, sf)
    return rec.select("transaction_id", F.array_join(AU.first_reasons(F.col("reasons")), "|").alias("reasons3"))


@query("P6_history_search", sql=audit_sql("""
SELECT transaction_id, risk_level FROM records
WHERE contains(lower(transaction_id), 'a1') OR contains(lower(risk_level), 'a1')"""))
def q_p6(spark, sf):
    return AU.search_history(records_with_step(spark, sf), "A1").select("transaction_id", "risk_level")


@query("P7_time_of_day", sql=audit_sql("""
SELECT transaction_id, strftime(timestamp, '%H:%M:%S') AS time_of_day FROM records"""))
def q_p7(spark, sf):
    rec = records_with_step(spark, sf)
    return rec.select("transaction_id", AU.time_of_day(F.col("timestamp")).alias("time_of_day"))


@query("P8_rounded_percent", sql=audit_sql("""
SELECT transaction_id, CAST(floor(final_risk_score * 100 + 0.5e0) AS INT) AS percent FROM records"""))
def q_p8(spark, sf):
    rec = records_with_step(spark, sf)
    return rec.select("transaction_id", S.percent_rounded(F.col("final_risk_score")).alias("percent"))


@query("A6_system_summary", sql=audit_sql("""
SELECT count(*) AS total_predictions, count(*) FILTER (WHERE risk_level = 'High') AS total_alerts_true,
       least(count(*) FILTER (WHERE risk_level = 'High'), 100) AS total_alerts FROM records"""))
def q_a6(spark, sf):
    return AU.system_summary(records_with_step(spark, sf))


@query("F22_reply_text", sql=audit_sql("""
SELECT transaction_id,
  CASE WHEN risk_level = 'High' THEN 'This transaction shows high-risk indicators and has been flagged for manual review. Risk score: '
            || CAST(CAST(trunc(final_risk_score * 100) AS INT) AS VARCHAR) || '%. Action: ' || action || '.'
       WHEN risk_level = 'Medium' THEN 'Unusual activity detected. Secondary verification is recommended. Action: ' || action || '.'
       ELSE 'Transaction verified against baseline patterns. No immediate risk identified.' END AS reply
FROM records"""))
def q_f22(spark, sf):
    rec = records_with_step(spark, sf)
    return rec.select("transaction_id", S.reply_text(F.col("risk_level"), F.col("final_risk_score"),
                                                     F.col("action")).alias("reply"))


@query("F24_record_id", sql=audit_sql("SELECT transaction_id, risk_level FROM records"))
def q_f24(spark, sf):
    return records_with_step(spark, sf).select("transaction_id", "risk_level")


@query("F16_level_action", sql=audit_sql("""
SELECT transaction_id, risk_level, action, round(behavioral_score, 6) AS behavioral_score FROM records"""))
def q_f16(spark, sf):
    return records_with_step(spark, sf).select("transaction_id", "risk_level", "action",
                                               F.round("behavioral_score", 6).alias("behavioral_score"))


# ------------------------------------------------------------ velocity A1-A3
def _vel_sql(width: str, suffix: str, extra: str) -> str:
    return with_sql(EVENT_SQL, body=f"""
SELECT card_id, strftime(time_bucket(INTERVAL '{width}', event_time) + INTERVAL '{width}', '%Y-%m-%dT%H:%M:%SZ')
         AS window_end_{suffix},
       count(txn_id) AS txn_count_{suffix}, round(sum(amount), 6) AS amount_sum_{suffix}{extra}
FROM txn_event GROUP BY card_id, time_bucket(INTERVAL '{width}', event_time)""")


def _vel(suffix: str):
    def fn(spark, sf):
        v = VE.velocity(txn_event(spark, sf), suffix)
        cols = [c for c in v.columns if c not in ("card_id", f"window_end_{suffix}")]
        return v.select("card_id", iso(f"window_end_{suffix}"),
                        *[F.round(c, 6).alias(c) if c.startswith("amount") else F.col(c) for c in cols])
    return fn


query("A1_velocity_1m", sql=_vel_sql("1 minute", "1m", ""))(_vel("1m"))
query("A2_velocity_5m", sql=_vel_sql("5 minutes", "5m", ", count(DISTINCT merchant_id) AS unique_merchants_5m"))(
    _vel("5m"))
query("A3_velocity_1h", sql=_vel_sql("1 hour", "1h", ", round(max(amount), 6) AS amount_max_1h, "
                                     "count(DISTINCT merchant_id) AS unique_merchants_1h"))(_vel("1h"))


@query("F20_round4_scores", sql=audit_sql("""
SELECT transaction_id, behavioral_score, final_risk_score, ml_probability FROM records"""))
def q_f20(spark, sf):
    return records_with_step(spark, sf).select("transaction_id", "behavioral_score", "final_risk_score",
                                               "ml_probability")


@query("F27_json_metadata", sql=audit_sql("""
SELECT transaction_id, coalesce(nameOrig, 'UNKNOWN') AS nameOrig, coalesce(nameDest, 'UNKNOWN') AS nameDest,
       type, reasons_text FROM records"""))
def q_f27(spark, sf):
    rec = records_with_step(spark, sf)
    js = F.to_json("reasons")                                   # stored as JSON text
    back = F.from_json(js, "array<string>")                     # decoded on read
    return rec.select("transaction_id",
                      F.coalesce(F.get_json_object("metadata", "$.nameOrig"), F.lit("UNKNOWN")).alias("nameOrig"),
                      F.coalesce(F.get_json_object("metadata", "$.nameDest"), F.lit("UNKNOWN")).alias("nameDest"),
                      F.get_json_object("metadata", "$.type").alias("type"),
                      F.array_join(back, "|").alias("reasons_text"))
