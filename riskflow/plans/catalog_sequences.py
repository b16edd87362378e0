"""Registered queries: point-in-time lookup and history sequences."""
from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions.scoring import iso_utc
from riskflow.operators import pit as PIT
from riskflow.operators import sequences as SQ
from riskflow.operators import velocity as VE
from riskflow.plans.registry import query
from riskflow.sources.views import EVENT_SQL, LEDGER_SQL, txn_event, txn_ledger, with_sql

SEQ_FEATURES = ["amount", "oldbalanceOrg"]
SPLIT_STEP = 28000


@query("J4_point_in_time_lookup", sql=with_sql(EVENT_SQL, """
feats AS (
  SELECT card_id, time_bucket(INTERVAL '1 hour', event_time) + INTERVAL '1 hour' AS feature_ts,
         count(txn_id) AS txn_count_1h, sum(amount) AS amount_sum_1h
  FROM txn_event GROUP BY card_id, time_bucket(INTERVAL '1 hour', event_time)
)""", body="""
SELECT e.txn_id, e.card_id,
       CASE WHEN f.feature_ts >= e.event_time - INTERVAL 30 DAY THEN strftime(f.feature_ts, '%Y-%m-%dT%H:%M:%SZ') END AS feature_ts,
       CASE WHEN f.feature_ts >= e.event_time - INTERVAL 30 DAY THEN f.txn_count_1h END AS txn_count_1h,
       CASE WHEN f.feature_ts >= e.event_time - INTERVAL 30 DAY THEN round(f.amount_sum_1h, 6) END AS amount_sum_1h
FROM txn_event e ASOF LEFT JOIN feats f ON e.card_id = f.card_id AND e.event_time >= f.feature_ts"""))
def q_j4(spark, sf):
    ev = txn_event(spark, sf)
    feats = VE.velocity(ev, "1h").select("card_id", F.col("window_end_1h").alias("feature_ts"),
                                         "txn_count_1h", "amount_sum_1h")
    j = PIT.asof_join(ev.select("txn_id", "card_id", "event_time"), feats, "card_id", "event_time", "feature_ts",
                      ["txn_count_1h", "amount_sum_1h"])
    return j.select("txn_id", "card_id", iso_utc(F.col("feature_ts")).alias("feature_ts"), "txn_count_1h",
                    F.round("amount_sum_1h", 6).alias("amount_sum_1h"))


SEQ_SQL = with_sql(LEDGER_SQL, """
el AS (SELECT * FROM txn_ledger WHERE nameDest IN (SELECT nameDest FROM txn_ledger GROUP BY nameDest HAVING count(*) >= 3))""",
                   """
w AS (
  SELECT row_id, nameDest, step, isFraud,
         coalesce(list(amount) OVER h, []) AS la, coalesce(list(oldbalanceOrg) OVER h, []) AS lb
  FROM el
  WINDOW h AS (PARTITION BY nameDest ORDER BY step, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)
)""", body="""
SELECT row_id, nameDest, step, isFraud, CAST(len(la) AS INT) AS seq_len,
       repeat('0', 10 - len(la)) || repeat('1', len(la)) AS mask_text,
       round(coalesce(list_sum(la), 0) + coalesce(list_sum(lb), 0), 4) AS seq_sum,
       round(coalesce(list_sum(list_transform(la, lambda x, i: x * (10 - len(la) + i))), 0), 4) AS seq_wsum
FROM w""")


def _seqs(spark, sf):
    s = SQ.build_sequences(txn_ledger(spark, sf), SEQ_FEATURES)
    flat = F.flatten("seq")
    wsum = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0),
                       lambda acc, i: acc + F.element_at("seq", i)[0] * i)
    return s.select("row_id", "nameDest", "step", "isFraud", "seq_len",
                    F.array_join(F.transform("mask", lambda m: m.cast("int").cast("string")), "").alias("mask_text"),
                    F.round(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), 4).alias("seq_sum"),
                    F.round(wsum, 4).alias("seq_wsum"))


query("W9_history_sequences", sql=SEQ_SQL)(_seqs)
query("L4_key_step_ordering", sql=SEQ_SQL)(_seqs)


@query("A23_sequence_split_summary", sql=with_sql(LEDGER_SQL, f"""
el AS (SELECT * FROM txn_ledger WHERE nameDest IN (SELECT nameDest FROM txn_ledger GROUP BY nameDest HAVING count(*) >= 3))""",
                                                  body=f"""
SELECT CASE WHEN step <= {SPLIT_STEP} THEN 'train' ELSE 'test' END AS split, count(*) AS sequences,
       round(avg(isFraud), 6) AS fraud_rate
FROM el GROUP BY 1"""))
def q_a23(spark, sf):
    s = SQ.split_summary(txn_ledger(spark, sf), SPLIT_STEP)
    return s.select("split", "sequences", F.round("fraud_rate", 6).alias("fraud_rate"))
