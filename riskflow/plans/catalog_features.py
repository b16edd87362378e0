"""Registered queries: behavioural features, row features, parser, projections."""
from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions import parse as P
from riskflow.functions import rowfeatures as RF
from riskflow.functions.scoring import iso_utc
from riskflow.operators import features as FE
from riskflow.operators import validate as V
from riskflow.plans.registry import query
from riskflow.sources.views import (EVENT_SQL, FAULTY_SQL, LEDGER_SQL, MESSAGES_SQL, ML_PROB_SQL, faulty_events, messages,
                                    ml_prob_standin, txn_event, txn_ledger, with_sql)

TRAIN_CUTOFF_STEP = 28000


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ------------------------------------------------------------ user windows
USER_SQL = with_sql(LEDGER_SQL, """
pf AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY nameOrig, nameDest ORDER BY step, row_id) = 1
                 THEN 1 ELSE 0 END AS first_pair
  FROM txn_ledger
)""", body="""
SELECT row_id, nameOrig,
       CAST(row_number() OVER u AS BIGINT) AS txn_count,
       round(sum(amount) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS amt_sum,
       CAST(coalesce(step - lag(step, 1) OVER u, 0) AS INT) AS time_gap,
       CAST(2 + CASE WHEN coalesce(step - lag(step, 2) OVER u, 999) <= 3 THEN 1 ELSE 0 END AS INT) AS burst_count,
       CAST(sum(first_pair) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS unique_merchants,
       round(amount / (oldbalanceOrg + 1), 6) AS velocity
FROM pf
WINDOW u AS (PARTITION BY nameOrig ORDER BY step, row_id)""")


def _user(spark, sf):
    return FE.user_features(txn_ledger(spark, sf)).select(
        "row_id", "nameOrig", "txn_count", r6("amt_sum"), "time_gap", "burst_count", "unique_merchants",
        r6("velocity"))


for _name in ["W1_txn_count", "W2_amt_sum", "W3_time_gap", "W4_burst_count", "W5_unique_merchants",
              "F12_velocity"]:
    query(_name, sql=USER_SQL)(_user)


# ------------------------------------------------------------ merchant windows
def _merchant_sql(order: str) -> str:
    return with_sql(LEDGER_SQL, body=f"""
SELECT row_id, nameDest,
       CAST(row_number() OVER m AS BIGINT) AS merchant_frequency,
       round((coalesce(sum(isFraud) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 10e0 * g)
             / ((row_number() OVER m - 1) + 10e0), 6) AS merchant_risk
FROM txn_ledger, (SELECT avg(isFraud) AS g FROM txn_ledger) gm
WINDOW m AS (PARTITION BY nameDest ORDER BY {order})""")


def _merchant(order: str):
    def fn(spark, sf):
        return FE.merchant_features(txn_ledger(spark, sf), order=order).select(
            "row_id", "nameDest", "merchant_frequency", r6("merchant_risk"))
    return fn


query("W6_merchant_frequency", sql=_merchant_sql("nameOrig, step, row_id"))(_merchant("parity"))
query("W7_merchant_risk_smoothed", sql=_merchant_sql("nameOrig, step, row_id"))(_merchant("parity"))
query("W7_merchant_risk_event_order", sql=_merchant_sql("step, row_id"))(_merchant("event"))


# ------------------------------------------------------------ W8 / J3 / A4 / A5
W8_SQL = with_sql(LEDGER_SQL, f"""
train AS (SELECT * FROM txn_ledger WHERE step <= {TRAIN_CUTOFF_STEP})""", """
stats AS (SELECT nameDest, sum(isFraud) AS s, count(*) AS c FROM train GROUP BY nameDest)""", body="""
SELECT t.row_id, t.nameDest,
       round((coalesce(s.s, 0) + 10e0 * g.g) / (coalesce(s.c, 0) + 10e0), 6) AS merchant_risk
FROM txn_ledger t LEFT JOIN stats s ON t.nameDest = s.nameDest, (SELECT avg(isFraud) AS g FROM train) g
WHERE t.step > """ + str(TRAIN_CUTOFF_STEP))


@query("W8_merchant_risk_from_train", sql=W8_SQL)
def q_w8(spark, sf):
    led = txn_ledger(spark, sf)
    train, test = V.time_split(led, TRAIN_CUTOFF_STEP)
    return FE.merchant_risk_from_train(test, train).select("row_id", "nameDest", r6("merchant_risk"))


query("J3_merchant_stats_left_join", sql=W8_SQL)(q_w8)


@query("A4_merchant_fraud_stats", sql=with_sql(LEDGER_SQL, body="""
SELECT nameDest, CAST(sum(isFraud) AS BIGINT) AS fraud_sum, count(*) AS txn_cnt FROM txn_ledger GROUP BY nameDest"""))
def q_a4(spark, sf):
    return FE.merchant_stats(txn_ledger(spark, sf))


@query("A5_global_fraud_rate", sql=with_sql(LEDGER_SQL, body="""
SELECT round(avg(isFraud), 6) AS global_rate FROM txn_ledger"""))
def q_a5(spark, sf):
    return FE.global_fraud_rate(txn_ledger(spark, sf)).select(r6("global_rate"))


# ------------------------------------------------------------ W10 / W11 online
ONLINE_SQL = with_sql(LEDGER_SQL, body=f"""
SELECT row_id, nameOrig,
       CAST(least(row_number() OVER u - 1, 100) AS INT) AS burst,
       round(coalesce(avg({ML_PROB_SQL}) OVER (u ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 0e0), 6)
         AS historical_risk_score
FROM txn_ledger
WINDOW u AS (PARTITION BY nameOrig ORDER BY step, row_id)""")


def _online(spark, sf):
    led = txn_ledger(spark, sf).withColumn("ml_prob", ml_prob_standin(F.col("row_id")))
    return FE.online_user_features(led, prob=F.col("ml_prob")).select(
        "row_id", "nameOrig", "burst", r6("historical_risk_score"))


query("W10_burst_online", sql=ONLINE_SQL)(_online)
query("W11_historical_risk_score", sql=ONLINE_SQL)(_online)


# ------------------------------------------------------------ W14 rolling hour
@query("W14_rolling_hour_velocity", sql=with_sql(EVENT_SQL, body="""
SELECT txn_id, card_id,
       count(*) OVER w AS txn_count_1h,
       round(avg(amount) OVER w, 6) AS amount_mean_1h
FROM txn_event
WINDOW w AS (PARTITION BY card_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"""))
def q_w14(spark, sf):
    return FE.rolling_hour(txn_event(spark, sf)).select("txn_id", "card_id", "txn_count_1h", r6("amount_mean_1h"))


# ------------------------------------------------------------ row features
@query("F10_one_hot_type", sql=with_sql(LEDGER_SQL, body="""
SELECT row_id, coalesce(type = 'CASH_IN', false) AS type_CASH_IN, coalesce(type = 'CASH_OUT', false) AS type_CASH_OUT,
       coalesce(type = 'DEBIT', false) AS type_DEBIT, coalesce(type = 'PAYMENT', false) AS type_PAYMENT,
       coalesce(type = 'TRANSFER', false) AS type_TRANSFER
FROM txn_ledger"""))
def q_f10(spark, sf):
    return FE.encode_type(txn_ledger(spark, sf)).select(
        "row_id", "type_CASH_IN", "type_CASH_OUT", "type_DEBIT", "type_PAYMENT", "type_TRANSFER")


@query("F11_online_type_flags", sql=with_sql(LEDGER_SQL, body="""
SELECT row_id, CAST(type = 'TRANSFER' AS INT) AS type_TRANSFER, CAST(type = 'CASH_OUT' AS INT) AS type_CASH_OUT
FROM txn_ledger"""))
def q_f11(spark, sf):
    return txn_ledger(spark, sf).select("row_id", *RF.online_type_flags(F.col("type")))


@query("F13_is_night", sql=with_sql(EVENT_SQL, body="""
SELECT txn_id, CAST(hour(event_time) BETWEEN 0 AND 5 AS INT) AS is_night FROM txn_event"""))
def q_f13(spark, sf):
    return txn_event(spark, sf).select("txn_id", RF.is_night(F.col("event_time")).alias("is_night"))


@query("F26_epoch_ms_to_iso", sql=with_sql(EVENT_SQL, body="""
SELECT txn_id, timestamp AS epoch_ms, strftime(epoch_ms(timestamp), '%Y-%m-%dT%H:%M:%SZ') AS iso_time FROM txn_event"""))
def q_f26(spark, sf):
    e = txn_event(spark, sf)
    return e.select("txn_id", F.col("timestamp").alias("epoch_ms"),
                    iso_utc(RF.epoch_ms_to_ts(F.col("timestamp"))).alias("iso_time"))


query("F25_iso_utc_text", sql=with_sql(EVENT_SQL, body="""
SELECT txn_id, timestamp AS epoch_ms, strftime(epoch_ms(timestamp), '%Y-%m-%dT%H:%M:%SZ') AS iso_time FROM txn_event"""))(q_f26)


@query("F29_model_extra_features", sql=with_sql(LEDGER_SQL, body="""
SELECT row_id,
       CAST(CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3
                      WHEN 'TRANSFER' THEN 4 ELSE -1 END AS INT) AS type_encoded,
       CAST(step % 24 AS INT) AS hour_of_day,
       round(oldbalanceOrg - newbalanceOrig, 6) AS balance_diff_orig,
       round(newbalanceDest - oldbalanceDest, 6) AS balance_diff_dest,
       CAST(abs((oldbalanceOrg - newbalanceOrig) - amount) > 0.01e0 AS INT) AS balance_mismatch
FROM txn_ledger"""))
def q_f29(spark, sf):
    led = txn_ledger(spark, sf)
    c = F.col
    d = led.select("row_id", *RF.model_extras(c("step"), c("type"), c("amount"), c("oldbalanceOrg"),
                                                c("newbalanceOrig"), c("oldbalanceDest"), c("newbalanceDest")))
    return d.select("row_id", "type_encoded", "hour_of_day", r6("balance_diff_orig"), r6("balance_diff_dest"),
                    "balance_mismatch")


# ------------------------------------------------------------ parser F1-F9
def _sql_num(expr: str) -> str:
    return f"TRY_CAST(replace({expr}, ',', '') AS DOUBLE)"


def parser_columns() -> dict[str, str]:
    """SQL of the parsed columns over the lower-cased message t."""
    amt = (f"coalesce({_sql_num(f'regexp_extract(t, {chr(39)}{P.AMOUNT_RE}{chr(39)}, 1)')} * "
           f"CASE regexp_extract(t, '{P.AMOUNT_RE}', 2) WHEN 'k' THEN 1e3 WHEN 'lakh' THEN 1e5 "
           f"WHEN 'million' THEN 1e6 ELSE 1e0 END, 0e0)")
    bal = f"coalesce({_sql_num(f'regexp_extract(t, {chr(39)}{P.BALANCE_RE}{chr(39)}, 1)')}, 0e0)"
    ids = f"regexp_extract_all(t, '{P.ACCOUNT_ID_RE}', 1)"
    sender = f"upper(coalesce(nullif(regexp_extract(t, '{P.SENDER_RE}', 1), ''), {ids}[1], 'C_UNKNOWN'))"
    receiver = f"upper(coalesce(nullif(regexp_extract(t, '{P.RECEIVER_RE}', 1), ''), {ids}[2], 'M_UNKNOWN'))"
    ttype = ("CASE WHEN contains(t, 'payment') OR contains(t, 'paid') THEN 'PAYMENT' "
             "WHEN contains(t, 'cash out') OR contains(t, 'withdraw') THEN 'CASH_OUT' "
             "WHEN contains(t, 'cash in') OR contains(t, 'deposit') THEN 'CASH_IN' "
             "WHEN contains(t, 'debit') THEN 'DEBIT' ELSE 'TRANSFER' END")
    intents = ("list_filter(["
               "CASE WHEN contains(t, 'urgent') OR contains(t, 'quickly') OR contains(t, 'asap') OR contains(t, 'emergency') THEN 'urgency' END, "
               "CASE WHEN contains(t, 'all') OR contains(t, 'entire') OR contains(t, 'empty') OR contains(t, 'depletion') THEN 'depletion' END, "
               "CASE WHEN contains(t, 'multiple') OR contains(t, 'repeated') OR contains(t, 'several') THEN 'frequency' END"
               "], lambda x: x IS NOT NULL)")
    return {"amount": amt, "balance": bal, "type": ttype, "nameOrig": sender, "nameDest": receiver, "intents": intents}


def _parser_sql() -> str:
    c = parser_columns()
    amt, bal, ttype, sender, receiver = (c[k] for k in ("amount", "balance", "type", "nameOrig", "nameDest"))
    intents = f"array_to_string({c['intents']}, '|')"
    return with_sql(LEDGER_SQL, MESSAGES_SQL, "p AS (SELECT msg_id, lower(message) AS t FROM messages)", body=f"""
SELECT msg_id, 1 AS step, round({amt}, 6) AS amount, {ttype} AS type, round({bal}, 6) AS oldbalanceOrg,
       round(greatest(0e0, {bal} - {amt}), 6) AS newbalanceOrig, 0e0 AS oldbalanceDest,
       round({amt}, 6) AS newbalanceDest, {sender} AS nameOrig, {receiver} AS nameDest, {intents} AS intents
FROM p""")


PARSER_SQL = _parser_sql()


def _parsed(spark, sf):
    m = messages(spark, sf)
    d = m.select("msg_id", *P.parse_message(F.col("message")))
    return d.select("msg_id", "step", r6("amount"), "type", r6("oldbalanceOrg"), r6("newbalanceOrig"),
                    "oldbalanceDest", r6("newbalanceDest"), "nameOrig", "nameDest",
                    F.array_join("behavioral_intents", "|").alias("intents"))


for _name in ["F1_amount", "F2_amount_suffix", "F3_sender", "F4_receiver", "F5_type_keywords",
              "F6_balance", "F7_intents", "F8_derived_balances", "F9_parse_message"]:
    query(_name, sql=PARSER_SQL)(_parsed)


# ------------------------------------------------------------ projections
@query("P1_canonical_rename", sql=with_sql(LEDGER_SQL, body="""
SELECT nameOrig AS card_id, amount, nameDest AS merchant_id, isFraud AS is_fraud, step FROM txn_ledger"""))
def q_p1(spark, sf):
    return V.to_canonical(txn_ledger(spark, sf))


P3_SQL = with_sql(LEDGER_SQL, body="""
SELECT upper(substr(sha256(CAST(row_id AS VARCHAR)), 1, 12)) AS txn_id, nameOrig AS card_id, amount,
       nameDest AS merchant_id, CAST(step AS BIGINT) * 3600000 + 788918400000 AS timestamp,
       'USD' AS currency, 'US' AS country_code, 'WEB' AS channel, coalesce(isFraud = 1, false) AS is_fraud
FROM txn_ledger""")


def _canonical(spark, sf):
    led = txn_ledger(spark, sf)
    d = led.select("row_id", "step", *[F.col(k).alias(v) for k, v in V.LEDGER_TO_CANONICAL.items()
                                       if k != "step"])
    tid = F.upper(F.substring(F.sha2(F.col("row_id").cast("string"), 256), 1, 12))
    ms = F.col("step").cast("long") * 3600000 + F.lit(788918400000)
    return V.canonical_event(d, arrival_ms=ms, txn_id=tid)


query("P3_canonical_projection", sql=P3_SQL)(_canonical)


@query("P2_validate_accepted", sql=with_sql(LEDGER_SQL, body="""
SELECT nameOrig AS card_id, amount, nameDest AS merchant_id, isFraud AS is_fraud, step FROM txn_ledger
WHERE nameOrig IS NOT NULL AND amount IS NOT NULL AND nameDest IS NOT NULL AND amount >= 0"""))
def q_p2a(spark, sf):
    valid, _ = V.split_valid(V.to_canonical(txn_ledger(spark, sf)))
    return valid


@query("P2_validate_dead_letter", sql=with_sql(EVENT_SQL, body="""
SELECT error FROM (
  SELECT CASE WHEN card_id IS NULL OR amount IS NULL OR merchant_id IS NULL THEN 'missing'
              WHEN amount < 0 THEN 'Invalid amount: ' || CAST(amount AS VARCHAR) END AS error
  FROM txn_event) WHERE error IS NOT NULL"""))
def q_p2d(spark, sf):
    _, dead = V.split_valid(txn_event(spark, sf).select("txn_id", "card_id", "amount", "merchant_id"))
    return dead.select("error")


FAULT_ERROR_SQL = """CASE WHEN card_id IS NULL OR amount IS NULL OR merchant_id IS NULL THEN 'Missing fields: ' || concat_ws(', ', CASE WHEN card_id IS NULL THEN 'card_id' END,
         CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN merchant_id IS NULL THEN 'merchant_id' END)
       WHEN amount < 0 THEN 'Invalid amount: ' || CAST(amount AS VARCHAR) END"""


@query("P2_dead_letter_faults", sql=with_sql(EVENT_SQL, FAULTY_SQL, body=f"""
SELECT txn_id, error FROM (SELECT txn_id, {FAULT_ERROR_SQL} AS error FROM faulty) WHERE error IS NOT NULL"""))
def q_p2_faults(spark, sf):
    _, dead = V.split_valid(faulty_events(spark, sf).select("txn_id", "card_id", "amount", "merchant_id"))
    return dead.select(F.get_json_object("original", "$.txn_id").alias("txn_id"), "error")


@query("A24_replay_summary_faults", sql=with_sql(EVENT_SQL, FAULTY_SQL, body=f"""
SELECT count(*) FILTER (WHERE error IS NULL) AS accepted, count(*) FILTER (WHERE error IS NOT NULL) AS dead_letter
FROM (SELECT {FAULT_ERROR_SQL} AS error FROM faulty)"""))
def q_a24_faults(spark, sf):
    return V.replay_summary(faulty_events(spark, sf))


@query("A24_replay_summary", sql=with_sql(LEDGER_SQL, body="""
SELECT count(*) FILTER (WHERE nameOrig IS NOT NULL AND amount IS NOT NULL AND nameDest IS NOT NULL AND amount >= 0) AS accepted,
       count(*) FILTER (WHERE NOT (nameOrig IS NOT NULL AND amount IS NOT NULL AND nameDest IS NOT NULL AND amount >= 0)) AS dead_letter
FROM txn_ledger"""))
def q_a24(spark, sf):
    return V.replay_summary(V.to_canonical(txn_ledger(spark, sf)))


@query("P4_request_constraints", sql=with_sql(LEDGER_SQL, body="""
SELECT row_id, amount, oldbalanceOrg, nameOrig, nameDest FROM txn_ledger WHERE amount > 0"""))
def q_p4(spark, sf):
    return V.request_constraints(txn_ledger(spark, sf)).select("row_id", "amount", "oldbalanceOrg", "nameOrig",
                                                               "nameDest")


@query("P9_time_split", sql=with_sql(LEDGER_SQL, body=f"""
SELECT CASE WHEN step <= {TRAIN_CUTOFF_STEP} THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
       CAST(sum(isFraud) AS BIGINT) AS n_fraud
FROM txn_ledger GROUP BY 1"""))
def q_p9(spark, sf):
    train, test = V.time_split(txn_ledger(spark, sf), TRAIN_CUTOFF_STEP)
    agg = [F.count(F.lit(1)).alias("n_rows"), F.sum("isFraud").alias("n_fraud")]
    return (train.agg(*agg).select(F.lit("train").alias("split"), "*")
            .unionByName(test.agg(*agg).select(F.lit("test").alias("split"), "*")))


@query("P10_eligible_keys", sql=with_sql(LEDGER_SQL, body="""
SELECT row_id, nameDest FROM txn_ledger
WHERE nameDest IN (SELECT nameDest FROM txn_ledger GROUP BY nameDest HAVING count(*) >= 3)"""))
def q_p10(spark, sf):
    return V.eligible_keys(txn_ledger(spark, sf), "nameDest", 3).select("row_id", "nameDest")


@query("P11_null_fill_features", sql=with_sql(LEDGER_SQL, body="""
SELECT row_id, round(coalesce(amount / (oldbalanceOrg + 1), 0), 6) AS velocity FROM txn_ledger"""))
def q_p11(spark, sf):
    d = txn_ledger(spark, sf).select("row_id", RF.velocity(F.col("amount"), F.col("oldbalanceOrg")).alias("velocity"))
    return FE.fill_numeric_zero(d).select("row_id", r6("velocity"))
