"""Registered queries: bounded (availableNow) runs of the streaming jobs.

Each query replays a table derived from the given data through the real
streaming job into a scratch folder under the session's checkpoint folder and
returns what the sink received.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions import parse as P
from riskflow.functions import scoring as S
from riskflow.functions.scoring import iso_utc
from riskflow.operators import audit as AU
from riskflow.operators.ordered import store as written
from riskflow.plans.catalog_features import FAULT_ERROR_SQL, parser_columns
from riskflow.plans.registry import query
from riskflow.plans.sqlparts import scored_ledger_ctes
from riskflow.schemas import KAFKA_LIKE
from riskflow.session import scratch_path
from riskflow.sources.views import EVENT_SQL, FAULTY_SQL, LEDGER_SQL, MESSAGES_SQL, ML_PROB_SQL, faulty_events, messages, ml_prob_standin, txn_event, txn_ledger, with_sql
from riskflow.streaming import scoring as SS
from riskflow.streaming import velocity as SV


def _replay_events(spark, sf):
    """Events as Kafka-like rows (key = card, JSON value) in a scratch folder."""
    ev = txn_event(spark, sf)
    kv = SV.kafka_sink_frame(ev.select("txn_id", "card_id", "amount", "merchant_id", "timestamp", "currency",
                                       "country_code", "channel", "is_fraud"))
    path = scratch_path(spark, "replay-events")
    kv.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"),
              F.current_timestamp().alias("timestamp")).write.parquet(path)
    return path


@query("T2_stream_velocity_1m", sql=with_sql(EVENT_SQL, body="""
SELECT card_id, strftime(time_bucket(INTERVAL '1 minute', epoch_ms(timestamp)) + INTERVAL '1 minute',
                         '%Y-%m-%dT%H:%M:%SZ') AS window_end_1m,
       count(txn_id) AS txn_count_1m, round(sum(amount), 6) AS amount_sum_1m
FROM txn_event
GROUP BY card_id, time_bucket(INTERVAL '1 minute', epoch_ms(timestamp))
HAVING time_bucket(INTERVAL '1 minute', epoch_ms(timestamp)) + INTERVAL '1 minute'
       <= (SELECT max(epoch_ms(timestamp)) FROM txn_event) - INTERVAL '2 minutes'"""))
def q_t2(spark, sf):
    src = _replay_events(spark, sf)
    out, ck = scratch_path(spark, "t2-out"), scratch_path(spark, "t2-ck")
    raw = SV.file_source(spark, src, KAFKA_LIKE)
    q = SV.write_stream(SV.velocity_1m(SV.parsed_events(SV.decode(raw))), out, ck, available_now=True)
    q.awaitTermination()
    r = spark.read.parquet(out)
    return r.select("card_id", iso_utc(F.col("window_end_1m")).alias("window_end_1m"), "txn_count_1m",
                    F.round("amount_sum_1m", 6).alias("amount_sum_1m"))


query("T1_watermark_append", sql=with_sql(EVENT_SQL, body="""
SELECT card_id, strftime(time_bucket(INTERVAL '1 minute', epoch_ms(timestamp)) + INTERVAL '1 minute',
                         '%Y-%m-%dT%H:%M:%SZ') AS window_end_1m,
       count(txn_id) AS txn_count_1m, round(sum(amount), 6) AS amount_sum_1m
FROM txn_event
GROUP BY card_id, time_bucket(INTERVAL '1 minute', epoch_ms(timestamp))
HAVING time_bucket(INTERVAL '1 minute', epoch_ms(timestamp)) + INTERVAL '1 minute'
       <= (SELECT max(epoch_ms(timestamp)) FROM txn_event) - INTERVAL '2 minutes'"""))(q_t2)


def _stream_window_sql(width: str, suffix: str, extra: str) -> str:
    """Windows that the 2-minute watermark has passed at the end of the replay."""
    bucket = f"time_bucket(INTERVAL '{width}', epoch_ms(timestamp))"
    return with_sql(EVENT_SQL, body=f"""
SELECT card_id, strftime({bucket} + INTERVAL '{width}', '%Y-%m-%dT%H:%M:%SZ') AS window_end_{suffix},
       count(txn_id) AS txn_count_{suffix}, round(sum(amount), 6) AS amount_sum_{suffix}{extra},
       count(DISTINCT merchant_id) AS unique_merchants_{suffix}
FROM txn_event
GROUP BY card_id, {bucket}
HAVING {bucket} + INTERVAL '{width}' <= (SELECT max(epoch_ms(timestamp)) FROM txn_event) - INTERVAL '2 minutes'""")


def _stream_velocity(spark, sf, velocity, suffix: str):
    out, ck = scratch_path(spark, f"t2-{suffix}-out"), scratch_path(spark, f"t2-{suffix}-ck")
    raw = SV.file_source(spark, _replay_events(spark, sf), KAFKA_LIKE)
    SV.write_stream(velocity(SV.parsed_events(SV.decode(raw))), out, ck, available_now=True).awaitTermination()
    r = spark.read.parquet(out)
    sums = {c: F.round(c, 6) for c in r.columns if c.startswith("amount_")}
    return r.withColumns({f"window_end_{suffix}": iso_utc(F.col(f"window_end_{suffix}")), **sums})


@query("T2_stream_velocity_5m", sql=_stream_window_sql("5 minutes", "5m", ""))
def q_t2_5m(spark, sf):
    return _stream_velocity(spark, sf, SV.velocity_5m, "5m")


@query("T2_stream_velocity_1h", sql=_stream_window_sql("1 hour", "1h", ", round(max(amount), 6) AS amount_max_1h"))
def q_t2_1h(spark, sf):
    return _stream_velocity(spark, sf, SV.velocity_1h, "1h")


@query("T10_stream_dead_letters", sql=with_sql(EVENT_SQL, body="""
SELECT 'x' AS error FROM txn_event WHERE card_id IS NULL OR merchant_id IS NULL OR amount IS NULL OR amount < 0"""))
def q_t10(spark, sf):
    src = _replay_events(spark, sf)
    out, ck = scratch_path(spark, "t10-out"), scratch_path(spark, "t10-ck")
    q = SV.write_stream(SV.dead_letters(SV.decode(SV.file_source(spark, src, KAFKA_LIKE))), out, ck,
                        available_now=True)
    q.awaitTermination()
    return spark.read.schema("original string, error string, ts timestamp").parquet(out).select("error")


@query("T10_stream_dead_letter_faults", sql=with_sql(EVENT_SQL, FAULTY_SQL, body=f"""
SELECT error FROM (SELECT CASE WHEN CAST(txn_id AS BIGINT) % 59 = 0 THEN 'Malformed JSON' ELSE {FAULT_ERROR_SQL} END AS error FROM faulty) WHERE error IS NOT NULL"""))
def q_t10_faults(spark, sf):
    """Missing fields, negative amounts and text that is no JSON."""
    ev = faulty_events(spark, sf).select("txn_id", "card_id", "amount", "merchant_id", "timestamp")
    broken = F.col("txn_id").cast("long") % 59 == 0
    src, out = scratch_path(spark, "t10f-in"), scratch_path(spark, "t10f-out")
    value = F.when(broken, F.lit("{not json")).otherwise(F.to_json(F.struct(*ev.columns)))
    ev.select(F.col("card_id").cast("binary").alias("key"), value.cast("binary").alias("value"), F.current_timestamp().alias("timestamp")).write.parquet(src)
    SV.write_stream(SV.dead_letters(SV.decode(SV.file_source(spark, src, KAFKA_LIKE))), out, scratch_path(spark, "t10f-ck"), available_now=True).awaitTermination()
    return spark.read.schema("original string, error string, ts timestamp").parquet(out).select("error")


@query("T7_stream_parsed_passthrough", sql=with_sql(EVENT_SQL, body="""
SELECT txn_id, card_id, round(amount, 6) AS amount, merchant_id, timestamp FROM txn_event"""))
def q_t7(spark, sf):
    src = _replay_events(spark, sf)
    out, ck = scratch_path(spark, "t7-out"), scratch_path(spark, "t7-ck")
    q = SV.write_stream(SV.parsed_events(SV.decode(SV.file_source(spark, src, KAFKA_LIKE))), out, ck,
                        available_now=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("txn_id", "card_id", F.round("amount", 6).alias("amount"),
                                          "merchant_id", "timestamp")


@query("T11_enriched_and_alert_topics", sql=with_sql(EVENT_SQL, body="""
SELECT 'enriched' AS topic, card_id AS key, txn_id, CAST(hour(event_time) BETWEEN 0 AND 5 AS INT) AS is_night FROM txn_event
UNION ALL SELECT 'alerts', card_id, txn_id, NULL FROM txn_event WHERE is_fraud"""))
def q_t11(spark, sf):
    """Both topics written from one parse of every micro-batch, to folders in the place of topics."""
    src, out = _replay_events(spark, sf), scratch_path(spark, "t11-out")
    parsed = SV.parsed_events(SV.decode(SV.file_source(spark, src, KAFKA_LIKE)), None)
    body = SV.fan_out(SV.enriched_and_alerts(), SV.to_topic(out, fmt="parquet"))
    parsed.writeStream.foreachBatch(body).option("checkpointLocation", scratch_path(spark, "t11-ck")).trigger(availableNow=True).start().awaitTermination()
    topics = [spark.read.parquet(f"{out}/{t}").select(F.lit(t).alias("topic"), "key", F.get_json_object("value", "$.txn_id").alias("txn_id"),
                                                    F.get_json_object("value", "$.is_night").cast("int").alias("is_night")) for t in (SV.ENRICHED_TOPIC, SV.ALERT_TOPIC)]
    return topics[0].unionByName(topics[1])


def _deliver(spark, parts, name: str, files: int = 4):
    """A stream that delivers the parts one after the other, a micro-batch each.

    A part has a file for every core where there are rows enough, else ``files``.
    """
    path = scratch_path(spark, name)
    rows = min(p.count() for p in parts)
    files = max(files, min(spark.sparkContext.defaultParallelism, rows // 1000))
    for i, part in enumerate(parts):
        part.repartition(files).write.parquet(f"{path}/p{i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


#: steps between the three deliveries of a replay
DELIVERIES = (15000, 30000)


def _by_step(d, extra=()):
    low, high = DELIVERIES
    parts = [d.filter(F.col("step") < low), d.filter((F.col("step") >= low) & (F.col("step") < high)), d.filter(F.col("step") >= high)]
    return [p.unionByName(extra[i]) if i < len(extra) and extra[i] is not None else p for i, p in enumerate(parts)]


@query("T8_keyed_state_scoring", sql=with_sql(*scored_ledger_ctes(ml_prob=ML_PROB_SQL), body=f"""
SELECT row_id, nameOrig, nameDest, burst, round(merchant_risk, 6) AS merchant_risk,
       round(coalesce(avg({ML_PROB_SQL}) OVER (PARTITION BY nameOrig ORDER BY step, row_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 0e0), 6)
         AS historical_risk_score
FROM scored""", recursive=True))
def q_t8(spark, sf):
    """User and merchant state over three micro-batches."""
    led = written(txn_ledger(spark, sf).withColumn("ml_prob", ml_prob_standin(F.col("row_id"))), "t8-ledger")
    out = scratch_path(spark, "t8-out")
    states = SS.merchant_state(SS.verdict_inputs(SS.user_state(_deliver(spark, _by_step(led), "t8-in"), "ml_prob"), "ml_prob"))
    SS.start(states, scratch_path(spark, "t8-ck"), out_path=out, available_now=True)
    r6 = lambda c: F.round(c, 6).alias(c)
    return spark.read.schema(states.schema).parquet(out).select("row_id", "nameOrig", "nameDest", "burst", r6("merchant_risk"), r6("historical_risk_score"))


_SAID = parser_columns()
MESSAGE_LEDGER = [LEDGER_SQL.replace("txn_ledger AS", "ledger0 AS", 1), MESSAGES_SQL.replace("SELECT row_id AS msg_id,", "SELECT row_id AS msg_id, step AS step0,").replace("FROM txn_ledger", "FROM ledger0"),
                  "said AS (SELECT msg_id, step0, lower(message) AS t FROM messages)", f"""
txn_ledger AS (SELECT msg_id AS row_id, step0 AS step, {_SAID['amount']} AS amount, {_SAID['type']} AS type, {_SAID['balance']} AS oldbalanceOrg,
                      {_SAID['nameOrig']} AS nameOrig, {_SAID['nameDest']} AS nameDest, {_SAID['intents']} AS intents FROM said)"""]


@query("T9_stream_scoring", sql=with_sql(*scored_ledger_ctes(ml_prob=ML_PROB_SQL, base=MESSAGE_LEDGER, intents="intents"), body="""
SELECT upper(sha256(CAST(row_id AS VARCHAR))) AS record_key, round(amount, 6) AS amount, type, round(final_risk_score, 4) AS final_risk_score,
       'Hybrid' AS scoring_mode, risk_level, action, indicators_text, reasons_text, pattern_summary,
       risk_level = 'High' AS alerted, nameOrig AS entity, nameDest AS merchant
FROM scored""", recursive=True))
def q_t9(spark, sf):
    """Messages, some delivered twice: parse, keyed state, hybrid score; then records, alerts and logs as stored."""
    led = written(txn_ledger(spark, sf), "t9-ledger")
    said = messages(spark, sf, led).join(led.select(F.col("row_id").alias("msg_id"), "step"), "msg_id")
    value = said.select("step", F.to_json(F.struct("msg_id", "message", ml_prob_standin(F.col("msg_id")).alias("ml_prob"),
                                                   F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"))).alias("value"))
    value = written(value, "t9-said")
    again = value.filter(F.col("step") % 10 == 0)
    low, high = DELIVERIES
    parts = _by_step(value, (None, again.filter(F.col("step") < low), again.filter(F.col("step") < high)))
    stream = _deliver(spark, parts, "t9-in")
    heard = stream.select(F.from_json("value", "msg_id long, message string, ml_prob double, event_time timestamp_ntz").alias("m")).select("m.*")
    parsed = SS.first_writes(heard, "msg_id", ("event_time", "msg_id")) \
        .select("msg_id", "event_time", "ml_prob", *[c for c in P.parse_message(F.col("message"))])
    scored = SS.scoring_stream(parsed, "ml_prob", "behavioral_intents", order_cols=("event_time", "msg_id"))
    records = AU.to_records(scored, ts=F.col("event_time"), txn_id=S.record_id(F.col("msg_id")), record_key=S.record_key(F.col("msg_id")), ml_prob="ml_prob")
    store = {k: scratch_path(spark, f"t9-{k}") for k in ("records", "alerts", "logs")}
    SS.start(records, scratch_path(spark, "t9-ck"), sink=SS.audit_writer(*store.values()), available_now=True)
    kept = spark.read.parquet(store["records"])
    alerts = spark.read.parquet(store["alerts"]).select(AU.KEY, F.lit(True).alias("alerted"))
    logs = spark.read.parquet(store["logs"]).select("transaction_id", "entity", "merchant")
    return kept.join(alerts, AU.KEY, "left").join(logs, "transaction_id").select(
        AU.KEY, F.round("amount", 6).alias("amount"), "type", "final_risk_score", "scoring_mode", "risk_level", "action",
        F.array_join("indicators", "|").alias("indicators_text"), F.array_join("reasons", "|").alias("reasons_text"), "pattern_summary",
        F.coalesce("alerted", F.lit(False)).alias("alerted"), "entity", "merchant")


@query("S7_stream_first_write_wins", sql=with_sql(LEDGER_SQL, body=f"""
SELECT row_id, round(amount, 6) AS amount, CASE WHEN step < {DELIVERIES[0]} THEN 0 WHEN step < {DELIVERIES[1]} THEN 1 ELSE 2 END AS delivery FROM txn_ledger"""))
def q_s7_stream(spark, sf):
    """Every record comes again in each later delivery, with another amount; the store keeps the first."""
    led = written(txn_ledger(spark, sf).select("row_id", "step", "amount"), "s7-ledger")
    low, high = DELIVERIES
    later = led.withColumn("amount", F.col("amount") + 1)
    parts = _by_step(led, (None, later.filter(F.col("step") < low), later.filter(F.col("step") < high)))
    stream = _deliver(spark, [p.withColumn("delivery", F.lit(i)) for i, p in enumerate(parts)], "s7-in")
    out = scratch_path(spark, "s7-out")
    first = SS.first_writes(stream, "row_id", ("step", "row_id"))
    SS.start(first, scratch_path(spark, "s7-ck"), out_path=out, available_now=True)
    return spark.read.schema(first.schema).parquet(out).select("row_id", F.round("amount", 6).alias("amount"), "delivery")
