"""Derived views over the driver's test tables.

Each view exists twice: as a Spark DataFrame function and as DuckDB SQL text
(used by the oracle queries).  Both read the whole tables; nothing is sampled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- txn_ledger
def txn_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger transactions from ``orders JOIN customer`` (o_orderkey unique)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    k = F.col("o_orderkey")
    amount = (F.when(k % 20 == 0, F.col("o_totalprice") * F.lit(2.5))
              .when(k % 20 < 4, F.col("o_totalprice"))
              .otherwise(F.col("o_totalprice") * F.lit(0.05)))
    ttype = (F.when(F.col("o_orderpriority") == "1-URGENT", "TRANSFER")
             .when(F.col("o_orderpriority") == "2-HIGH", "CASH_OUT")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "PAYMENT")
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "CASH_IN")
             .otherwise("DEBIT"))
    fraud = F.when((F.col("o_orderstatus") == "P")
                   & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
                   & (k % 3 == 0), 1).otherwise(0)
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    base = j.select(
        k.alias("row_id"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) * 24 + k % 24)
        .cast("int").alias("step"),
        ttype.alias("type"),
        amount.alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("_"), (k % 4).cast("string")).alias("nameOrig"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.lit(400.0)).alias("oldbalanceOrg"),
        F.concat(F.lit("M"), (k % 61).cast("string")).alias("nameDest"),
        fraud.alias("isFraud"),
    )
    return base.select(
        "row_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg",
        F.greatest(F.lit(0.0), F.col("oldbalanceOrg") - F.col("amount")).alias("newbalanceOrig"),
        "nameDest", F.lit(0.0).alias("oldbalanceDest"), F.col("amount").alias("newbalanceDest"),
        "isFraud")


LEDGER_SQL = """
txn_ledger AS (
  SELECT row_id, step, type, amount, nameOrig, oldbalanceOrg,
         greatest(0e0, oldbalanceOrg - amount) AS newbalanceOrig,
         nameDest, 0e0 AS oldbalanceDest, amount AS newbalanceDest, isFraud
  FROM (
    SELECT o_orderkey AS row_id,
           CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 24 + o_orderkey % 24 AS INT) AS step,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT'
                WHEN '3-MEDIUM' THEN 'PAYMENT' WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' ELSE 'DEBIT' END AS type,
           CASE WHEN o_orderkey % 20 = 0 THEN o_totalprice * 2.5e0
                WHEN o_orderkey % 20 < 4 THEN o_totalprice ELSE o_totalprice * 0.05e0 END AS amount,
           concat('C', o_custkey, '_', o_orderkey % 4) AS nameOrig,
           greatest(c_acctbal, 0e0) * 400e0 AS oldbalanceOrg,
           concat('M', o_orderkey % 61) AS nameDest,
           CAST(CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
                     AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS isFraud
    FROM orders JOIN customer ON o_custkey = c_custkey
  ) b
)"""


# ----------------------------------------------------------------- txn_event
def txn_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical card events from ``events`` (event_time as TIMESTAMP, UTC)."""
    e = table(spark, sf_dir, "events")
    event_time = F.col("ts").cast("timestamp")
    channel = (F.when(F.col("event_type") == "click", "MOBILE")
               .when(F.col("event_type") == "error", "ATM")
               .when(F.col("event_type") == "purchase", "POS")
               .otherwise("WEB"))
    return e.select(
        F.col("event_id").cast("string").alias("txn_id"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("card_id"),
        F.col("value").alias("amount"),
        F.concat(F.lit("M"), F.get_json_object("props", "$.k")).alias("merchant_id"),
        F.unix_millis(event_time).alias("timestamp"),
        event_time.alias("event_time"),
        F.lit("USD").alias("currency"),
        F.lit("US").alias("country_code"),
        channel.alias("channel"),
        ((F.col("event_type") == "error") & (F.col("value") > 50)).alias("is_fraud"),
    )


EVENT_SQL = """
txn_event AS (
  SELECT CAST(event_id AS VARCHAR) AS txn_id,
         concat('C', user_id) AS card_id, value AS amount,
         concat('M', json_extract_string(props, '$.k')) AS merchant_id,
         epoch_us(ts) // 1000 AS timestamp,
         ts AS event_time,
         'USD' AS currency, 'US' AS country_code,
         CASE event_type WHEN 'click' THEN 'MOBILE' WHEN 'error' THEN 'ATM'
              WHEN 'purchase' THEN 'POS' ELSE 'WEB' END AS channel,
         event_type = 'error' AND value > 50 AS is_fraud
  FROM events
)"""


def faulty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn_event with faults: missing fields and negative amounts by id."""
    e, i = txn_event(spark, sf_dir), F.col("txn_id").cast("long")
    return e.withColumns({
        "card_id": F.when(i % 41 != 0, F.col("card_id")), "merchant_id": F.when(i % 47 != 0, F.col("merchant_id")),
        "amount": F.when(i % 53 == 0, F.lit(None)).when(i % 43 == 0, -1 - F.floor("amount").cast("double")).otherwise(F.col("amount"))})


FAULTY_SQL = """
faulty AS (
  SELECT txn_id, timestamp, CASE WHEN CAST(txn_id AS BIGINT) % 41 <> 0 THEN card_id END AS card_id,
         CASE WHEN CAST(txn_id AS BIGINT) % 47 <> 0 THEN merchant_id END AS merchant_id,
         CASE WHEN CAST(txn_id AS BIGINT) % 53 = 0 THEN NULL WHEN CAST(txn_id AS BIGINT) % 43 = 0 THEN -1 - floor(amount) ELSE amount END AS amount
  FROM txn_event
)"""


# ------------------------------------------------------------------ messages
BASE_TIME = "1995-01-01 00:00:00"


def step_time(step: Column) -> Column:
    """Event time of a ledger step: 1995-01-01 00:00 (UTC wall clock) plus ``step`` hours.

    Computed on TIMESTAMP_NTZ so the result does not depend on the session zone.
    """
    return F.timestamp_add("HOUR", step, F.lit(BASE_TIME).cast("timestamp_ntz"))


def messages(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    """Free-text payment messages written from the ledger rows."""
    led = ledger if ledger is not None else txn_ledger(spark, sf_dir)
    r = F.col("row_id")
    verb = (F.when(F.col("type") == "PAYMENT", "Paid ")
            .when(F.col("type") == "CASH_OUT", "Cash out ")
            .when(F.col("type") == "CASH_IN", "Deposit ")
            .when(F.col("type") == "DEBIT", "Debit ")
            .otherwise("Sending "))
    text = F.concat(
        F.when(r % 7 == 0, "URGENT: ").otherwise(""),
        verb,
        F.floor("amount").cast("long").cast("string"),
        F.when(r % 11 == 0, "k").when(r % 13 == 0, " lakh").otherwise(""),
        F.lit(" from C"), (r % 1000).cast("string"),
        F.lit(" to M"), (r % 61).cast("string"),
        F.when(r % 5 == 0, " balance is 9,500.50").otherwise(""),
    )
    return led.select(r.alias("msg_id"), step_time(F.col("step")).alias("event_time"),
                      text.alias("message"))


MESSAGES_SQL = """
messages AS (
  SELECT row_id AS msg_id,
         TIMESTAMP '1995-01-01 00:00:00' + to_hours(CAST(step AS BIGINT)) AS event_time,
         concat(CASE WHEN row_id % 7 = 0 THEN 'URGENT: ' ELSE '' END,
                CASE type WHEN 'PAYMENT' THEN 'Paid ' WHEN 'CASH_OUT' THEN 'Cash out ' WHEN 'CASH_IN' THEN 'Deposit '
                          WHEN 'DEBIT' THEN 'Debit ' ELSE 'Sending ' END,
                CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR),
                CASE WHEN row_id % 11 = 0 THEN 'k' WHEN row_id % 13 = 0 THEN ' lakh' ELSE '' END,
                ' from C', CAST(row_id % 1000 AS VARCHAR), ' to M', CAST(row_id % 61 AS VARCHAR),
                CASE WHEN row_id % 5 = 0 THEN ' balance is 9,500.50' ELSE '' END) AS message
  FROM txn_ledger
)"""


# ------------------------------------------------------------ score stand-ins
def ml_prob_standin(row_id: Column) -> Column:
    """Deterministic stand-in model probability: (row_id*37 % 1000)/1000."""
    return ((row_id * 37) % 1000) / F.lit(1000.0)


ML_PROB_SQL = "((row_id * 37) % 1000) / 1000e0"


def scores(spark: SparkSession, sf_dir: str, ledger: DataFrame | None = None) -> DataFrame:
    """Labelled scores with forced ties: 0.7 * stand-in + 0.3 * label, to 2 digits.

    Rounded half-up in exact integer arithmetic (prob * 10000 is an integer),
    so every engine produces the same scores.
    """
    led = ledger if ledger is not None else txn_ledger(spark, sf_dir)
    m = (F.col("row_id") * 37 % 1000) * 7 + F.col("isFraud") * 3000
    prob = F.floor((m + 50) / 100) / F.lit(100.0)
    return led.select("row_id", F.col("isFraud").alias("y"), prob.alias("prob"))


SCORES_SQL = """
scores AS (
  SELECT row_id, isFraud AS y, floor((((row_id * 37) % 1000) * 7 + isFraud * 3000 + 50) / 100) / 100e0 AS prob
  FROM txn_ledger
)"""


def with_sql(*ctes: str, body: str, recursive: bool = False) -> str:
    """Compose an oracle statement from CTE snippets and a final SELECT."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    seen: list[str] = []
    for c in ctes:
        c = c.strip()
        if c not in seen:
            seen.append(c)
    return head + ",\n".join(seen) + "\n" + body
