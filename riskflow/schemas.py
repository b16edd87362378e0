"""Declared schemas of the data model (no inference anywhere)."""
from pyspark.sql import types as T

# Canonical transaction as carried on the event stream (epoch-ms timestamp).
TXN_EVENT = T.StructType([
    T.StructField("txn_id", T.StringType(), False),
    T.StructField("card_id", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("merchant_id", T.StringType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("currency", T.StringType(), True),
    T.StructField("country_code", T.StringType(), True),
    T.StructField("channel", T.StringType(), True),
    T.StructField("is_fraud", T.BooleanType(), True),
])

# Ledger (account-to-account) transaction with label.
TXN_LEDGER = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("step", T.IntegerType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("nameOrig", T.StringType(), True),
    T.StructField("oldbalanceOrg", T.DoubleType(), True),
    T.StructField("newbalanceOrig", T.DoubleType(), True),
    T.StructField("nameDest", T.StringType(), True),
    T.StructField("oldbalanceDest", T.DoubleType(), True),
    T.StructField("newbalanceDest", T.DoubleType(), True),
    T.StructField("isFraud", T.IntegerType(), True),
])

# Raw ledger CSV as delivered (source column names, label included).
LEDGER_CSV = T.StructType([
    T.StructField("step", T.IntegerType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("nameOrig", T.StringType(), True),
    T.StructField("oldbalanceOrg", T.DoubleType(), True),
    T.StructField("newbalanceOrig", T.DoubleType(), True),
    T.StructField("nameDest", T.StringType(), True),
    T.StructField("oldbalanceDest", T.DoubleType(), True),
    T.StructField("newbalanceDest", T.DoubleType(), True),
    T.StructField("isFraud", T.IntegerType(), True),
])

KAFKA_LIKE = T.StructType([
    T.StructField("key", T.BinaryType(), True),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
])

MESSAGES = T.StructType([
    T.StructField("msg_id", T.LongType(), False),
    T.StructField("event_time", T.TimestampType(), True),
    T.StructField("message", T.StringType(), True),
])

# Stored scored record (one row per scored transaction).
RECORDS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("input_text", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("ml_probability", T.DoubleType(), True),
    T.StructField("behavioral_score", T.DoubleType(), True),
    T.StructField("final_risk_score", T.DoubleType(), True),
    T.StructField("scoring_mode", T.StringType(), True),
    T.StructField("risk_level", T.StringType(), True),
    T.StructField("action", T.StringType(), True),
    T.StructField("reasons", T.ArrayType(T.StringType()), True),
    T.StructField("indicators", T.ArrayType(T.StringType()), True),
    T.StructField("pattern_summary", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
])

ALERTS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("risk_level", T.StringType(), True),
    T.StructField("reasons", T.ArrayType(T.StringType()), True),
])

SCORES = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("y", T.IntegerType(), True),
    T.StructField("prob", T.DoubleType(), True),
])

CONTRIBUTIONS = T.StructType([
    T.StructField("txn_id", T.StringType(), False),
    T.StructField("feature", T.StringType(), False),
    T.StructField("contribution", T.DoubleType(), True),
])

RUNS = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("value", T.DoubleType(), True),
])

MODEL_VERSIONS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("version", T.IntegerType(), False),
    T.StructField("run_id", T.StringType(), True),
    T.StructField("stage", T.StringType(), True),
])

# Ledger transaction types (alphabetical order is the encoding).
TXN_TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
