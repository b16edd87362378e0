"""Projection, validation and dead-letter routing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source -> canonical column names of the ledger replay.
LEDGER_TO_CANONICAL = {
    "nameOrig": "card_id",
    "amount": "amount",
    "nameDest": "merchant_id",
    "isFraud": "is_fraud",
    "step": "step",
}
REQUIRED = ["card_id", "amount", "merchant_id"]
REQUEST_DEFAULTS = {"oldbalanceOrg": 0.0, "newbalanceOrig": 0.0, "oldbalanceDest": 0.0,
                    "newbalanceDest": 0.0, "nameOrig": "C_UNKNOWN", "nameDest": "M_UNKNOWN"}


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename to canonical names and keep only mapped columns that exist."""
    present = [c for c in LEDGER_TO_CANONICAL if c in df.columns]
    return df.select(*[F.col(c).alias(LEDGER_TO_CANONICAL[c]) for c in present])


def validation_error(df: DataFrame) -> Column:
    """Null when valid, else the error text (first failing rule)."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return F.lit("Missing fields: " + ", ".join(sorted(missing)))
    amount_txt = F.col("amount").cast("string")
    amount_num = amount_txt.try_cast("double")
    miss = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    return (F.when(F.col("card_id").isNull() | F.col("amount").isNull() | F.col("merchant_id").isNull(),
                   F.concat(F.lit("Missing fields: "), miss))
            .when(amount_num.isNull() | (amount_num < 0), F.concat(F.lit("Invalid amount: "), amount_txt)))


def split_valid(df: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead-letter rows: original JSON, error, time)."""
    d = df.withColumn("_error", validation_error(df))
    valid = d.filter(F.col("_error").isNull()).drop("_error")
    ts = now if now is not None else F.current_timestamp()
    dead = d.filter(F.col("_error").isNotNull()).select(
        F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("original"),
        F.col("_error").alias("error"), ts.alias("ts"))
    return valid, dead


def canonical_event(df: DataFrame, arrival_ms: Column | None = None, txn_id: Column | None = None) -> DataFrame:
    """Canonical transaction with constants and generated id / arrival time.

    Production ids are random (``uuid()``); pass ``txn_id`` for a deterministic
    variant (tests, oracles).
    """
    tid = txn_id if txn_id is not None else F.expr("uuid()")
    ms = arrival_ms if arrival_ms is not None else F.unix_millis(F.current_timestamp())
    fraud = F.col("is_fraud").cast("boolean") if "is_fraud" in df.columns else F.lit(None).cast("boolean")
    return df.select(
        tid.alias("txn_id"),
        F.col("card_id").cast("string").alias("card_id"),
        F.col("amount").cast("double").alias("amount"),
        F.col("merchant_id").cast("string").alias("merchant_id"),
        ms.cast("long").alias("timestamp"),
        F.lit("USD").alias("currency"), F.lit("US").alias("country_code"), F.lit("WEB").alias("channel"),
        F.coalesce(fraud, F.lit(False)).alias("is_fraud"))


def request_constraints(df: DataFrame) -> DataFrame:
    """Keep ``amount > 0`` and fill defaults for missing balances and ids."""
    fills = {k: v for k, v in REQUEST_DEFAULTS.items() if k in df.columns}
    return df.filter(F.col("amount") > 0).na.fill(fills)


def time_split(df: DataFrame, cutoff_step: int, step: str = "step") -> tuple[DataFrame, DataFrame]:
    """Train ``step <= cutoff``, test ``step > cutoff``."""
    return df.filter(F.col(step) <= cutoff_step), df.filter(F.col(step) > cutoff_step)


def eligible_keys(df: DataFrame, key: str, min_rows: int = 3) -> DataFrame:
    """P10: rows whose key has at least ``min_rows`` rows (partial count + semi join)."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows).select(key)
    return df.join(keys, key, "left_semi")


def shared_columns(a: DataFrame, b: DataFrame, wanted: list[str]) -> list[str]:
    """Requested columns present in both inputs (others are skipped)."""
    return [c for c in wanted if c in a.columns and c in b.columns]


def replay_summary(df: DataFrame) -> DataFrame:
    """Accepted and dead-letter counts in one pass."""
    e = validation_error(df)
    return df.agg(F.count_if(e.isNull()).alias("accepted"), F.count_if(e.isNotNull()).alias("dead_letter"))
