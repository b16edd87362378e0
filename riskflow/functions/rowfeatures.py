"""Row-local feature expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.schemas import TXN_TYPES


def one_hot(col: str, categories: list[str] = TXN_TYPES, prefix: str | None = None) -> list[Column]:
    """``<prefix>_<value>`` booleans; null input gives all false."""
    p = prefix or col
    return [F.coalesce(F.col(col) == c, F.lit(False)).alias(f"{p}_{c}") for c in categories]


def online_type_flags(ttype: Column) -> list[Column]:
    """case-sensitive 0/1 flags used by the online model vector."""
    return [(ttype == "TRANSFER").cast("int").alias("type_TRANSFER"),
            (ttype == "CASH_OUT").cast("int").alias("type_CASH_OUT")]


def velocity(amount: Column, old_balance: Column) -> Column:
    """amount/(balance+1); null when the divisor is 0 (balance -1)."""
    return F.try_divide(amount, old_balance + 1)


def is_night(event_time: Column) -> Column:
    """1 when the event hour is 0..5 (inclusive)."""
    return F.hour(event_time).between(0, 5).cast("int")


def epoch_ms_to_ts(ms: Column) -> Column:
    """epoch milliseconds -> TIMESTAMP."""
    return F.timestamp_millis(ms)


def model_extras(step: Column, ttype: Column, amount: Column, old_org: Column, new_org: Column,
                 old_dest: Column, new_dest: Column) -> list[Column]:
    """vector entries with no formula upstream (documented decisions)."""
    enc = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(TXN_TYPES))):
        enc = F.when(ttype == t, F.lit(i)).otherwise(enc)
    diff_org = old_org - new_org
    return [
        F.coalesce(enc, F.lit(-1)).alias("type_encoded"),
        (step % 24).alias("hour_of_day"),
        diff_org.alias("balance_diff_orig"),
        (new_dest - old_dest).alias("balance_diff_dest"),
        (F.abs(diff_org - amount) > 0.01).cast("int").alias("balance_mismatch"),
    ]
