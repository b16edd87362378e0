"""Fixed-length history sequences per key.

For each row of a key with at least ``min_rows`` rows: the previous
``window`` rows of the same key (current row excluded), oldest first,
left-padded with zero vectors, plus a 0/1 mask.

A prefix scan gives each row the rows before it: the rows are shuffled once, and
only the last ``window`` rows of a key go on from one partition to the next,
however large the key is.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators.ordered import prefix_scan
from riskflow.operators.validate import eligible_keys

WINDOW = 10
MIN_ROWS = 3


def build_sequences(df: DataFrame, feature_cols: list[str], key: str = "nameDest", window: int = WINDOW,
                    min_rows: int = MIN_ROWS, label: str = "isFraud") -> DataFrame:
    """(row_id, key, step, label, seq array<array<double>>, mask array<double>, seq_len int)."""
    d = eligible_keys(df, key, min_rows)
    d = prefix_scan(d, [key], [F.col("step"), F.col("row_id")], position="_pos", rows_before=("_hist", [F.col(c) for c in feature_cols], window))
    n = F.size("_hist")
    zero = F.array_repeat(F.lit(0.0), len(feature_cols))
    seq = F.concat(F.array_repeat(zero, F.lit(window) - n), F.col("_hist"))
    mask = F.concat(F.array_repeat(F.lit(0.0), F.lit(window) - n), F.array_repeat(F.lit(1.0), n))
    return d.select("row_id", key, "step", label, seq.alias("seq"), mask.alias("mask"), n.cast("int").alias("seq_len"))


def split_summary(df: DataFrame, cutoff_step: int, key: str = "nameDest", min_rows: int = MIN_ROWS, label: str = "isFraud") -> DataFrame:
    """Sequences and label rate of the train (step <= cutoff) and test parts: each row of an eligible key makes one sequence."""
    part = F.when(F.col("step") <= cutoff_step, "train").otherwise("test")
    return eligible_keys(df, key, min_rows).groupBy(part.alias("split")).agg(F.count(F.lit(1)).alias("sequences"),
                                                 F.avg(F.col(label).cast("double")).alias("fraud_rate"))
