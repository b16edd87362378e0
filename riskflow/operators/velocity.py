"""Event-time velocity per card in tumbling windows (A1-A3, batch form of T2)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The three window widths and their column suffixes.
WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour"}


def velocity(df: DataFrame, suffix: str, key: str = "card_id", ts: str = "event_time") -> DataFrame:
    """Count of txn ids and amount sum per card and window; +distinct merchants (5m, 1h); +max (1h)."""
    aggs = [F.count("txn_id").alias(f"txn_count_{suffix}"), F.sum("amount").alias(f"amount_sum_{suffix}")]
    if suffix == "1h":
        aggs.append(F.max("amount").alias("amount_max_1h"))
    if suffix in ("5m", "1h"):
        aggs.append(F.count_distinct("merchant_id").alias(f"unique_merchants_{suffix}"))
    g = df.groupBy(F.col(key), F.window(F.col(ts), WIDTHS[suffix]).alias("w")).agg(*aggs)
    return g.select(key, F.col("w.end").alias(f"window_end_{suffix}"), *[a for a in g.columns if a not in (key, "w")])
