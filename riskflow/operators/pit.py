"""Point-in-time feature lookup (as-of join with a time-to-live).

For every entity row: the latest feature row of the same key with
``feature_ts <= event_ts``, and only if ``feature_ts >= event_ts - ttl``.
Equal times: features sort before events, so they are visible.  Feature rows of
one key and time: the one created last wins, and among those created together
(or without a created time) the one with the greatest values, so the answer
never depends on the order of the input.  A null key matches nothing, feature
rows without a key or a time are never seen, an event without a time has no features.

No theta join: both sides are unioned and tagged; within (key, day) a
``last(ignorenulls)`` window carries the newest feature forward, and a per-day
summary carries it across days.  A hot key is split by day.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding
CUR = Window.currentRow


def asof_join(events: DataFrame, features: DataFrame, key: str, event_ts: str, feature_ts: str,
              feature_cols: list[str], ttl_seconds: int = 30 * 86400, created: str | None = None) -> DataFrame:
    """``events`` plus ``feature_cols`` and ``feature_ts`` of the matching feature row (or nulls).

    created: column of ``features`` that decides between rows of one key and time.
    """
    made = F.col(created) if created else F.lit(None).cast("timestamp")
    payload = F.struct(F.col(feature_ts).alias("_fts"), made.alias("_made"), *[F.col(c) for c in feature_cols])
    f = features.filter(F.col(key).isNotNull() & F.col(feature_ts).isNotNull()).select(F.col(key), F.col(feature_ts).alias("_t"), F.lit(0).alias("_side"),
                        payload.alias("_feat"))
    e = events.select(F.col(key), F.col(event_ts).alias("_t"), F.lit(1).alias("_side"),
                      F.lit(None).cast(f.schema["_feat"].dataType).alias("_feat"),
                      F.struct(*[F.col(c) for c in events.columns]).alias("_ev"))
    u = f.withColumn("_ev", F.lit(None).cast(e.schema["_ev"].dataType)).unionByName(e)
    u = u.withColumn("_blk", F.unix_date(F.to_date("_t")))
    nowhere = F.col(key).isNull() | F.col("_t").isNull()
    alone = u.filter(nowhere).select("_ev", "_t", F.lit(None).cast(f.schema["_feat"].dataType).alias("_hit"))
    u = u.filter(~nowhere)
    w = Window.partitionBy(key, "_blk").orderBy("_t", "_side", "_feat")
    u = u.withColumn("_in", F.last("_feat", ignorenulls=True).over(w.rowsBetween(UNB, CUR)))
    summ = u.groupBy(key, "_blk").agg(F.max_by("_feat", F.when(F.col("_side") == 0, F.struct("_t", "_feat")))
                                      .alias("_bl"))
    ws = Window.partitionBy(key).orderBy("_blk").rowsBetween(UNB, -1)
    summ = summ.select(key, "_blk", F.last("_bl", ignorenulls=True).over(ws).alias("_carry"))
    j = u.filter(F.col("_side") == 1).join(summ, [key, "_blk"])
    hit = F.coalesce(F.col("_in"), F.col("_carry"))
    fresh = hit["_fts"] >= F.col("_t") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    j = j.select("_ev", "_t", F.when(fresh, hit).alias("_hit")).unionByName(alone)
    return j.select("_ev.*", F.col("_hit._fts").alias(feature_ts),
                    *[F.col(f"_hit.{c}").alias(c) for c in feature_cols])
