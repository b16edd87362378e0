"""Behavioural features per user and merchant.

Ordering: every ordered operator sorts by ``(step, row_id)`` (``row_id`` is the
input order tie-break).  Running aggregates go through
:func:`riskflow.operators.ordered.prefix_scan`, which lets a hot key lie across
partitions, so no key is ever processed by a single task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.rowfeatures import one_hot, velocity
from riskflow.operators.ordered import prefix_scan

ALPHA = 10


def encode_type(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """append one-hot ``type_<value>`` columns."""
    from riskflow.schemas import TXN_TYPES
    return df.select("*", *one_hot("type", categories or TXN_TYPES))


def first_pair_flag(df: DataFrame, a: str, b: str, order: tuple[str, str] = ("step", "row_id"),
                    out: str = "_first_pair") -> DataFrame:
    """1 on the first row (in ``order``) of every (a, b) pair, else 0.

    A prefix scan over the pairs: the first row is the one at position 1, however
    many partitions the rows of a hot pair fill.
    """
    d = prefix_scan(df, [a, b], [F.col(c) for c in order], position=out)
    return d.withColumn(out, (F.col(out) == 1).cast("int"))


def user_features(df: DataFrame) -> DataFrame:
    """W1 txn_count, W2 amt_sum, W3 time_gap, W4 burst_count, W5 unique_merchants, F12 velocity.

    Two shuffles: one by (user, merchant) for W5, one by user for all the rest.
    """
    d = first_pair_flag(df, "nameOrig", "nameDest")
    d = prefix_scan(d, ["nameOrig"], [F.col("step"), F.col("row_id")],
                    sums={"amt_sum": F.col("amount"), "unique_merchants": F.col("_first_pair")},
                    position="txn_count", lag_of=F.col("step"))
    return d.withColumns({
        "velocity": velocity(F.col("amount"), F.col("oldbalanceOrg")),
        "time_gap": F.coalesce(F.col("step") - F.col("_lag1"), F.lit(0)),
        "burst_count": F.lit(2) + (F.coalesce(F.col("step") - F.col("_lag2"), F.lit(999)) <= 3).cast("int"),
    }).drop("_lag1", "_lag2", "_first_pair")


def _merchant_order(order: str) -> list[Column]:
    if order == "parity":
        # Rows of a merchant in (user, step) order: the order the offline code leaves behind.
        return [F.col("nameOrig"), F.col("step"), F.col("row_id")]
    if order == "event":
        return [F.col("step"), F.col("row_id")]
    raise ValueError(f"unknown order {order!r}")


def global_fraud_rate(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """A5: one-row table with the mean label."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("global_rate"))


def merchant_features(df: DataFrame, alpha: float = ALPHA, order: str = "parity", prior: DataFrame | None = None) -> DataFrame:
    """W6 merchant_frequency and W7 smoothed merchant_risk from earlier rows; prior: rows of the global rate, by default all."""
    d = prefix_scan(df, ["nameDest"], _merchant_order(order), sums={"_fraud_run": F.col("isFraud")},
                    position="merchant_frequency")
    g = global_fraud_rate(d if prior is None else prior)  # exactly one row: safe to broadcast; of the scanned rows, so the input is read once
    d = d.crossJoin(F.broadcast(g))
    prior_sum = (F.col("_fraud_run") - F.col("isFraud")).cast("double")
    prior_cnt = F.col("merchant_frequency") - 1
    risk = (prior_sum + F.lit(float(alpha)) * F.col("global_rate")) / (prior_cnt + F.lit(float(alpha)))
    return d.withColumn("merchant_risk", F.coalesce(risk, F.lit(0.0))).drop("_fraud_run", "global_rate")


def merchant_stats(train: DataFrame) -> DataFrame:
    """A4: fraud sum and count by merchant (partial + final aggregation)."""
    return train.groupBy("nameDest").agg(F.sum("isFraud").alias("fraud_sum"),
                                         F.count(F.lit(1)).alias("txn_cnt"))


def merchant_risk_from_train(df: DataFrame, train: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Smoothed merchant risk from a training table; unseen merchant -> global rate."""
    stats = merchant_stats(train)
    g = global_fraud_rate(train)
    d = df.join(stats, "nameDest", "left").crossJoin(F.broadcast(g))
    s = F.coalesce(F.col("fraud_sum"), F.lit(0)).cast("double")
    c = F.coalesce(F.col("txn_cnt"), F.lit(0)).cast("double")
    risk = (s + F.lit(float(alpha)) * F.col("global_rate")) / (c + F.lit(float(alpha)))
    return d.withColumn("merchant_risk", F.coalesce(risk, F.lit(0.0))).drop("fraud_sum", "txn_cnt", "global_rate")


def all_features(df: DataFrame, train: DataFrame | None = None, order: str = "parity", prior: DataFrame | None = None) -> DataFrame:
    """Offline feature set: F10, W1-W5, F12, W5/W6, W7 or W8, then P11 (numeric nulls -> 0)."""
    d = encode_type(df)
    d = user_features(d)
    if train is None:
        d = merchant_features(d, order=order, prior=prior)
    else:
        d = prefix_scan(d, ["nameDest"], _merchant_order(order), position="merchant_frequency")
        d = merchant_risk_from_train(d, train)
    return fill_numeric_zero(d)


def fill_numeric_zero(df: DataFrame) -> DataFrame:
    """Null numeric values -> 0 (text columns are left alone)."""
    return df.na.fill(0)


# ----------------------------------------------------------------- online
def online_user_features(df: DataFrame, prob: Column | None = None, history: int = 100) -> DataFrame:
    """W10 ``burst`` (earlier txns of the user, capped) and W11 ``historical_risk_score``.

    W11 averages the model probability of the user's last ``history`` earlier
    rows; no probability counts as 0.0, as in the stream.  Both come from one
    prefix scan, whose recent sums reach back over at most ``history`` rows, so
    they lose no digits however many rows a user has.
    """
    recent = {} if prob is None else {"_p_sum": (prob, history)}
    d = prefix_scan(df, ["nameOrig"], [F.col("step"), F.col("row_id")], position="_upos", recent=recent)
    n_prev = F.least(F.col("_upos") - 1, F.lit(history))
    d = d.withColumn("burst", n_prev.cast("int"))
    if prob is not None:
        d = d.withColumn("historical_risk_score", F.when(n_prev > 0, F.col("_p_sum") / n_prev).otherwise(F.lit(0.0)))
    return d.drop("_upos", "_p_sum")


# ----------------------------------------------------------------- W14
def rolling_hour(df: DataFrame, key: str = "card_id", ts: str = "event_time", amount: str = "amount",
                 width_seconds: int = 3600) -> DataFrame:
    """Count and mean amount of the key's rows in [t - 1h, t].

    Rows are assigned to hour blocks and also copied into the next block as
    read-only "ghost" rows, so each (key, block) window sees everything within
    one hour before its rows.  Exact, and a hot card is split by hour.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w_us = width_seconds * 1_000_000
    d = df.withColumns({"_us": us, "_hb": F.floor(us / F.lit(w_us)).cast("long")})
    copies = F.explode(F.array(F.struct(F.lit(0).alias("g"), F.col("_hb").alias("b")),
                               F.struct(F.lit(1).alias("g"), (F.col("_hb") + 1).alias("b"))))
    d = d.select("*", copies.alias("_c")).select("*", F.col("_c.g").alias("_ghost"), F.col("_c.b").alias("_blk")).drop("_c")
    w = Window.partitionBy(key, "_blk").orderBy("_us").rangeBetween(-w_us, 0)
    d = d.withColumns({"txn_count_1h": F.count(F.lit(1)).over(w), "amount_mean_1h": F.avg(amount).over(w)})
    return d.filter(F.col("_ghost") == 0).drop("_us", "_hb", "_ghost", "_blk")
