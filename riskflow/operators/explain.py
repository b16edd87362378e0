"""Per-prediction explanations.

Contributions are exact for a linear model: ``coef_i * (x_i - mean_i)``.  The
top-N reasons of a row are computed from its own contribution array
(filter > 0, sort by |value| desc, slice) - no shuffle.  Global importance is
a grouped mean over the long form.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reason texts by feature, default text, number of reasons.
REASON_CODES = {
    "txn_count": "High transaction frequency for this user increases fraud risk",
    "amt_sum": "Unusually high cumulative spending by this user",
    "amt_mean": "High average transaction amount detected",
    "velocity": "High transaction amount relative to account balance",
    "time_gap": "Recent transactions occurring in rapid succession",
    "unique_merchants": "User interacting with a high number of distinct merchants",
    "merchant_frequency": "Merchant has an unusually high volume of transactions",
    "merchant_risk": "Merchant has a high historical fraud rate",
    "amount": "High transaction amount increases fraud risk",
    "oldbalanceOrg": "Originating account balance is unusual for this transaction",
    "is_burst": "Transaction is part of a high-frequency burst",
}
DEFAULT_REASON = "Suspicious behavioral pattern detected"
TOP_N = 5


def reason_text(feature: Column, contribution: Column) -> Column:
    """reason for a feature, only for positive contributions."""
    m = F.create_map(*[x for k, v in REASON_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.when(contribution > 0, F.coalesce(F.try_element_at(m, feature), F.lit(DEFAULT_REASON)))


def linear_contributions(df: DataFrame, coef: dict[str, float], means: dict[str, float] | DataFrame) -> Column:
    """array<struct<feature, value>> of coef * (x - mean) in feature order."""
    items = []
    for f, c in coef.items():
        mean = F.col(f"_mean_{f}") if isinstance(means, DataFrame) else F.lit(float(means[f]))
        items.append(F.struct(F.lit(f).alias("feature"),
                              (F.lit(float(c)) * (F.col(f).cast("double") - mean)).alias("value")))
    return F.array(*items)


def with_means(df: DataFrame, features: list[str]) -> DataFrame:
    """Attach feature means (a one-row aggregate, broadcast) as ``_mean_<f>`` columns."""
    m = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"_mean_{f}") for f in features])
    return df.crossJoin(F.broadcast(m))


def top_reasons(contribs: Column, n: int = TOP_N) -> Column:
    """Positive contributions by |value| desc (feature name breaks ties), first n, with reason text."""
    pos = F.filter(contribs, lambda s: s["value"] > 0)

    def cmp(a, b):
        return (F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    top = F.slice(F.array_sort(pos, cmp), 1, n)
    return F.transform(top, lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"),
                                               reason_text(s["feature"], s["value"]).alias("reason")))


def long_contributions(df: DataFrame, id_col: str, contribs: str = "contribs") -> DataFrame:
    """(id, feature, contribution) long form."""
    return df.select(id_col, F.explode(contribs).alias("_c")).select(
        id_col, F.col("_c.feature").alias("feature"), F.col("_c.value").alias("contribution"))


def global_importance(long: DataFrame) -> DataFrame:
    """Mean |contribution| per feature."""
    return long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def audit_rows(df: DataFrame, id_col: str, prob: Column, contribs: str = "contribs",
               ts: Column | None = None) -> DataFrame:
    """Id, time, probability, top reasons JSON and all contributions JSON."""
    t = ts if ts is not None else F.current_timestamp()
    return df.select(
        F.col(id_col).alias("txn_id"), t.alias("ts"), prob.alias("fraud_prob"),
        F.to_json(top_reasons(F.col(contribs))).alias("top_reasons"),
        F.to_json(F.map_from_entries(F.col(contribs))).alias("shap_json"))
