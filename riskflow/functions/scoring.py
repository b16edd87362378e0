"""Hybrid rule-and-model risk scoring as column expressions.

The heuristic score is a sum of ``when`` terms added in a fixed order so the
double result is bit-identical to a sequential ``+=`` evaluation.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, thresholds, labels and texts of the scoring rules.
ML_WEIGHT = 0.5
HEURISTIC_WEIGHT = 0.5
RISK_THRESHOLD_MEDIUM = 0.30
RISK_THRESHOLD_HIGH = 0.60
LEVEL_HIGH, LEVEL_MEDIUM, LEVEL_LOW = "High", "Medium", "Low"
ACTION_HIGH, ACTION_MEDIUM, ACTION_LOW = "Restrict transaction", "Verify identity", "Allow"
MODE_HYBRID, MODE_HEURISTIC = "Hybrid", "Heuristic-Only"
IND_VOLUME = "Extreme transaction volume"
IND_CHANNEL = "High-risk transfer channel"
IND_BURST = "Burst transaction pattern"
IND_MERCHANT = "Suspicious merchant activity"
IND_URGENCY = "Urgent social engineering markers"
IND_DEPLETION = "Balance depletion pattern"
SUMMARY_LOW = "Activity aligns with standard operational baselines."
SUMMARY_MEDIUM = "Unusual behavioral signature detected. Secondary review recommended."
SUMMARY_HIGH = "High-risk indicators identified. Transaction restricted for security review."
REASONS_LOW = ["Verified sender profile", "Typical transaction volume"]
REASONS_MEDIUM = ["Atypical transfer volume", "Behavioral anomaly"]
REASONS_HIGH = ["Suspicious intent markers", "Multiple risk triggers"]
REASON_ATO = "Potential account takeover (ATO)"
REPLY_HIGH = ("This transaction shows high-risk indicators and has been flagged for manual review. "
              "Risk score: %d%%. Action: %s.")
REPLY_MEDIUM = "Unusual activity detected. Secondary verification is recommended. Action: %s."
REPLY_LOW = "Transaction verified against baseline patterns. No immediate risk identified."
HIGH_RISK_TYPES = ("TRANSFER", "CASH_OUT")
MERCHANT_RISK_CUTOFF = 0.2


def _has(intents: Column | None, name: str) -> Column:
    if intents is None:
        return F.lit(False)
    return F.coalesce(F.array_contains(intents, F.lit(name)), F.lit(False))


def depletion(amount: Column, old_balance: Column) -> Column:
    """Amount above 90% of a positive starting balance."""
    return F.coalesce((old_balance > 0) & (amount / old_balance > 0.9), F.lit(False))


def heuristic_terms(amount: Column, ttype: Column, old_balance: Column, burst: Column,
                    merchant_risk: Column, intents: Column | None = None,
                    is_night: Column | None = None) -> list[Column]:
    """The additive terms of F14, in evaluation order."""
    amt = F.coalesce(amount, F.lit(0.0))
    return [
        F.when(amt > 1000000, 0.8).when(amt > 500000, 0.6).when(amt > 100000, 0.4).otherwise(0.0),
        F.when(F.upper(ttype).isin(*HIGH_RISK_TYPES), 0.2).otherwise(0.0),
        F.when(depletion(amt, F.coalesce(old_balance, F.lit(0.0))), 0.6).otherwise(0.0),
        F.when(burst > 3, 0.5).when(burst > 1, 0.3).otherwise(0.0),
        F.when(merchant_risk > MERCHANT_RISK_CUTOFF, 0.4).otherwise(0.0),
        F.when(_has(intents, "urgency"), 0.4).otherwise(0.0),
        F.when(_has(intents, "depletion"), 0.3).otherwise(0.0),
        F.when(F.coalesce(is_night, F.lit(0)) == 1, 0.1).otherwise(0.0) if is_night is not None
        else F.lit(0.0),
    ]


def heuristic_score(*args, **kwargs) -> Column:
    """capped additive heuristic score."""
    total = F.lit(0.0)
    for t in heuristic_terms(*args, **kwargs):
        total = total + t
    return F.least(F.lit(1.0), total)


def final_score(h: Column, ml_prob: Column | None) -> Column:
    """hybrid blend when a model probability is present."""
    if ml_prob is None:
        return h
    return F.when(ml_prob.isNotNull(), F.lit(ML_WEIGHT) * ml_prob + F.lit(HEURISTIC_WEIGHT) * h).otherwise(h)


def scoring_mode(ml_prob: Column | None) -> Column:
    if ml_prob is None:
        return F.lit(MODE_HEURISTIC)
    return F.when(ml_prob.isNotNull(), F.lit(MODE_HYBRID)).otherwise(F.lit(MODE_HEURISTIC))


def risk_level(score: Column) -> Column:
    """F16 level on the unrounded score."""
    return (F.when(score >= RISK_THRESHOLD_HIGH, LEVEL_HIGH)
            .when(score >= RISK_THRESHOLD_MEDIUM, LEVEL_MEDIUM).otherwise(LEVEL_LOW))


def action(score: Column) -> Column:
    return (F.when(score >= RISK_THRESHOLD_HIGH, ACTION_HIGH)
            .when(score >= RISK_THRESHOLD_MEDIUM, ACTION_MEDIUM).otherwise(ACTION_LOW))


def indicators(amount: Column, ttype: Column, old_balance: Column, burst: Column,
               merchant_risk: Column, intents: Column | None = None) -> Column:
    """indicator texts in fixed order (channel test is case-sensitive)."""
    amt = F.coalesce(amount, F.lit(0.0))
    return F.array_compact(F.array(
        F.when(amt > 500000, F.lit(IND_VOLUME)),
        F.when(ttype.isin(*HIGH_RISK_TYPES), F.lit(IND_CHANNEL)),
        F.when(burst > 3, F.lit(IND_BURST)),
        F.when(merchant_risk > MERCHANT_RISK_CUTOFF, F.lit(IND_MERCHANT)),
        F.when(_has(intents, "urgency"), F.lit(IND_URGENCY)),
        F.when(depletion(amt, F.coalesce(old_balance, F.lit(0.0))), F.lit(IND_DEPLETION)),
    ))


def _lits(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def pattern_summary(score: Column) -> Column:
    """F18 summary text by score band."""
    return (F.when(score < RISK_THRESHOLD_MEDIUM, SUMMARY_LOW)
            .when(score < RISK_THRESHOLD_HIGH, SUMMARY_MEDIUM).otherwise(SUMMARY_HIGH))


def reasons(score: Column, amount: Column, old_balance: Column) -> Column:
    """F18 reasons by band; High plus depletion adds the takeover reason (max 3)."""
    amt = F.coalesce(amount, F.lit(0.0))
    high = F.when(depletion(amt, F.coalesce(old_balance, F.lit(0.0))),
                  _lits(REASONS_HIGH + [REASON_ATO])).otherwise(_lits(REASONS_HIGH))
    return F.slice(F.when(score < RISK_THRESHOLD_MEDIUM, _lits(REASONS_LOW))
                   .when(score < RISK_THRESHOLD_HIGH, _lits(REASONS_MEDIUM)).otherwise(high), 1, 3)


def confidence_score(score: Column) -> Column:
    """int(score*100), truncating."""
    return (score * 100).cast("int")


def percent_rounded(score: Column) -> Column:
    """Round-half-up percent, as the dashboards show it."""
    return F.floor(score * 100 + 0.5).cast("int")


def round4(x: Column) -> Column:
    """4-digit rounding of the presented scores."""
    return F.round(x, 4)


def reply_text(level: Column, score: Column, act: Column) -> Column:
    """chat reply by risk level."""
    return (F.when(level == LEVEL_HIGH, F.format_string(REPLY_HIGH, (score * 100).cast("int"), act))
            .when(level == LEVEL_MEDIUM, F.format_string(REPLY_MEDIUM, act))
            .otherwise(F.lit(REPLY_LOW)))


def record_id(seed: Column) -> Column:
    """12 upper-case hex characters; deterministic variant from a seed column."""
    return F.upper(F.substring(F.sha2(seed.cast("string"), 256), 1, 12))


def record_key(seed: Column) -> Column:
    """Full-width key under which the store tells records apart; record_id is its short, shown form."""
    return F.upper(F.sha2(seed.cast("string"), 256))


def random_record_id() -> Column:
    """F24 production variant: prefix of a random UUID."""
    return F.upper(F.substring(F.expr("uuid()"), 1, 12))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 UTC text with second precision."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
