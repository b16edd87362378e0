"""Transaction scoring with online behavioural state (W10-W12 + F14-F20, T9 batch form).

Order of work for a table of transactions (the serial order of the online
service is ``(step, row_id)``):

1. W10 ``burst`` and W11 ``historical_risk_score`` from the user's earlier rows;
2. the verdict with and without the merchant term, as two booleans;
3. W12 feedback fold per merchant -> ``merchant_risk`` of the row;
4. F14-F20: heuristic score, hybrid blend, level, action, indicators, reasons.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions import scoring as S
from riskflow.operators.feedback import feedback_fold
from riskflow.operators.features import online_user_features


def _total(terms: list[Column]) -> Column:
    t = F.lit(0.0)
    for x in terms:
        t = t + x
    return F.least(F.lit(1.0), t)


def score_transactions(df: DataFrame, ml_prob: str | None = None, intents: str | None = None,
                       night: str | None = None) -> DataFrame:
    """Score every row; adds burst, merchant_risk, behavioral_score, final score and texts."""
    prob = F.col(ml_prob) if ml_prob else None
    d = online_user_features(df, prob=prob)
    ints = F.col(intents) if intents else None
    nite = F.col(night) if night else None

    def terms(merchant: Column) -> list[Column]:
        return S.heuristic_terms(F.col("amount"), F.col("type"), F.col("oldbalanceOrg"), F.col("burst"),
                                 merchant, ints, nite)

    h_safe = _total(terms(F.lit(0.0)))
    h_risky = _total(terms(F.lit(1.0)))
    d = d.withColumns({
        "_hi_s": S.final_score(h_safe, prob) >= S.RISK_THRESHOLD_HIGH,
        "_hi_r": S.final_score(h_risky, prob) >= S.RISK_THRESHOLD_HIGH,
    })
    d = feedback_fold(d, "nameDest", "_hi_r", "_hi_s")
    d = d.withColumnRenamed("merchant_risk_online", "merchant_risk").drop("_hi_s", "_hi_r", "judged_high")
    h = _total(terms(F.col("merchant_risk")))
    final = S.final_score(h, prob)
    return d.withColumns({
        "behavioral_score": h,
        "final_risk_score": final,
        "scoring_mode": S.scoring_mode(prob),
        "risk_level": S.risk_level(final),
        "action": S.action(final),
        "indicators": S.indicators(F.col("amount"), F.col("type"), F.col("oldbalanceOrg"),
                                   F.col("burst"), F.col("merchant_risk"), ints),
        "reasons": S.reasons(final, F.col("amount"), F.col("oldbalanceOrg")),
        "pattern_summary": S.pattern_summary(final),
        "confidence_score": S.confidence_score(final),
    })
