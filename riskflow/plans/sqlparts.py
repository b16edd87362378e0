"""DuckDB SQL snippets shared by the oracle statements.

They restate the operators' meaning in plain SQL (plain windows, a recursive
CTE for the feedback fold), so they are an independent check of the Spark
plans, which are built differently (blocked windows, parallel fold).
"""
from riskflow.sources.views import EVENT_SQL, LEDGER_SQL, MESSAGES_SQL, SCORES_SQL  # noqa: F401


def heuristic_sql(merchant_term: str, burst: str = "burst", intents: str | None = None) -> str:
    urg = f"CASE WHEN list_contains({intents}, 'urgency') THEN 0.4e0 ELSE 0.0e0 END" if intents else "0.0e0"
    dep = f"CASE WHEN list_contains({intents}, 'depletion') THEN 0.3e0 ELSE 0.0e0 END" if intents else "0.0e0"
    return f"""least(1.0e0, ((((((((0.0e0
      + CASE WHEN amount > 1000000 THEN 0.8e0 WHEN amount > 500000 THEN 0.6e0 WHEN amount > 100000 THEN 0.4e0 ELSE 0.0e0 END)
      + CASE WHEN upper(type) IN ('TRANSFER', 'CASH_OUT') THEN 0.2e0 ELSE 0.0e0 END)
      + CASE WHEN oldbalanceOrg > 0 AND amount / oldbalanceOrg > 0.9e0 THEN 0.6e0 ELSE 0.0e0 END)
      + CASE WHEN {burst} > 3 THEN 0.5e0 WHEN {burst} > 1 THEN 0.3e0 ELSE 0.0e0 END)
      + {merchant_term})
      + {urg})
      + {dep})
      + 0.0e0))"""


def scored_ledger_ctes(ml_prob: str | None = None, base: list[str] | None = None, intents: str | None = None) -> list[str]:
    """CTEs ending in ``scored``: txn_ledger rows scored with the feedback fold.

    base: CTEs that end in a txn_ledger of their own; intents: its column of intents.
    """
    fin = (lambda h: f"(0.5e0 * ({ml_prob}) + 0.5e0 * {h})") if ml_prob else (lambda h: h)
    hs = heuristic_sql("0.0e0", intents=intents)
    hr = heuristic_sql("0.4e0", intents=intents)
    urgent = f"CASE WHEN list_contains({intents}, 'urgency') THEN 'Urgent social engineering markers' END," if intents else ""
    return [*(base or [LEDGER_SQL]), f"""
u AS (
  SELECT *, CAST(least(row_number() OVER (PARTITION BY nameOrig ORDER BY step, row_id) - 1, 100) AS INT) AS burst
  FROM txn_ledger
)""", f"""
m AS (
  SELECT row_id, nameDest,
         row_number() OVER (PARTITION BY nameDest ORDER BY step, row_id) AS mpos,
         CASE WHEN {fin(hr)} >= 0.6e0 THEN 1 ELSE 0 END AS hi_r,
         CASE WHEN {fin(hs)} >= 0.6e0 THEN 1 ELSE 0 END AS hi_s
  FROM u
)""", """
f AS (
  SELECT nameDest, mpos, [hi_s] AS hist, 0.0e0 AS risk, hi_s AS flag FROM m WHERE mpos = 1
  UNION ALL
  SELECT nameDest, mpos,
         CASE WHEN len(hist0) >= 100 THEN list_append(hist0[2:], flag) ELSE list_append(hist0, flag) END,
         risk, flag
  FROM (
    SELECT m.nameDest, m.mpos, f.hist AS hist0,
           CAST(list_sum(f.hist) AS DOUBLE) / len(f.hist) AS risk,
           CASE WHEN CAST(list_sum(f.hist) AS DOUBLE) / len(f.hist) > 0.2e0 THEN m.hi_r ELSE m.hi_s END AS flag
    FROM f JOIN m ON m.nameDest = f.nameDest AND m.mpos = f.mpos + 1
  ) x
)""", f"""
scored0 AS (
  SELECT u.*, f.risk AS merchant_risk,
         {heuristic_sql("CASE WHEN f.risk > 0.2e0 THEN 0.4e0 ELSE 0.0e0 END", intents=intents)} AS behavioral_score
  FROM u JOIN m ON u.row_id = m.row_id JOIN f ON f.nameDest = m.nameDest AND f.mpos = m.mpos
)""", f"""
scored AS (
  SELECT *, {fin("behavioral_score")} AS final_risk_score,
         CASE WHEN {fin("behavioral_score")} >= 0.6e0 THEN 'High' WHEN {fin("behavioral_score")} >= 0.3e0 THEN 'Medium' ELSE 'Low' END AS risk_level,
         CASE WHEN {fin("behavioral_score")} >= 0.6e0 THEN 'Restrict transaction' WHEN {fin("behavioral_score")} >= 0.3e0 THEN 'Verify identity' ELSE 'Allow' END AS action,
         CAST(trunc({fin("behavioral_score")} * 100) AS INT) AS confidence_score,
         array_to_string(list_filter([
            CASE WHEN amount > 500000 THEN 'Extreme transaction volume' END,
            CASE WHEN type IN ('TRANSFER', 'CASH_OUT') THEN 'High-risk transfer channel' END,
            CASE WHEN burst > 3 THEN 'Burst transaction pattern' END,
            CASE WHEN merchant_risk > 0.2e0 THEN 'Suspicious merchant activity' END, {urgent}
            CASE WHEN oldbalanceOrg > 0 AND amount / oldbalanceOrg > 0.9e0 THEN 'Balance depletion pattern' END
         ], lambda x: x IS NOT NULL), '|') AS indicators_text,
         CASE WHEN {fin("behavioral_score")} < 0.3e0 THEN 'Verified sender profile|Typical transaction volume'
              WHEN {fin("behavioral_score")} < 0.6e0 THEN 'Atypical transfer volume|Behavioral anomaly'
              WHEN oldbalanceOrg > 0 AND amount / oldbalanceOrg > 0.9e0
                   THEN 'Suspicious intent markers|Multiple risk triggers|Potential account takeover (ATO)'
              ELSE 'Suspicious intent markers|Multiple risk triggers' END AS reasons_text,
         CASE WHEN {fin("behavioral_score")} < 0.3e0 THEN 'Activity aligns with standard operational baselines.'
              WHEN {fin("behavioral_score")} < 0.6e0 THEN 'Unusual behavioral signature detected. Secondary review recommended.'
              ELSE 'High-risk indicators identified. Transaction restricted for security review.' END AS pattern_summary
  FROM scored0
)"""]
