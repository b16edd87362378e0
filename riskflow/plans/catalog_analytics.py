"""Registered queries: drift monitoring and model-evaluation metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators import drift as DR
from riskflow.operators import features as FE
from riskflow.operators import metrics as ME
from riskflow.plans.registry import query
from riskflow.sources.views import LEDGER_SQL, SCORES_SQL, scores, txn_ledger, with_sql

DRIFT_CUTOFF_STEP = 28000
DRIFT_FACTOR = 1.5


def drift_frames(spark: SparkSession, sf: str, drifting: bool = False,
                 with_features: bool = True) -> tuple[DataFrame, DataFrame]:
    led = txn_ledger(spark, sf)
    feats = led.withColumn("velocity", F.try_divide(F.col("amount"), F.col("oldbalanceOrg") + 1))
    if with_features:
        feats = FE.merchant_features(feats)
    ref = feats.filter(F.col("step") < DRIFT_CUTOFF_STEP)
    cur = feats.filter(F.col("step") >= DRIFT_CUTOFF_STEP)
    if drifting:
        cur = cur.withColumn("amount", F.col("amount") * DRIFT_FACTOR)
    return ref, cur


def feat_sql(drifting: bool) -> str:
    amt = f"amount * {DRIFT_FACTOR}e0" if drifting else "amount"
    return f"""
feat AS (
  SELECT CASE WHEN step < {DRIFT_CUTOFF_STEP} THEN 'e' ELSE 'a' END AS sample,
         CASE WHEN step < {DRIFT_CUTOFF_STEP} THEN amount ELSE {amt} END AS amount,
         amount / (oldbalanceOrg + 1) AS velocity,
         (coalesce(sum(isFraud) OVER (PARTITION BY nameDest ORDER BY nameOrig, step, row_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 10e0 * g)
           / ((row_number() OVER (PARTITION BY nameDest ORDER BY nameOrig, step, row_id) - 1) + 10e0) AS merchant_risk,
         isFraud, type, step, oldbalanceOrg, newbalanceOrig
  FROM txn_ledger, (SELECT avg(isFraud) AS g FROM txn_ledger) gm
)"""


PSI_CTES = """
long AS (
  SELECT sample, feature, value FROM (
    SELECT sample, 'amount' AS feature, amount AS value FROM feat
    UNION ALL SELECT sample, 'velocity', velocity FROM feat
    UNION ALL SELECT sample, 'merchant_risk', merchant_risk FROM feat) WHERE value IS NOT NULL
)""", """
ranked AS (
  SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS k,
         count(*) OVER (PARTITION BY feature) AS n
  FROM long WHERE sample = 'e'
)""", """
probs AS (SELECT * FROM (VALUES (0, 0.0e0), (1, 0.1e0), (2, 0.2e0), (3, 0.3e0), (4, 0.4e0), (5, 0.5e0),
                                (6, 0.6e0), (7, 0.7e0), (8, 0.8e0), (9, 0.9e0), (10, 1.0e0)) t(i, p))""", """
tgt AS (
  SELECT feature, i, (n - 1) * p AS pos, n FROM (SELECT DISTINCT feature, n FROM ranked) r, probs
)""", """
edges AS (
  SELECT t.feature, t.i,
         CASE WHEN t.pos - floor(t.pos) < 0.5 THEN lo.value + (hi.value - lo.value) * (t.pos - floor(t.pos))
              ELSE hi.value - (hi.value - lo.value) * (1 - (t.pos - floor(t.pos))) END AS q
  FROM tgt t
  JOIN ranked lo ON lo.feature = t.feature AND lo.k = floor(t.pos) + 1
  JOIN ranked hi ON hi.feature = t.feature AND hi.k = least(floor(t.pos) + 2, t.n)
)""", """
inner_edges AS (SELECT feature, list(q ORDER BY i) AS inner FROM edges WHERE i > 0 AND i < 10 GROUP BY feature)""", """
binned AS (
  SELECT l.sample, l.feature, len(list_filter(e.inner, lambda x: x <= l.value)) AS bin
  FROM long l JOIN inner_edges e ON l.feature = e.feature
)""", """
cnt AS (SELECT sample, feature, bin, count(*) AS c FROM binned GROUP BY ALL)""", """
tot AS (SELECT sample, feature, count(*) AS n FROM binned GROUP BY ALL)""", """
grid AS (SELECT feature, s.sample, b.bin FROM inner_edges, (VALUES ('e'), ('a')) s(sample), range(10) b(bin))""", """
share AS (
  SELECT g.feature, g.sample, g.bin,
         CASE WHEN coalesce(c.c, 0) = 0 THEN 1e-8 ELSE c.c / t.n END AS s
  FROM grid g LEFT JOIN cnt c USING (feature, sample, bin) LEFT JOIN tot t USING (feature, sample)
)""", """
psi AS (
  SELECT e.feature, sum((a.s - e.s) * ln(a.s / e.s)) AS psi
  FROM share e JOIN share a ON e.feature = a.feature AND e.bin = a.bin AND e.sample = 'e' AND a.sample = 'a'
  GROUP BY e.feature
)"""


def psi_sql(body: str, drifting: bool = False) -> str:
    return with_sql(LEDGER_SQL, feat_sql(drifting), *PSI_CTES, body=body)


STATUS_SQL = """SELECT feature, round(psi, 6) AS psi,
  CASE WHEN round(psi, 6) < 0.1 THEN 'green' WHEN round(psi, 6) < 0.25 THEN 'amber' ELSE 'red' END AS color,
  CASE WHEN round(psi, 6) < 0.1 THEN 'STABLE' WHEN round(psi, 6) < 0.25 THEN 'WARNING' ELSE 'DRIFT DETECTED' END AS status
FROM psi"""


def _status(drifting: bool):
    def fn(spark, sf):
        ref, cur = drift_frames(spark, sf, drifting)
        return DR.drift_status(DR.psi_by_feature(ref, cur))
    return fn


query("A8_psi_single_column", sql=psi_sql(STATUS_SQL + " WHERE feature = 'amount'"))(
    lambda spark, sf: DR.drift_status(DR.psi_by_feature(*drift_frames(spark, sf, False, with_features=False), ["amount"])))
query("A9_psi_monitored_features", sql=psi_sql(STATUS_SQL))(_status(False))
query("A9_psi_drifting_amount", sql=psi_sql(STATUS_SQL, drifting=True))(_status(True))
query("F23_psi_status", sql=psi_sql(STATUS_SQL, drifting=True))(_status(True))
query("S13_drift_status_table", sql=psi_sql(STATUS_SQL))(_status(False))


@query("A10_drift_decision", sql=psi_sql("""
SELECT coalesce(max(round(psi, 6)), 0e0) AS max_psi, coalesce(max(round(psi, 6)), 0e0) >= 0.25 AS retrain,
       CASE WHEN coalesce(max(round(psi, 6)), 0e0) >= 0.25 THEN 'PSI threshold breached'
            ELSE 'All PSI scores below threshold' END AS reason
FROM psi""", drifting=True))
def q_a10(spark, sf):
    ref, cur = drift_frames(spark, sf, True)
    return DR.drift_decision(DR.psi_by_feature(ref, cur)).drop("psi_scores")


QUALITY_COLS = ["amount", "velocity", "merchant_risk", "oldbalanceOrg"]


@query("A19_data_quality_profile", sql=with_sql(LEDGER_SQL, feat_sql(True), """
lf AS (
  SELECT sample, 'amount' AS col, amount AS v FROM feat UNION ALL SELECT sample, 'velocity', velocity FROM feat
  UNION ALL SELECT sample, 'merchant_risk', merchant_risk FROM feat
  UNION ALL SELECT sample, 'oldbalanceOrg', oldbalanceOrg FROM feat
)""", """
prof AS (
  SELECT col, sample, count(*) AS rows, count(*) FILTER (WHERE v IS NULL) AS nulls, min(v) AS mn, max(v) AS mx,
         avg(v) AS mean, stddev_samp(v) AS sd FROM lf GROUP BY ALL
)""", body="""
SELECT p.col AS "column", CASE p.sample WHEN 'e' THEN 'reference' ELSE 'current' END AS sample, p.rows, p.nulls,
       round(p.mn, 6) AS min, round(p.mx, 6) AS max, round(p.mean, 6) AS mean, round(p.sd, 6) AS stddev,
       CASE WHEN p.sample = 'a' THEN (SELECT count(*) FROM lf l WHERE l.sample = 'a' AND l.col = p.col
                                      AND (l.v < r.mn OR l.v > r.mx)) ELSE 0 END AS out_of_range
FROM prof p JOIN prof r ON r.col = p.col AND r.sample = 'e'"""))
def q_a19(spark, sf):
    ref, cur = drift_frames(spark, sf, True)
    q = DR.quality_profile(ref, cur, QUALITY_COLS)
    return q.select("column", "sample", "rows", "nulls", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean",
                                                                                           "stddev")],
                    "out_of_range")


@query("A20_target_drift", sql=with_sql(LEDGER_SQL, feat_sql(False), """
r AS (SELECT avg(isFraud) FILTER (WHERE sample = 'e') AS e1, avg(isFraud) FILTER (WHERE sample = 'a') AS a1 FROM feat)""",
                                        body="""
SELECT round(e1, 6) AS rate_reference, round(a1, 6) AS rate_current, round(a1 - e1, 6) AS rate_change,
       round(((1 - a1) - (1 - e1)) * ln((1 - a1) / (1 - e1)) + (a1 - e1) * ln(a1 / e1), 6) AS target_psi
FROM r"""))
def q_a20(spark, sf):
    ref, cur = drift_frames(spark, sf, False, with_features=False)
    t = DR.target_drift(ref, cur)
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


#: the shared columns of both samples: numeric ones, and the category
NUMERIC_COLUMNS = ["amount", "velocity", "merchant_risk", "isFraud", "step", "oldbalanceOrg", "newbalanceOrig"]
ALL_LONG = "long AS (SELECT sample, feature, value FROM (" + " UNION ALL ".join(
    f"SELECT sample, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for c in NUMERIC_COLUMNS) + ") WHERE value IS NOT NULL)"
TYPE_PSI = """
sh AS (SELECT type AS cat, count(*) FILTER (WHERE sample = 'e') / (SELECT count(*) FROM feat WHERE sample = 'e') AS e,
              count(*) FILTER (WHERE sample = 'a') / (SELECT count(*) FROM feat WHERE sample = 'a') AS a FROM feat GROUP BY type)""", """
every AS (SELECT feature, 'numeric' AS kind, round(psi, 6) AS psi FROM psi UNION ALL
          SELECT 'type', 'categorical', round(sum((CASE WHEN a = 0 THEN 1e-8 ELSE a END - CASE WHEN e = 0 THEN 1e-8 ELSE e END)
                 * ln(CASE WHEN a = 0 THEN 1e-8 ELSE a END / CASE WHEN e = 0 THEN 1e-8 ELSE e END)), 6) FROM sh)"""


@query("A21_drift_all_columns", sql=with_sql(LEDGER_SQL, feat_sql(True), ALL_LONG, *PSI_CTES[1:], *TYPE_PSI,
                                             body=STATUS_SQL.replace("FROM psi", "FROM every").replace("SELECT feature,", "SELECT feature, kind,")))
def q_a21_all(spark, sf):
    ref, cur = drift_frames(spark, sf, True)
    return DR.drift_check(ref, cur, [*NUMERIC_COLUMNS, "type"])


@query("A21_column_drift_categorical", sql=with_sql(LEDGER_SQL, feat_sql(False), """
sh AS (
  SELECT type AS cat, count(*) FILTER (WHERE sample = 'e') / (SELECT count(*) FROM feat WHERE sample = 'e') AS e,
         count(*) FILTER (WHERE sample = 'a') / (SELECT count(*) FROM feat WHERE sample = 'a') AS a
  FROM feat GROUP BY type
)""", body="""
SELECT 'type' AS feature, round(sum((CASE WHEN a = 0 THEN 1e-8 ELSE a END - CASE WHEN e = 0 THEN 1e-8 ELSE e END)
       * ln(CASE WHEN a = 0 THEN 1e-8 ELSE a END / CASE WHEN e = 0 THEN 1e-8 ELSE e END)), 6) AS psi FROM sh"""))
def q_a21(spark, sf):
    ref, cur = drift_frames(spark, sf, False, with_features=False)
    return DR.category_psi(ref, cur, "type").select("feature", F.round("psi", 6).alias("psi"))


# ------------------------------------------------------------ metrics
def _curve(spark, sf):
    return ME.curve(scores(spark, sf))


CURVE_CTES = [LEDGER_SQL, SCORES_SQL, """
g AS (SELECT prob AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
      FROM scores GROUP BY prob)""", """
c AS (
  SELECT score, pos, neg,
         sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
         sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
         sum(pos) OVER () AS P, sum(neg) OVER () AS N
  FROM g
)""", """
pts AS (
  SELECT score AS threshold, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P ELSE 1e0 END AS recall FROM c
  UNION ALL SELECT NULL, 1e0, 0e0
)"""]


@query("A7_class_balance", sql=with_sql(LEDGER_SQL, SCORES_SQL, body="""
SELECT round(coalesce(CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE y = 1), 0), 1e0), 6)
       AS scale_pos_weight FROM scores"""))
def q_a7(spark, sf):
    return ME.class_balance(scores(spark, sf)).select(F.round("scale_pos_weight", 6).alias("scale_pos_weight"))


@query("A11_average_precision", sql=with_sql(*CURVE_CTES, body="""
SELECT round(sum(CASE WHEN P > 0 THEN pos / P ELSE 0e0 END * (tp / (tp + fp))), 6) AS pr_auc FROM c"""))
def q_a11(spark, sf):
    return ME.average_precision(_curve(spark, sf)).select(F.round("pr_auc", 6).alias("pr_auc"))


@query("A12_roc_auc", sql=with_sql(*CURVE_CTES, body="""
SELECT round(sum(neg * ((tp - pos) + pos / 2e0)) / (max(P) * max(N)), 6) AS roc_auc FROM c"""))
def q_a12(spark, sf):
    return ME.roc_auc(_curve(spark, sf)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("A13_precision_recall_f1", sql=with_sql(LEDGER_SQL, SCORES_SQL, """
k AS (SELECT count(*) FILTER (WHERE prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND y <> 1) AS fp,
             count(*) FILTER (WHERE prob < 0.5 AND y = 1) AS fn FROM scores)""", """
m AS (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS p,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS r FROM k)""", body="""
SELECT 0.5e0 AS threshold, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END, 6) AS f1 FROM m"""))
def q_a13(spark, sf):
    d = ME.at_threshold(scores(spark, sf), 0.5)
    return d.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("A14_class_report", sql=with_sql(LEDGER_SQL, SCORES_SQL, """
k AS (SELECT count(*) FILTER (WHERE prob >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND y <> 1) AS fp,
             count(*) FILTER (WHERE prob < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE prob < 0.5 AND y <> 1) AS tn
      FROM scores)""", """
cls AS (SELECT 'Fraud' AS class, tp AS a, fp AS b, fn AS c FROM k UNION ALL SELECT 'Legit', tn, fn, fp FROM k)""", """
m AS (SELECT class, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0e0 END AS p,
             CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0e0 END AS r, a + c AS support FROM cls)""", body="""
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END, 6) AS f1, support FROM m"""))
def q_a14(spark, sf):
    d = ME.class_report(scores(spark, sf), 0.5)
    return d.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("A15_pr_curve", sql=with_sql(*CURVE_CTES, body="""
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pts"""))
def q_a15(spark, sf):
    p = ME.pr_curve(_curve(spark, sf))
    return p.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("A16_best_threshold", sql=with_sql(*CURVE_CTES, """
flags AS (
  SELECT *, recall >= 0.9 AND recall <= 0.95 AS in_r, precision >= 0.7 AND precision <= 0.85 AS in_p,
         2 * (precision * recall) / (precision + recall + 1e-8) AS f1,
         coalesce(threshold, 'inf'::DOUBLE) AS ord
  FROM pts
)""", """
pick AS (
  SELECT * FROM flags
  WHERE CASE WHEN (SELECT bool_or(in_r AND in_p) FROM flags) THEN in_r AND in_p
             WHEN (SELECT bool_or(in_r) FROM flags) THEN in_r ELSE true END
  ORDER BY CASE WHEN (SELECT bool_or(in_r) FROM flags) THEN precision ELSE f1 END DESC, ord ASC
  LIMIT 1
)""", body="""
SELECT least(coalesce(threshold, 0.5e0), 0.8e0) AS threshold, round(precision, 6) AS precision,
       round(recall, 6) AS recall,
       CASE WHEN (SELECT bool_or(in_r AND in_p) FROM flags) THEN 'preferred'
            WHEN (SELECT bool_or(in_r) FROM flags) THEN 'recall_range' ELSE 'f1_fallback' END AS rule
FROM pick"""))
def q_a16(spark, sf):
    b = ME.best_threshold(_curve(spark, sf))
    return b.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    "rule")
