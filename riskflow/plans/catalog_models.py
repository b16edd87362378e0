"""Registered queries: explanations and MLlib training / scoring."""
from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions import rowfeatures as RF
from riskflow.operators import ensemble as EN
from riskflow.operators import explain as EX
from riskflow.operators import features as FE
from riskflow.operators import metrics as ME
from riskflow.operators import ml as ML
from riskflow.operators import registry as RG
from riskflow.operators import sequences as SQ
from riskflow.plans.registry import query
from riskflow.session import scratch_path
from riskflow.sources.views import LEDGER_SQL, ML_PROB_SQL, ml_prob_standin, txn_ledger, with_sql

# Stand-in linear model (deterministic, so the explanation queries have an oracle).
EXPLAIN_COEF = {"amount": 1e-6, "oldbalanceOrg": -1e-7, "velocity": 0.5, "merchant_risk": 4.0}
SPLIT_STEP = 28000


def explained(spark, sf):
    led = FE.merchant_features(txn_ledger(spark, sf))
    led = led.withColumn("velocity", RF.velocity(F.col("amount"), F.col("oldbalanceOrg")))
    d = EX.with_means(led, list(EXPLAIN_COEF))
    return d.withColumn("contribs", EX.linear_contributions(d, EXPLAIN_COEF, d))


EXPLAIN_CTES = [LEDGER_SQL, """
feat AS (
  SELECT row_id, amount, oldbalanceOrg, amount / (oldbalanceOrg + 1) AS velocity,
         (coalesce(sum(isFraud) OVER (PARTITION BY nameDest ORDER BY nameOrig, step, row_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 10e0 * g)
           / ((row_number() OVER (PARTITION BY nameDest ORDER BY nameOrig, step, row_id) - 1) + 10e0) AS merchant_risk
  FROM txn_ledger, (SELECT avg(isFraud) AS g FROM txn_ledger) gm
)""", """
mu AS (SELECT avg(amount) AS m_amount, avg(oldbalanceOrg) AS m_bal, avg(velocity) AS m_vel, avg(merchant_risk) AS m_mr
       FROM feat)""", """
contrib AS (
  SELECT row_id, feature, c FROM (
    SELECT row_id, 'amount' AS feature, 1e-6 * (amount - m_amount) AS c FROM feat, mu
    UNION ALL SELECT row_id, 'oldbalanceOrg', -1e-7 * (oldbalanceOrg - m_bal) FROM feat, mu
    UNION ALL SELECT row_id, 'velocity', 0.5e0 * (velocity - m_vel) FROM feat, mu
    UNION ALL SELECT row_id, 'merchant_risk', 4.0e0 * (merchant_risk - m_mr) FROM feat, mu)
)""", """
reason_map AS (SELECT * FROM (VALUES
  ('amount', 'High transaction amount increases fraud risk'),
  ('oldbalanceOrg', 'Originating account balance is unusual for this transaction'),
  ('velocity', 'High transaction amount relative to account balance'),
  ('merchant_risk', 'Merchant has a high historical fraud rate')) t(feature, reason))""", """
top AS (
  SELECT row_id, feature, c, row_number() OVER (PARTITION BY row_id ORDER BY abs(c) DESC, feature) AS rn
  FROM contrib WHERE c > 0
)""", """
ranked AS (SELECT row_id, feature, c, rn FROM top WHERE rn <= 5)"""]

TOP_BODY = """
SELECT f.row_id, coalesce(string_agg(r.feature, '|' ORDER BY r.rn), '') AS top_features,
       coalesce(string_agg(m.reason, '|' ORDER BY r.rn), '') AS top_reason_texts
FROM feat f LEFT JOIN ranked r ON r.row_id = f.row_id LEFT JOIN reason_map m ON m.feature = r.feature
GROUP BY f.row_id"""


def _top(spark, sf):
    d = explained(spark, sf).withColumn("_top", EX.top_reasons(F.col("contribs")))
    return d.select("row_id", F.array_join(F.transform("_top", lambda s: s["feature"]), "|").alias("top_features"),
                    F.array_join(F.transform("_top", lambda s: s["reason"]), "|").alias("top_reason_texts"))


query("W13_top_reasons", sql=with_sql(*EXPLAIN_CTES, body=TOP_BODY))(_top)
query("F21_reason_codes", sql=with_sql(*EXPLAIN_CTES, body=TOP_BODY))(_top)


@query("M10_linear_contributions", sql=with_sql(*EXPLAIN_CTES, body="""
SELECT row_id, feature, round(c, 6) AS contribution FROM contrib"""))
def q_m10(spark, sf):
    lf = EX.long_contributions(explained(spark, sf), "row_id")
    return lf.select("row_id", "feature", F.round("contribution", 6).alias("contribution"))


@query("A22_global_importance", sql=with_sql(*EXPLAIN_CTES, body="""
SELECT feature, round(avg(abs(c)), 6) AS mean_abs_contribution FROM contrib GROUP BY feature"""))
def q_a22(spark, sf):
    g = EX.global_importance(EX.long_contributions(explained(spark, sf), "row_id"))
    return g.select("feature", F.round("mean_abs_contribution", 6).alias("mean_abs_contribution"))


@query("S10_explanation_audit", sql=with_sql(*EXPLAIN_CTES, body=f"""
SELECT f.row_id AS txn_id, round(((f.row_id * 37) % 1000) / 1000e0, 6) AS fraud_prob,
       coalesce((SELECT string_agg(r.feature, '|' ORDER BY r.rn) FROM ranked r WHERE r.row_id = f.row_id), '')
         AS top_features
FROM feat f"""))
def q_s10(spark, sf):
    d = explained(spark, sf)
    a = EX.audit_rows(d, "row_id", ml_prob_standin(F.col("row_id")))
    top = F.from_json("top_reasons", "array<struct<feature:string,value:double,reason:string>>")
    return a.select("txn_id", F.round("fraud_prob", 6).alias("fraud_prob"),
                    F.array_join(F.transform(top, lambda s: s["feature"]), "|").alias("top_features"))


# ------------------------------------------------------------ ML
@query("M1_standard_scaling", sql=with_sql(LEDGER_SQL, body="""
SELECT row_id,
       round(CASE WHEN stddev_pop(amount) OVER () > 0 THEN (amount - avg(amount) OVER ()) / stddev_pop(amount) OVER ()
             ELSE 0 END, 6) AS amount,
       round(CASE WHEN stddev_pop(oldbalanceOrg) OVER () > 0
             THEN (oldbalanceOrg - avg(oldbalanceOrg) OVER ()) / stddev_pop(oldbalanceOrg) OVER () ELSE 0 END, 6)
         AS oldbalanceOrg
FROM txn_ledger"""))
def q_m1(spark, sf):
    s = ML.standard_scale(txn_ledger(spark, sf).select("row_id", "amount", "oldbalanceOrg"),
                          ["amount", "oldbalanceOrg"])
    return s.select("row_id", F.round("amount", 6).alias("amount"), F.round("oldbalanceOrg", 6).alias("oldbalanceOrg"))


FOLD_SQL = with_sql(LEDGER_SQL, """
f AS (SELECT isFraud, CAST((row_number() OVER (PARTITION BY isFraud ORDER BY row_id) - 1) % 5 AS INT) AS fold
      FROM txn_ledger)""", body="""
SELECT isFraud, fold, count(*) AS n FROM f GROUP BY ALL""")


@query("M4_fold_sizes", sql=FOLD_SQL)
def q_m4(spark, sf):
    f = ML.stratified_folds(txn_ledger(spark, sf))
    return f.groupBy("isFraud", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("M7_class_weights", sql=with_sql(LEDGER_SQL, body="""
SELECT isFraud, round(CASE WHEN isFraud = 1 THEN least(1e0 / n1, 10e0 / n0) ELSE 1e0 / n0 END, 12) AS weight, count(*) AS n
FROM txn_ledger, (SELECT count(*) FILTER (WHERE isFraud = 0) AS n0, count(*) FILTER (WHERE isFraud = 1) AS n1
                  FROM txn_ledger) c
GROUP BY ALL"""))
def q_m7(spark, sf):
    w = ML.class_weights(txn_ledger(spark, sf))
    return w.groupBy("isFraud", F.round("weight", 12).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


BASE_PROBS_SQL = f"""
base_probs AS (
  SELECT row_id, {ML_PROB_SQL} AS p_tab,
         CASE WHEN row_id % 4 = 0 THEN NULL ELSE ((row_id * 53) % 1000) / 1000e0 END AS p_seq, isFraud AS y
  FROM txn_ledger
)"""


def base_probs(spark, sf):
    led = txn_ledger(spark, sf)
    p_seq = F.when(F.col("row_id") % 4 == 0, F.lit(None)).otherwise((F.col("row_id") * 53 % 1000) / F.lit(1000.0))
    return led.select("row_id", ml_prob_standin(F.col("row_id")).alias("p_tab"), p_seq.alias("p_seq"),
                      F.col("isFraud").alias("y"))


@query("F30_meta_features", sql=with_sql(LEDGER_SQL, BASE_PROBS_SQL, body="""
SELECT row_id, round(p_tab, 6) AS p_tab, round(coalesce(p_seq, (SELECT coalesce(avg(p_seq), 0.5) FROM base_probs)), 6)
       AS p_seq_filled, CAST(p_seq IS NULL AS DOUBLE) AS p_seq_missing
FROM base_probs"""))
def q_f30(spark, sf):
    m = ML.meta_features(base_probs(spark, sf))
    return m.select("row_id", F.round("p_tab", 6).alias("p_tab"), F.round("p_seq_filled", 6).alias("p_seq_filled"),
                    "p_seq_missing")


@query("A17_mean_ignoring_missing", sql=with_sql(LEDGER_SQL, BASE_PROBS_SQL, body="""
SELECT round(coalesce(avg(p_seq), 0.5), 6) AS p_seq_mean FROM base_probs"""))
def q_a17(spark, sf):
    return base_probs(spark, sf).agg(F.round(ME.mean_ignoring_missing("p_seq"), 6).alias("p_seq_mean"))


def _model_columns(spark, sf):
    """Model features by event order, with the training rows' fraud rate: no row knows a later one."""
    from riskflow.functions.rowfeatures import model_extras
    led = txn_ledger(spark, sf)
    c = F.col
    d = FE.all_features(led, order="event", prior=led.filter(c("step") <= SPLIT_STEP)).select("*", *model_extras(c("step"), c("type"), c("amount"), c("oldbalanceOrg"),
                                                       c("newbalanceOrig"), c("oldbalanceDest"), c("newbalanceDest")))
    d = d.withColumn("burst", F.least(F.col("txn_count") - 1, F.lit(100)))
    return d.withColumn("is_night", (c("step") % 24).between(0, 5).cast("int"))


def _model_frame(spark, sf):
    return ML.assemble(_model_columns(spark, sf))


VECTOR_SQL = with_sql(LEDGER_SQL, f"""
v AS (SELECT *, row_number() OVER u AS txn_count, sum(amount) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS amt_sum,
        coalesce(step - lag(step) OVER u, 0) AS time_gap, (coalesce(sum(isFraud) OVER (m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 10e0 * g)
          / ((row_number() OVER m - 1) + 10e0) AS merchant_risk
      FROM txn_ledger, (SELECT avg(isFraud) AS g FROM txn_ledger WHERE step <= {SPLIT_STEP}) gm
      WINDOW u AS (PARTITION BY nameOrig ORDER BY step, row_id), m AS (PARTITION BY nameDest ORDER BY step, row_id))""", body="""
SELECT row_id, 18 AS size, round(amount + oldbalanceOrg + newbalanceOrig + oldbalanceDest + newbalanceDest + step
         + CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3 WHEN 'TRANSFER' THEN 4 ELSE -1 END
         + txn_count + amt_sum + amount / (oldbalanceOrg + 1) + least(txn_count - 1, 100) + time_gap + merchant_risk
         + (oldbalanceOrg - newbalanceOrig) + (newbalanceDest - oldbalanceDest)
         + CAST(abs((oldbalanceOrg - newbalanceOrig) - amount) > 0.01e0 AS INT) + step % 24
         + CAST(step % 24 BETWEEN 0 AND 5 AS INT), 3) AS vector_sum
FROM v""")


@query("F28_model_vector", sql=VECTOR_SQL)
def q_f28(spark, sf):
    d = _model_frame(spark, sf)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    return d.select("row_id", F.size(arr).alias("size"),
                    F.round(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), 3).alias("vector_sum"))


@query("M3_gbt_train_score")
def q_m3(spark, sf):
    d = _model_frame(spark, sf)
    train = d.filter(F.col("step") <= SPLIT_STEP).withColumn(
        "is_val", (F.xxhash64("row_id") % 5 == 0))
    test = d.filter(F.col("step") > SPLIT_STEP)
    model = ML.train_gbt(train, validation="is_val")
    return ML.score(model, test, "ml_prob").select("row_id", "isFraud", F.round("ml_prob", 6).alias("ml_prob"))


def _fit_assembled(train):
    return ML.train_gbt(train, one_stage=True)


def _fit_folds(d, k):
    return ML.train_gbt(d, folds=("fold", k))


def _score_assembled(model, d):
    return ML.score(model, d, "p_tab").drop("features")


def _fit_gbt(train):
    return _fit_assembled(ML.assemble(train))


def _score_gbt(model, d):
    return _score_assembled(model, ML.assemble(d))


@query("M4_out_of_fold", sql=with_sql(LEDGER_SQL, body="SELECT row_id, 1::BIGINT AS times, TRUE AS in_range FROM txn_ledger"))
def q_m4_oof(spark, sf):
    """Out-of-fold probabilities of the boosted trees: every row once, by the model that did not see it."""
    d, _ = EN.out_of_fold(_model_columns(spark, sf).select("row_id", "isFraud", *ML.MODEL_FEATURES), _fit_assembled, _score_assembled,
                          prepare=lambda d: ML.assemble(d).select("row_id", "isFraud", "fold", "features"), fit_folds=_fit_folds)
    return d.groupBy("row_id").agg(F.count(F.lit(1)).alias("times"), F.min(F.col("p_tab").between(0, 1)).alias("in_range"))


#: a third of the rounds of the registered early-stopping curve
FOLD_ROUNDS = 10


@query("M3_early_stopping")
def q_m3_stop(spark, sf):
    """PR-AUC of every round on a held-out fifth of the training rows, and the round that is kept."""
    d = _model_frame(spark, sf).filter(F.col("step") <= SPLIT_STEP)
    held = F.xxhash64("row_id") % 5 == 0
    model, by_round = EN.train_with_early_stopping(d.filter(~held), d.filter(held), maxIter=3 * FOLD_ROUNDS)
    kept = model.getNumTrees
    return spark.createDataFrame(by_round).select(F.col("round").cast("int"), F.round("pr_auc", 6).alias("pr_auc"), (F.col("round") == kept).alias("kept"))


RESAMPLE_SQL = with_sql(LEDGER_SQL, """
c AS (SELECT count(*) FILTER (WHERE isFraud = 0) AS n0, count(*) FILTER (WHERE isFraud = 1) AS n1 FROM txn_ledger)""", """
w AS (SELECT isFraud, CASE WHEN isFraud = 1 THEN least(1e0 / n1, 10e0 / n0) ELSE 1e0 / n0 END AS weight, count(*) AS n
      FROM txn_ledger, c GROUP BY ALL)""", """
l AS (SELECT isFraud, weight * (SELECT sum(n) FROM w) / (SELECT sum(n * weight) FROM w) AS l FROM w)""", """
cdf AS (SELECT isFraud, list_transform(range(0, CAST(l + 12 * sqrt(l) + 20 AS INT) + 1),
          lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-l) * pow(l, j) / gamma(j + 1)))) AS cdf FROM l)""", body="""
SELECT row_id, CAST(len(list_filter(cdf, lambda x: x <= CAST('0x' || substr(sha256('42:' || row_id), 1, 13) AS BIGINT) / 4503599627370496e0)) AS INT) AS copies
FROM txn_ledger JOIN cdf USING (isFraud)""")


@query("M7_weighted_resampling", sql=RESAMPLE_SQL)
def q_m7_resample(spark, sf):
    return EN.resample(txn_ledger(spark, sf)).select("row_id", "copies")


@query("S12_ensemble_reload", sql=with_sql(LEDGER_SQL, body="SELECT row_id, TRUE AS same, TRUE AS in_range FROM txn_ledger"))
def q_s12(spark, sf):
    """The ensemble saved and loaded gives every row the score that it had."""
    bp = base_probs(spark, sf)
    ensemble = EN.CalibratedEnsemble.train(bp)
    path = scratch_path(spark, "ensemble")
    ensemble.save(path)
    again = EN.CalibratedEnsemble.load(path).transform(ensemble.transform(bp).withColumnRenamed("ensemble_prob", "before"))
    return again.select("row_id", (F.col("ensemble_prob") == F.col("before")).alias("same"), F.col("ensemble_prob").between(0, 1).alias("in_range"))


@query("M11_batch_scoring_trained", sql=with_sql(LEDGER_SQL, body=f"SELECT row_id, TRUE AS in_range FROM txn_ledger WHERE step > {SPLIT_STEP}"))
def q_m11_trained(spark, sf):
    """A model trained on the earlier rows scores the later ones."""
    d = _model_columns(spark, sf)
    model = _fit_gbt(d.filter(F.col("step") <= SPLIT_STEP))
    return _score_gbt(model, d.filter(F.col("step") > SPLIT_STEP)).select("row_id", F.col("p_tab").between(0, 1).alias("in_range"))


@query("M11_batch_scoring_no_model", sql=with_sql(LEDGER_SQL, body="SELECT row_id, 0e0 AS ml_prob FROM txn_ledger"))
def q_m11(spark, sf):
    return ML.score(None, txn_ledger(spark, sf).select("row_id"), "ml_prob")


@query("M5_M6_ensemble_meta")
def q_m56(spark, sf):
    bp = base_probs(spark, sf)
    models = ML.train_meta(bp)
    return ML.predict_meta(models, bp).select("row_id", "y", F.round("ensemble_prob", 6).alias("ensemble_prob"))


@query("M8_M12_sequence_model_gate")
def q_m812(spark, sf):
    seqs = SQ.build_sequences(txn_ledger(spark, sf), ["amount", "oldbalanceOrg"])
    train, test = seqs.filter(F.col("step") <= SPLIT_STEP), seqs.filter(F.col("step") > SPLIT_STEP)
    model = ML.train_sequence_model(train)
    from pyspark.ml.functions import array_to_vector
    t = ML.flatten_sequences(test).withColumn("seqvec", array_to_vector("_flat"))
    p = ML.positive_probability(model.transform(t), "p_seq").select(F.col("isFraud").alias("y"),
                                                                      F.col("p_seq").alias("prob"))
    ap = ME.average_precision(ME.curve(p))
    return ap.select(F.round("pr_auc", 6).alias("pr_auc"),
                     (F.col("pr_auc") >= ML.SEQ_GATE_PR_AUC).alias("kept"))


# ------------------------------------------------------------ registry: a run for every merchant, measured on its rows
RUNS_CTES = [LEDGER_SQL, """
runs AS (SELECT nameDest AS run_id, 'pr_auc' AS metric, round(avg(isFraud), 9) AS value FROM txn_ledger GROUP BY 1
         UNION ALL SELECT nameDest, 'rows', count(*)::DOUBLE FROM txn_ledger GROUP BY 1)""", """
versions AS (SELECT 'risk' AS name, row_number() OVER (ORDER BY run_id)::INTEGER AS version, run_id,
                    CASE WHEN row_number() OVER (ORDER BY run_id) = 3 THEN 'Production' ELSE 'Archived' END AS stage
             FROM (SELECT DISTINCT nameDest AS run_id FROM txn_ledger WHERE nameDest IN ('M1', 'M2', 'M3', 'M4', 'M5')))""", """
best AS (SELECT run_id, value FROM runs WHERE metric = 'pr_auc' ORDER BY value DESC, run_id LIMIT 1)""", """
prod AS (SELECT version, v.run_id, coalesce(value, 0) AS prod_value FROM versions v LEFT JOIN runs r ON r.run_id = v.run_id AND metric = 'pr_auc'
         WHERE stage = 'Production')"""]


def registry_tables(spark, sf):
    led = txn_ledger(spark, sf)
    per = led.groupBy(F.col("nameDest").alias("run_id")).agg(F.round(F.avg("isFraud"), 9).alias("pr_auc"), F.count(F.lit(1)).cast("double").alias("rows"))
    runs = per.unpivot(["run_id"], ["pr_auc", "rows"], "metric", "value")
    first = ["M1", "M2", "M3", "M4", "M5"]
    at = F.array_position(F.array(*map(F.lit, first)), F.col("run_id")).cast("int")
    versions = per.filter(F.col("run_id").isin(first)).select(F.lit("risk").alias("name"), at.alias("version"), "run_id",
                                                            F.when(at == 3, "Production").otherwise("Archived").alias("stage"))
    return versions, runs


@query("A18_best_run", sql=with_sql(*RUNS_CTES, body="SELECT run_id, value FROM best"))
def q_a18(spark, sf):
    return RG.best_run(registry_tables(spark, sf)[1])


@query("J6_production_metric", sql=with_sql(*RUNS_CTES, body="SELECT version, run_id, prod_value FROM prod"))
def q_j6(spark, sf):
    return RG.production_metric(*registry_tables(spark, sf), "risk")


@query("M9_promotion", sql=with_sql(*RUNS_CTES, body="""
SELECT name, version, run_id, CASE WHEN stage = 'Production' AND (SELECT value FROM best) > (SELECT prod_value FROM prod) THEN 'Archived' ELSE stage END AS stage FROM versions
UNION ALL SELECT 'risk', (SELECT max(version) + 1 FROM versions)::INTEGER, run_id,
       CASE WHEN value > (SELECT prod_value FROM prod) THEN 'Production' ELSE 'Staging' END FROM best"""))
def q_m9(spark, sf):
    return RG.promote(*registry_tables(spark, sf), "risk")
