"""PSI and curve metrics against NumPy brute force on small fixtures."""
import random

import numpy as np

from riskflow.operators import drift as DR
from riskflow.operators import metrics as ME


def _numpy_psi(expected, actual, buckets=10):
    bp = np.percentile(expected, np.linspace(0, 100, buckets + 1))
    bp[0], bp[-1] = -np.inf, np.inf

    def pct(a):
        c = np.histogram(a, bins=bp)[0] / len(a)
        return np.where(c == 0, 1e-8, c)
    e, a = pct(expected), pct(actual)
    return float(np.sum((a - e) * np.log(a / e)))


def test_psi_matches_numpy_with_duplicates(spark):
    rnd = random.Random(1)
    ref = [float(rnd.choice([1, 1, 1, 2, 3, 5, 8])) + (rnd.random() if rnd.random() < 0.3 else 0) for _ in range(700)]
    cur = [x * 1.3 for x in ref[:400]] + [None] * 5
    r = spark.createDataFrame([(x,) for x in ref], "x double")
    c = spark.createDataFrame([(x,) for x in cur], "x double")
    got = DR.psi_by_feature(r, c, ["x"]).collect()[0].psi
    assert abs(got - _numpy_psi(np.array(ref), np.array([x for x in cur if x is not None]))) < 1e-9


def test_quantiles_match_numpy(spark):
    vals = [0.1] * 7 + [0.3, 0.7, 1.3, 2.9, 2.9, 2.9]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    q = DR.exact_quantiles(DR.long_form(df, ["x"]), DR.quantile_probs()).orderBy("i").collect()
    assert [r.q for r in q] == list(np.percentile(vals, np.linspace(0, 100, 11)))


def test_status_and_decision(spark):
    df = spark.createDataFrame([("a", 0.05), ("b", 0.2), ("c", 0.3)], "feature string, psi double")
    st = {r.feature: r.status for r in DR.drift_status(df).collect()}
    assert st == {"a": "STABLE", "b": "WARNING", "c": "DRIFT DETECTED"}
    d = DR.drift_decision(df).collect()[0]
    assert d.max_psi == 0.3 and d.retrain
    empty = DR.drift_decision(df.limit(0)).collect()[0]
    assert empty.max_psi == 0.0 and not empty.retrain


def _sk_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for s in order:
        tp = sum(1 for yi, pi in zip(y, p) if pi >= s and yi == 1)
        fp = sum(1 for yi, pi in zip(y, p) if pi >= s and yi == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_curve_metrics_with_ties(spark):
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.2), round(rnd.random(), 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, y int, prob double")
    c = ME.curve(df)
    ap = ME.average_precision(c).collect()[0].pr_auc
    assert abs(ap - _sk_ap([r[1] for r in rows], [r[2] for r in rows])) < 1e-12
    # ROC AUC = P(score_pos > score_neg) + 0.5 P(tie)
    pos = [r[2] for r in rows if r[1] == 1]
    neg = [r[2] for r in rows if r[1] == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(ME.roc_auc(c).collect()[0].roc_auc - auc) < 1e-12


def test_threshold_fallbacks(spark):
    same = spark.createDataFrame([(i, i % 2, 0.5) for i in range(10)], "row_id long, y int, prob double")
    b = ME.best_threshold(ME.curve(same)).collect()[0]
    assert b.rule == "f1_fallback" and b.threshold == 0.5
    nopos = spark.createDataFrame([(i, 0, i / 10) for i in range(10)], "row_id long, y int, prob double")
    assert ME.class_balance(nopos).collect()[0].scale_pos_weight == 1.0
    high = spark.createDataFrame([(i, 1 if i >= 5 else 0, 0.9 if i >= 5 else 0.1) for i in range(10)],
                                 "row_id long, y int, prob double")
    assert ME.best_threshold(ME.curve(high)).collect()[0].threshold == 0.8   # capped


def test_nan_values_are_dropped(spark):
    from riskflow.operators.drift import long_form
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r["value"] for r in long_form(df, ["x"]).collect()] == [1.0]


def test_model_vector_has_the_night_and_no_missing_names(spark):
    import pytest
    from pyspark.ml.functions import vector_to_array

    from riskflow.operators import ml
    from riskflow.plans.catalog_models import _model_frame
    at = ml.MODEL_FEATURES.index("is_night")
    got = _model_frame(spark, "/root/testdata/sf0.001").select("step", vector_to_array("features")[at].alias("night")).collect()
    assert all(r["night"] == (r["step"] % 24 <= 5) for r in got) and {r["night"] for r in got} == {0.0, 1.0}
    with pytest.raises(ValueError, match="p_seq"):
        ml.assemble(spark.range(1).selectExpr("0.5 as p_tab"), ["p_tab", "p_seq"])


def test_drift_check_over_all_shared_columns(spark):
    import random
    from riskflow.operators import drift as DR
    rng = random.Random(2)
    ref = spark.createDataFrame([(rng.gauss(0, 1), rng.randrange(5), rng.choice("xyz"), True, 1.0) for _ in range(2000)], "v double, n int, c string, b boolean, only_here double")
    cur = spark.createDataFrame([(rng.gauss(1, 1) if i % 9 else float("nan"), rng.randrange(5), rng.choice(["x", "new", None]), i % 2 == 0, "1") for i in range(2000)],
                                "v double, n int, c string, b boolean, elsewhere string")
    got = {r.feature: r for r in DR.drift_check(ref, cur).collect()}
    assert {f: r.kind for f, r in got.items()} == {"v": "numeric", "n": "numeric", "c": "categorical", "b": "categorical"}
    assert got["v"].status == got["c"].status == got["b"].status == "DRIFT DETECTED" and got["n"].status == "STABLE"
    exact = {r.feature: r.psi for r in DR.psi_by_feature(ref, cur, ["v"]).collect()}
    near = {r.feature: r.psi for r in DR.sketch_psi(ref, cur, ["v"]).collect()}
    assert abs(exact["v"] - got["v"].psi) < 1e-6 and abs(exact["v"] - near["v"]) < 0.1 * exact["v"]


def test_psi_reads_its_input_once(spark, scratch):
    from pyspark.sql import functions as F
    from riskflow.operators import drift as DR
    from riskflow.operators import ordered
    spark.range(1000).select((F.col("id") % 97).cast("double").alias("v")).write.parquet(f"{scratch}/in")
    d = spark.read.parquet(f"{scratch}/in")
    plans, keep = [], ordered.store
    ordered.store = lambda x, name: (plans.append(x._jdf.queryExecution().executedPlan().toString()), keep(x, name))[1]
    try:
        out = DR.psi_by_feature(d, d, ["v"])
    finally:
        ordered.store = keep
    assert len(plans) == 1 and plans[0].count("FileScan") == 2          # one for each sample
    assert f"{scratch}/in" not in out._jdf.queryExecution().executedPlan().toString()
    assert abs(out.collect()[0].psi) < 1e-12
