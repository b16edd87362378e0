"""Learning and model-evaluation operators on MLlib.

Everything trains and scores on executors; the driver only holds fitted
models (a few KB) and loops over the five folds of cross-validation.
"""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.operators import boosting
from riskflow.operators.ordered import prefix_scan

# Online model vector order and training settings.
MODEL_FEATURES = [
    "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
    "newbalanceDest", "step", "type_encoded", "txn_count",
    "amt_sum", "velocity", "burst", "time_gap", "merchant_risk",
    "balance_diff_orig", "balance_diff_dest", "balance_mismatch",
    "hour_of_day", "is_night",
]
N_FOLDS = 5
SEED = 42
GBT_PARAMS = dict(maxIter=500, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                  seed=SEED)
META_C = 0.1
WEIGHT_CAP = 10.0
SEQ_GATE_PR_AUC = 0.10


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """M1: (x - mean) / population std (std 0 -> 0)."""
    st = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    d = df.crossJoin(F.broadcast(st))
    for c in cols:
        s = F.col(f"_s_{c}")
        d = d.withColumn(c, F.when(s > 0, (F.col(c) - F.col(f"_m_{c}")) / s).otherwise(F.lit(0.0)))
    return d.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def assemble(df: DataFrame, names: list[str] = MODEL_FEATURES, out: str = "features") -> DataFrame:
    """fixed-order vector; nulls become 0.0, a missing column is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the model vector: {missing}")
    cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_v_{n}") for n in names]
    d = df.select("*", *cols)
    va = VectorAssembler(inputCols=[f"_v_{n}" for n in names], outputCol=out)
    return va.transform(d).drop(*[f"_v_{n}" for n in names])


def class_weights(df: DataFrame, label: str = "isFraud", cap: float = WEIGHT_CAP) -> DataFrame:
    """M7: w0 = 1/n0, w1 = min(1/n1, cap/n0); adds ``weight``."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1"))
    d = df.crossJoin(F.broadcast(n))
    w1 = F.least(F.try_divide(F.lit(1.0), F.col("_n1")), F.try_divide(F.lit(cap), F.col("_n0")))
    return d.withColumn("weight", F.when(F.col(label) == 1, w1).otherwise(F.try_divide(F.lit(1.0), F.col("_n0")))).drop("_n0", "_n1")


def stratified_folds(df: DataFrame, label: str = "isFraud", id_col: str = "row_id", k: int = N_FOLDS,
                     seed: int = SEED) -> DataFrame:
    """M4: fold = (rank within label in seeded hash order - 1) % k; fold sizes differ by at most 1."""
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    d = prefix_scan(df.withColumn("_h", h), [label], [F.col("_h"), F.col(id_col)], position="_r")
    return d.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def positive_probability(pred: DataFrame, out: str = "p") -> DataFrame:
    """Positive-class probability as a double column."""
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


def train_gbt(train: DataFrame, label: str = "isFraud", features: str = "features",
              validation: str | None = None, one_stage: bool = False, folds: tuple[str, int] | None = None,
              **overrides) -> PipelineModel | list[PipelineModel]:
    """M3: boosted trees with positive weight (neg/pos) and optional early-stopping column.

    one_stage: all rounds in one barrier stage (``boosting.py``), not in a job for each level.
    folds: (column, k) gives a list of k models, the i-th of the rows not of fold i, all in one stage.
    """
    params = {**GBT_PARAMS, **overrides}
    if one_stage or folds:
        if validation:
            raise ValueError("early stopping is not made in one stage")
        models = boosting.train(train, label, features, params, *(folds or ()))
        return models if folds else models[0]
    counts = train.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    spw = counts.select(F.coalesce(F.try_divide(F.col("n0").cast("double"),
                                                F.nullif(F.col("n1"), F.lit(0)).cast("double")), F.lit(1.0)))
    d = train.crossJoin(F.broadcast(spw.withColumnRenamed(spw.columns[0], "_spw")))
    d = d.withColumn("_w", F.when(F.col(label) == 1, F.col("_spw")).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(labelCol=label, featuresCol=features, weightCol="_w", **params)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[gbt]).fit(d)


def score(model: PipelineModel | None, df: DataFrame, out: str = "ml_prob") -> DataFrame:
    """Probability of fraud, 0.0 when no model is loaded (heuristic-only mode)."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    p = model.transform(df)
    keep = df.columns + [out]
    return positive_probability(p, out).select(*keep)


def meta_features(df: DataFrame, p_tab: str = "p_tab", p_seq: str = "p_seq") -> DataFrame:
    """[p_tab, p_seq or its mean (0.5 if all missing), missing flag]."""
    mean = df.agg(F.coalesce(F.avg(p_seq), F.lit(0.5)).alias("_ps_mean"))
    d = df.crossJoin(F.broadcast(mean))
    return d.withColumns({
        "p_seq_filled": F.coalesce(F.col(p_seq), F.col("_ps_mean")),
        "p_seq_missing": F.col(p_seq).isNull().cast("double"),
    }).drop("_ps_mean")


def train_meta(df: DataFrame, label: str = "y", folds: int = N_FOLDS, c: float = META_C) -> list:
    """M5: per fold, L2 logistic regression (sklearn C) on 4/5 + isotonic calibration on the held-out 1/5."""
    d = meta_features(df)
    d = assemble(d, ["p_tab", "p_seq_filled", "p_seq_missing"], "meta")
    d = stratified_folds(d, label, "row_id", folds)
    d = d.persist()
    rows = {r["fold"]: r["count"] for r in d.groupBy("fold").count().collect()}   # one number per fold
    models = []
    for k in range(folds):
        tr, ho = d.filter(F.col("fold") != k), d.filter(F.col("fold") == k)
        n = sum(c for fold, c in rows.items() if fold != k)
        lr = LogisticRegression(featuresCol="meta", labelCol=label, regParam=1.0 / (c * max(n, 1)),
                                elasticNetParam=0.0, standardization=False, maxIter=500)
        lrm = lr.fit(tr)
        cal_in = positive_probability(lrm.transform(ho), "_raw")
        iso = IsotonicRegression(featuresCol="_raw", labelCol=label, predictionCol="_cal").fit(cal_in)
        models.append((lrm, iso))
    d.unpersist()
    return models


def predict_meta(models: list, df: DataFrame) -> DataFrame:
    """M6: average of the calibrated fold models on the meta features (cold start handled by F30)."""
    d = assemble(meta_features(df), ["p_tab", "p_seq_filled", "p_seq_missing"], "meta")
    total = None
    for i, (lrm, iso) in enumerate(models):
        p = positive_probability(lrm.transform(d).select(*d.columns, "probability"), "_raw")
        p = iso.transform(p).select(*d.columns, F.col("_cal").alias(f"_c{i}"))
        d = p
        total = F.col(f"_c{i}") if total is None else total + F.col(f"_c{i}")
    return d.withColumn("ensemble_prob", total / len(models)).drop(*[f"_c{i}" for i in range(len(models))])


def sequence_gate(pr_auc: float, gate: float = SEQ_GATE_PR_AUC) -> bool:
    """M8: keep the sequence model only if its PR-AUC reaches the gate."""
    return pr_auc >= gate


def flatten_sequences(seqs: DataFrame) -> DataFrame:
    """M12 input: window x features flattened, then the mask."""
    return seqs.withColumn("_flat", F.concat(F.flatten("seq"), F.col("mask")))


def train_sequence_model(seqs: DataFrame, label: str = "isFraud") -> PipelineModel:
    """M12 (re-aimed): logistic regression on the flattened history window and mask, class-weighted (M7)."""
    d = class_weights(flatten_sequences(seqs), label)
    from pyspark.ml.functions import array_to_vector
    d = d.withColumn("seqvec", array_to_vector("_flat"))
    lr = LogisticRegression(featuresCol="seqvec", labelCol=label, weightCol="weight", maxIter=100)
    return Pipeline(stages=[lr]).fit(d)
