"""File sources and model persistence."""
from __future__ import annotations

import logging

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.operators.validate import to_canonical
from riskflow.schemas import LEDGER_CSV

log = logging.getLogger(__name__)


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV with a declared schema, renamed/pruned to canonical columns."""
    df = spark.read.schema(LEDGER_CSV).option("header", True).csv(path)
    return to_canonical(df)


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet when the path ends in .parquet, else CSV with a header."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_feature_source(spark: SparkSession, path: str, key: str = "card_id", ts: str = "Time",
                        fields: tuple[str, ...] = ("Amount", "V1", "Velocity_1H", "Amt_Rolling_Mean_1H"),
                        created: str | None = "created") -> DataFrame:
    """Feature-view source file: entity key, typed event time and created time, feature fields.

    created_ts is null in files without the created column; the as-of join (J4)
    takes it to decide between rows of one key and time.
    """
    df = read_snapshot(spark, path)
    made = F.col(created) if created in df.columns else F.lit(None)
    return df.select(F.col(key).cast("string").alias(key), F.col(ts).cast("timestamp").alias("feature_ts"),
                     made.cast("timestamp").alias("created_ts"),
                     *[F.col(f).cast("double").alias(f) for f in fields])


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (overwrites)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """Load a pipeline; ``None`` (heuristic-only scoring) when it cannot be loaded."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # noqa: BLE001 - missing model is a supported mode
        log.warning("no model at %s (%s); heuristic-only scoring", path, exc)
        return None
