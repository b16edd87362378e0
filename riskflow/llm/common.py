"""Helpers shared by the training-data operators."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import ensure_checkpoint_dir

#: white space that separates words everywhere in this subpackage
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order, unchanged; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; only a local session may do without it."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage, is computed once however many branches read it, survives
    lost executors, and later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_splits(df: DataFrame, n: int, name: str) -> str:
    """Write df (with an int column split) to the shared folder, one folder for each split, and give its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.repartitionById(max(1, n), F.col("split")).write.partitionBy("split").parquet(path)
    return path


def read_split(path: str, split: int):
    """In a task: the rows that settle_splits wrote for one split, as an Arrow table, or None."""
    import pyarrow.parquet as pq
    from pyarrow import concat_tables, fs
    store, root = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/split={split}", allow_not_found=True))
    files = [f.path for f in found if f.path.endswith(".parquet")]
    return concat_tables([pq.read_table(f, filesystem=store, partitioning=None) for f in files]) if files else None


def give_back() -> None:
    """In a task: memory that earlier work of this Python worker has freed goes back to the system."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
