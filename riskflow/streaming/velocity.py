"""Event stream -> parsed events + 1 m / 5 m / 1 h velocity tables.

Distinct merchants per window cannot be a streaming ``countDistinct`` (Spark
rejects it).  It is computed exactly by two chained window aggregations: first
per (card, merchant, window), then per (card, window), counting the non-null
merchants - accepted in append mode.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskflow.functions.rowfeatures import is_night
from riskflow.operators.velocity import WIDTHS
from riskflow.operators.validate import REQUIRED
from riskflow.schemas import TXN_EVENT

WATERMARK = "2 minutes"
TRIGGER = "30 seconds"
MAX_OFFSETS_PER_TRIGGER = 50_000
ENRICHED_TOPIC, ALERT_TOPIC = "enriched", "alerts"


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int = MAX_OFFSETS_PER_TRIGGER,
                 starting: str = "latest") -> DataFrame:
    """S3: subscribe to a topic (needs the Kafka connector on the classpath)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", starting)
            .option("maxOffsetsPerTrigger", max_offsets).option("failOnDataLoss", "false").load())


def file_source(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Test stand-in for S3: a file stream with Kafka-like (key, value, timestamp) rows."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def decode(raw: DataFrame) -> DataFrame:
    """JSON value -> canonical columns, broker time kept, raw text kept for dead letters."""
    return (raw.select(F.col("value").cast("string").alias("json_str"), F.col("key").cast("string").alias("kafka_key"),
                       F.col("timestamp").alias("kafka_ts"))
            .select("json_str", "kafka_ts", F.from_json("json_str", TXN_EVENT).alias("data")))


def parsed_events(decoded: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """Valid decoded rows with event time and, if given, a watermark."""
    ok = F.col("data").isNotNull() & F.col("data.timestamp").isNotNull()
    for c in REQUIRED:
        ok = ok & F.col(f"data.{c}").isNotNull()
    ok = ok & (F.col("data.amount") >= 0)
    d = decoded.filter(ok).select("data.*", "kafka_ts")
    d = d.withColumn("event_time", F.timestamp_millis("timestamp"))
    return d.withWatermark("event_time", watermark) if watermark else d


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Malformed JSON, missing required fields or negative amounts, with the error text."""
    # from_json yields an all-null struct (not a null struct) for malformed text
    malformed = F.col("data").isNull() | F.coalesce(*[F.col(f"data.{f.name}").cast("string") for f in TXN_EVENT.fields]).isNull()
    err = (F.when(malformed, F.lit("Malformed JSON"))
           .when(F.col("data.card_id").isNull() | F.col("data.amount").isNull() | F.col("data.merchant_id").isNull(),
                 F.concat(F.lit("Missing fields: "), F.concat_ws(", ", *[
                     F.when(F.col(f"data.{c}").isNull(), F.lit(c)) for c in REQUIRED])))
           .when(F.col("data.amount") < 0, F.concat(F.lit("Invalid amount: "), F.col("data.amount").cast("string")))
           .when(F.col("data.timestamp").isNull(), F.lit("Missing event time")))
    return decoded.select(F.col("json_str").alias("original"), err.alias("error"),
                          F.col("kafka_ts").alias("ts")).filter(F.col("error").isNotNull())


def velocity_1m(parsed: DataFrame) -> DataFrame:
    """A1 on a stream."""
    g = parsed.groupBy("card_id", F.window("event_time", WIDTHS["1m"])).agg(
        F.count("txn_id").alias("txn_count_1m"), F.sum("amount").alias("amount_sum_1m"))
    return g.select("card_id", F.col("window.end").alias("window_end_1m"), "txn_count_1m", "amount_sum_1m")


def _chained(parsed: DataFrame, suffix: str, with_max: bool) -> DataFrame:
    width = WIDTHS[suffix]
    aggs = [F.count("txn_id").alias("_n"), F.sum("amount").alias("_s")]
    if with_max:
        aggs.append(F.max("amount").alias("_m"))
    first = parsed.groupBy("card_id", "merchant_id", F.window("event_time", width)).agg(*aggs)
    aggs2 = [F.sum("_n").alias(f"txn_count_{suffix}"), F.sum("_s").alias(f"amount_sum_{suffix}")]
    if with_max:
        aggs2.append(F.max("_m").alias(f"amount_max_{suffix}"))
    aggs2.append(F.count("merchant_id").alias(f"unique_merchants_{suffix}"))
    second = first.groupBy("card_id", F.window(F.window_time("window"), width).alias("w")).agg(*aggs2)
    cols = [c for c in second.columns if c not in ("card_id", "w")]
    return second.select("card_id", F.col("w.end").alias(f"window_end_{suffix}"), *cols)


def velocity_5m(parsed: DataFrame) -> DataFrame:
    """A2 on a stream (exact distinct merchants by chained aggregation)."""
    return _chained(parsed, "5m", with_max=False)


def velocity_1h(parsed: DataFrame) -> DataFrame:
    """A3 on a stream."""
    return _chained(parsed, "1h", with_max=True)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: str | None = TRIGGER,
                 available_now: bool = False, mode: str = "append") -> StreamingQuery:
    """Append sink with its own checkpoint and trigger."""
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    if fmt == "delta":
        w = w.option("mergeSchema", "true")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=trigger)
    return w.start(path)


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder was completed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def to_folder(out_dir: str) -> Callable[[DataFrame, str, int], None]:
    """Writes a sink's part of an epoch to a folder of its own, once: a repeated epoch skips what is complete."""
    def write(df: DataFrame, name: str, epoch: int) -> None:
        path = f"{out_dir}/{name}/epoch={epoch}"
        if not _written(df.sparkSession, path):
            df.write.mode("overwrite").parquet(path)
    return write


def to_topic(servers: str, fmt: str = "kafka", **options) -> Callable[[DataFrame, str, int], None]:
    """Writes a sink's (key, value) rows to the topic of its name (needs the Kafka connector on the classpath).

    The producer delivers at least once; consumers tell repeats by key and value.
    """
    def write(df: DataFrame, name: str, epoch: int) -> None:
        settings = {**KAFKA_PRODUCER_OPTIONS, "kafka.bootstrap.servers": servers, "topic": name, **options}
        w = df.write.format(fmt).options(**settings)
        w.save() if fmt == "kafka" else w.mode("overwrite").save(f"{servers}/{name}/epoch={epoch}")
    return write


def fan_out(sinks: dict[str, Callable[[DataFrame], DataFrame]], write: Callable[[DataFrame, str, int], None]):
    """A foreachBatch body that reads and parses a micro-batch once and feeds several sinks, in order."""
    def body(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for name, part in sinks.items():
                write(part(batch), name, epoch)
        finally:
            batch.unpersist()
    return body


def enriched_and_alerts() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """(key, value) rows of the enriched and the alert topic, from parsed events."""
    def enriched(parsed: DataFrame) -> DataFrame:
        return kafka_sink_frame(parsed.withColumn("is_night", is_night(F.col("event_time"))).drop("kafka_ts", "event_time"))

    def alerts(parsed: DataFrame) -> DataFrame:
        return kafka_sink_frame(parsed.filter("is_fraud").select("txn_id", "card_id", "merchant_id", "amount", "timestamp"))
    return {ENRICHED_TOPIC: enriched, ALERT_TOPIC: alerts}


def run_velocity_job(raw: DataFrame, out_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                     available_now: bool = False) -> list[StreamingQuery]:
    """The source is read and parsed once, into the parsed table and the dead letters; the three
    velocity tables read the parsed table.  One checkpoint each.
    """
    dec = decode(raw)
    sinks = {"raw_parsed": lambda d: parsed_events(d, None), "dead_letter": dead_letters}
    w = dec.writeStream.option("checkpointLocation", f"{checkpoint_dir}/raw_parsed").foreachBatch(fan_out(sinks, to_folder(out_dir)))
    first = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TRIGGER)).start()
    if available_now:
        first.awaitTermination()
    shape = parsed_events(dec, None).schema
    parsed = raw.sparkSession.readStream.schema(shape).parquet(f"{out_dir}/raw_parsed/*").select(*shape.names).withWatermark("event_time", WATERMARK)
    tables = {"velocity_1m": velocity_1m(parsed), "velocity_5m": velocity_5m(parsed), "velocity_1h": velocity_1h(parsed)}
    return [first] + [write_stream(df, f"{out_dir}/{name}", f"{checkpoint_dir}/{name}", fmt, available_now=available_now)
                      for name, df in tables.items()]


def await_all(queries: list[StreamingQuery], timeout: float | None = None) -> None:
    """Wait for every query (not just the first to stop)."""
    for q in queries:
        q.awaitTermination(timeout) if timeout else q.awaitTermination()


def kafka_sink_frame(df: DataFrame, key: str = "card_id") -> DataFrame:
    """(key, value) rows for a Kafka writer; JSON value of all columns."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


KAFKA_PRODUCER_OPTIONS = {
    "kafka.compression.type": "lz4",
    "kafka.linger.ms": "5",
    "kafka.batch.size": "65536",
    "kafka.acks": "1",
}
