"""The event log as a source and a sink.

The production transport is Kafka (topic per event type, key = order id,
3 partitions). A file source with the same columns stands in where the
Kafka connector is not installed; both return the same DataFrame shape:
``topic, partition, offset, key, value, timestamp``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])


def read_events(spark: SparkSession, topics: list[str], *, bootstrap: str | None = None,
                path: str | None = None, stream: bool = True) -> DataFrame:
    """Read topics from their beginning, at least once.

    With ``bootstrap`` this is the Kafka source (``startingOffsets=earliest``;
    committed progress lives in the query checkpoint, so a restart resumes
    where the last completed batch ended). With ``path`` it reads parquet
    files holding the same columns, partitioned by ``topic``.
    """
    if bootstrap:
        reader = spark.readStream if stream else spark.read
        raw = (reader.format("kafka").option("kafka.bootstrap.servers", bootstrap)
               .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load())
        return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                          F.col("value").cast("string").alias("value"), "timestamp")
    if path is None:
        raise ValueError("read_events needs bootstrap servers or a path")
    reader = spark.readStream.schema(ENVELOPE_SCHEMA) if stream else spark.read.schema(ENVELOPE_SCHEMA)
    df = reader.parquet(path)
    return df.where(F.col("topic").isin(*topics))


def envelope_records(payments: DataFrame) -> DataFrame:
    """Wrap payment outcomes as keyed envelope records: the value is
    the JSON envelope, the key the order id, and the correlation id rides
    both in the body and (see :func:`kafka_frame`) in a header."""
    ok = F.col("status") == "succeeded"
    payload = F.struct(
        F.col("order_id").alias("order_id"),
        F.when(ok, F.col("payment_id")).alias("payment_id"),
        F.when(ok, F.col("amount_cents")).alias("amount_cents"),
        F.when(ok, F.col("currency")).alias("currency"),
        F.when(~ok, F.col("failure_reason")).alias("reason"))
    corr = F.concat(F.lit("o-"), F.col("order_id"))
    env = F.struct(F.concat(F.lit("evt-"), F.col("payment_id")).alias("id"),
                   F.when(ok, "PaymentSucceeded").otherwise("PaymentFailed").alias("type"),
                   corr.alias("correlation_id"), payload.alias("payload"))
    return payments.select(F.when(ok, "payment.succeeded").otherwise("payment.failed").alias("topic"),
                           F.col("order_id").alias("key"), corr.alias("correlation_id"),
                           F.to_json(env).alias("value"))


def kafka_frame(records: DataFrame) -> DataFrame:
    """Columns the Kafka sink expects, with the correlation header."""
    return records.select("topic", "key", "value",
                          F.array(F.struct(F.lit("X-Correlation-ID").alias("key"),
                                           F.col("correlation_id").cast("binary").alias("value"))).alias("headers"))


FILE_PARTITIONS = 3


def file_frame(records: DataFrame) -> DataFrame:
    """Records with the columns that :func:`read_events` reads, filled in as
    the broker would: a partition by key, an offset that ascends within a
    writer's rows, a write time. Columns that the records have are kept."""
    have = set(records.columns)
    partition = F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(FILE_PARTITIONS)).cast("int")
    fill = {"partition": partition, "offset": F.monotonically_increasing_id(), "timestamp": F.current_timestamp()}
    out = records.withColumns({c: v for c, v in fill.items() if c not in have})
    return out.select(*[F.col(f.name).cast(f.dataType) for f in ENVELOPE_SCHEMA.fields])


def write_events(records: DataFrame, *, bootstrap: str | None = None, path: str | None = None,
                 mode: str = "append") -> None:
    """S2 sink (batch): Kafka when ``bootstrap`` is given, else parquet
    partitioned by topic, which ``read_events`` reads back whole."""
    if bootstrap:
        kafka_frame(records).write.format("kafka").option("kafka.bootstrap.servers", bootstrap).save()
        return
    if path is None:
        raise ValueError("write_events needs bootstrap servers or a path")
    file_frame(records).write.mode(mode).partitionBy("topic").parquet(path)


ENVELOPE_FIELDS = "id STRING, type STRING, correlation_id STRING"


def records_from_deliveries(deliveries: DataFrame) -> DataFrame:
    """Kafka-shaped records (topic, partition, offset, key, value) of a
    delivery table; the value embeds the raw payload JSON."""
    # Written as JSON, so texts are escaped and an absent id leaves no field out of place.
    head = F.to_json(F.struct(F.col("envelope_id").alias("id"), "type", "correlation_id"))
    body = F.concat(F.lit('"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    value = F.when(head == "{}", F.concat(F.lit("{"), body)).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), body))
    return deliveries.select("topic", "partition", "offset", "key", value.alias("value"))


def parse_envelopes(records: DataFrame) -> DataFrame:
    """Decode the envelope of each record; the payload stays raw JSON text
    (decoded per type later, see :mod:`admitflow.functions.jsonx`)."""
    env = F.from_json(F.col("value"), ENVELOPE_FIELDS)
    return records.select("*", env.alias("_e"),
                          F.get_json_object("value", "$.payload").alias("payload")).select(
        *records.columns, F.col("_e.id").alias("id"), F.col("_e.type").alias("type"),
        F.col("_e.correlation_id").alias("correlation_id"), "payload")
