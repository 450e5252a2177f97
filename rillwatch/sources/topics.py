"""Message topics: one JSON object per row, over Kafka or as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad"
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default would cut times to milliseconds


def read_topic(spark: SparkSession, servers: str, topic: str, schema: T.StructType, group: str, starting: str = "latest",
               max_per_trigger: int | None = None) -> DataFrame:
    """A Kafka topic as a stream of parsed rows; needs the Kafka connector on the classpath."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", starting).option("kafka.group.id", group))
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return parse(reader.load().select(F.col("value").cast("string").alias("value")), schema)


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    """Rows as JSON messages, gzip, acknowledged by all replicas. A ``key`` keeps one source in one partition."""
    out = to_messages(df)
    if key:
        out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*"), {"timestampFormat": MICROS}).alias("value"))
    return (out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("kafka.compression.type", "gzip").option("kafka.acks", "all").option("checkpointLocation", checkpoint))


def to_messages(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"timestampFormat": MICROS}).alias("value"))


def parse_all(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Parsed columns plus the raw text of messages that are no valid JSON."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return messages.select(parsed.alias("_m")).select("_m.*")


def parse(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """Valid messages only."""
    return parse_all(messages, schema).filter(F.col(BAD).isNull()).drop(BAD)


def write_json_files(df: DataFrame, path: str) -> None:
    to_messages(df).write.option("compression", "gzip").text(path)


def stream_json_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse(lines, schema)


def stream_access_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return stream_json_files(spark, path, schema).withColumn("source", F.lit("nginx"))
