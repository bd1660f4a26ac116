"""Streams and batches of raw messages: one string column ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def topic_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    offsets_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """A topic from its earliest offset, in batches of at most so many messages; needs the Kafka
    connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return reader.options(**options).load().selectExpr("CAST(value AS STRING) AS value")


def topic_sink(messages: DataFrame, servers: str, topic: str) -> None:
    """Send a batch of messages to a topic."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files of JSON lines as they arrive in a directory, in batches of at most so many files."""
    reader = spark.readStream.schema("value STRING").format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_messages(messages: DataFrame, path: str, mode: str = "append") -> None:
    messages.write.mode(mode).text(path)
