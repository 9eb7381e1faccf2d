"""Message streams: one JSON text per row, in the column ``raw_message``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behavior_spark.functions import json_object, parse_event_time, parsed_once
from behavior_spark.functions.jsontext import CORRUPT, STRICT

RAW = "raw_message"
# What a micro-batch takes at most, so that its size does not depend on how long a query was down.
OFFSETS_PER_TRIGGER, FILES_PER_TRIGGER = 5_000_000, 1_000


def kafka_options(brokers: str, topic: str, starting_offsets: str = "earliest", **options: str) -> dict[str, str]:
    """The source's options; what is given wins over the defaults."""
    defaults = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "maxOffsetsPerTrigger": str(OFFSETS_PER_TRIGGER),
    }
    return {**defaults, **options}


def read_kafka(
    spark: SparkSession,
    brokers: str,
    topic: str,
    starting_offsets: str = "earliest",
    **options: str,
) -> DataFrame:
    """Stream of messages from a topic. Needs Spark's Kafka package on the classpath.

    Offsets live in the query's checkpoint, which takes the place of a consumer group.
    Without ``minPartitions`` there is one task per topic partition.
    """
    reader = spark.readStream.format("kafka")
    for key, value in kafka_options(brokers, topic, starting_offsets, **options).items():
        reader = reader.option(key, value)
    return reader.load().select(F.col("value").cast("string").alias(RAW))


def read_text_stream(spark: SparkSession, folder: str, max_files: int = FILES_PER_TRIGGER) -> DataFrame:
    """Stream of messages from text files, one message per line; a micro-batch takes ``max_files`` at most."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(F.col("value").alias(RAW))


def is_malformed(raw: Column | None = None) -> Column:
    """True unless the message is one JSON object."""
    parsed = json_object(F.col(RAW) if raw is None else raw, [], corrupt=True)
    return parsed.isNull() | parsed[CORRUPT].isNotNull()


def split_malformed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good messages and malformed ones; the two frames together are the input.

    Works on batch frames and on streams. Write the second frame to a quarantine table.
    """
    marked = parsed_once(messages, "_malformed", is_malformed())
    return marked.where("NOT _malformed").drop("_malformed"), marked.where("_malformed").drop("_malformed")


def explode_batch(messages: DataFrame) -> DataFrame:
    """One row per event of a client's ``{batch: [...], sentAt}`` envelope.

    A message that is no envelope passes through as itself, so mixed topics stay whole.
    """
    envelope = F.from_json(F.col(RAW), "batch ARRAY<STRING>, sentAt STRING", STRICT)
    opened = parsed_once(messages, "_envelope", envelope).select(
        *[c for c in messages.columns if c != RAW],
        F.explode(F.coalesce(F.col("_envelope.batch"), F.array(F.col(RAW)))).alias(RAW),
        parse_event_time(F.col("_envelope.sentAt")).alias("sent_at"),
    )
    fields = ["type", "event", "userId", "anonymousId", "properties", "timestamp"]
    return opened.withColumn("_message", json_object(F.col(RAW), fields)).select(
        *opened.columns,
        F.col("_message.type").alias("message_type"),
        F.col("_message.event").alias("event"),
        F.col("_message.userId").alias("user_id"),
        F.col("_message.anonymousId").alias("anonymous_id"),
        F.col("_message.properties").alias("properties"),
        F.col("_message.timestamp").alias("event_timestamp"),
    )
