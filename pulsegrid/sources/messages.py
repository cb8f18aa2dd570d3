"""Raw messages from files or from a broker's topics, in one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.topics import topic_matches, validate_filter
from pulsegrid.schemas import MESSAGE


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100, patterns: list[str] | None = None) -> DataFrame:
    """Messages of JSON files as they arrive; the trigger's file limit bounds a micro-batch, in place of a queue that drops."""
    return subscribed(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path), patterns)


def files(spark: SparkSession, path: str, patterns: list[str] | None = None) -> DataFrame:
    return subscribed(spark.read.schema(MESSAGE).json(path), patterns)


def kafka_stream(spark: SparkSession, servers: str, topics: str, rows_per_trigger: int = 100_000) -> DataFrame:
    """Messages that a bridge forwards with the device topic as key. Needs Spark's Kafka package on the class path."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("maxOffsetsPerTrigger", rows_per_trigger).load()
    return rows.select(F.col("key").cast("string").alias("topic"), F.col("value").cast("string").alias("payload"), F.lit(1).alias("qos"), F.lit(False).alias("retain"), F.col("timestamp").alias("received_at"), F.col("offset").alias("seq"))


def subscribed(messages: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Messages of the given topic filters; all if none are given."""
    if not patterns:
        return messages
    wanted = F.lit(False)
    for pattern in dict.fromkeys(patterns):
        wanted = wanted | topic_matches(F.col("topic"), validate_filter(pattern, root_wildcard=True))
    return messages.where(wanted)


def renamed(messages: DataFrame, names: dict[str, str]) -> DataFrame:
    """messages under other topics, as a bridge republishes them; topics without a new name keep theirs."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    return messages.withColumn("topic", F.coalesce(F.try_element_at(pairs, F.col("topic")), F.col("topic")))
