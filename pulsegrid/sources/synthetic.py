"""Synthetic device messages: sine, cosine or random features with rare blips, as a batch or from a rate stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("sine", "cosine", "random")


def value(feature: Column, charger: Column, tick: Column, seed: int, low: float = 0.0, high: float = 100.0, blip_chance: float = 0.0, blip_factor: float = 3.0) -> Column:
    """A base of 28 + 6 for each charger; waves of amplitude 8 with a little noise; clamped, rounded to four places, and at times multiplied."""
    base, phase = 28.0 + 6.0 * charger, tick / 10.0 + 0.6 * charger
    noise = F.rand(seed) * 1.6 - 0.8
    raw = F.when(feature == "sine", base + 8.0 * F.sin(phase) + noise).when(feature == "cosine", base + 8.0 * F.cos(phase) + noise).otherwise(base + 10.0 * F.rand(seed + 1))
    held = F.greatest(F.lit(low), F.least(F.lit(high), raw))
    return F.round(F.when(F.rand(seed + 2) < blip_chance, held * blip_factor).otherwise(held), 4)


def _messages(ticks: DataFrame, tick: Column, at: Column, chargers: int, seed: int, blip_chance: float) -> DataFrame:
    rows = ticks.select(tick.alias("tick"), at.alias("received_at"), F.explode(F.sequence(F.lit(0), F.lit(chargers - 1))).alias("charger"))
    rows = rows.select("tick", "received_at", "charger", F.explode(F.array(*map(F.lit, FEATURES))).alias("feature"))
    payload = F.to_json(F.struct(value(F.col("feature"), F.col("charger"), F.col("tick"), seed, blip_chance=blip_chance).alias("value"), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    topic = F.concat(F.lit("device/evCharger/charger-"), F.col("charger").cast("string"), F.lit("/"), "feature")
    seq = (F.col("tick") * chargers + F.col("charger")) * len(FEATURES) + F.array_position(F.array(*map(F.lit, FEATURES)), F.col("feature")) - 1
    return rows.select(topic.alias("topic"), payload.alias("payload"), F.lit(1).alias("qos"), F.lit(False).alias("retain"), "received_at", seq.cast("long").alias("seq"))


def batch(spark: SparkSession, ticks: int, chargers: int = 2, seed: int = 0, blip_chance: float = 0.0, start: str = "2024-01-01 00:00:00") -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("id"))
    return _messages(spark.range(ticks), F.col("id"), at, chargers, seed, blip_chance)


def stream(spark: SparkSession, chargers: int = 2, seed: int = 0, blip_chance: float = 0.0, ticks_per_second: int = 1) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", ticks_per_second).load()
    return _messages(rate, F.col("value"), F.col("timestamp"), chargers, seed, blip_chance)
