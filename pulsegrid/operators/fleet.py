"""Aggregates over the fleet and the services: counts, cursors, health, operational status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed limits of writer and sink health.
SUCCESS_BAD, SUCCESS_WARN, LATENCY_BAD, LATENCY_WARN, FLIGHT_BAD, FLIGHT_WARN = 95.0, 98.0, 5.0, 2.0, 10, 5
HEARTBEAT_SECONDS = 120


def status_counts(chargers: DataFrame) -> DataFrame:
    return chargers.agg(F.count("*").alias("all_chargers"), F.count_if("online").alias("online"), F.count_if(~F.col("online")).alias("offline"))


def search(chargers: DataFrame, text: str, online: bool | None = None) -> DataFrame:
    """Chargers whose id or name has the text, whatever its case, of one status or of both."""
    low = F.lit(text.lower())
    found = chargers.where(F.lower("charger_id").contains(low) | F.lower("charger_name").contains(low))
    return found if online is None else found.where(F.col("online") == F.lit(online))


def service_counts(services: DataFrame) -> DataFrame:
    """services: workload (the state of its container, in any case), strategy."""
    state = F.lower("workload")
    return services.agg(F.count_if(state == "running").alias("running"), F.count_if(state == "not_found").alias("missing"), F.count_if(F.col("strategy") == "static_baseline").alias("static"))


def last_arrivals(messages: DataFrame, arrival: str = "arrival") -> DataFrame:
    """(charger_id, last_message, message_count): the event time of what arrived last, which need not be the latest."""
    return messages.groupBy("charger_id").agg(F.max_by("timestamp", arrival).alias("last_message"), F.count("*").alias("message_count"))


def cursor(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The lexicographically largest tuple of the columns."""
    return rows.agg(F.max(F.struct(*columns)).alias("_c")).select(*[F.col(f"_c.{c}").alias(c) for c in columns])


def writer_metrics(batches: DataFrame, keys: list[str]) -> DataFrame:
    """batches: ok (boolean), latency_s, records, in_flight, at. Success in percent, latency of successful batches, records a second between first and last."""
    total, good = F.count("*"), F.count_if("ok")
    span = F.unix_timestamp(F.max("at").cast("timestamp")) - F.unix_timestamp(F.min("at").cast("timestamp"))
    return batches.groupBy(*keys).agg(
        total.alias("batches"), good.alias("batches_ok"), (good * 100.0 / total).alias("success_rate"), F.coalesce(F.avg(F.when(F.col("ok"), F.col("latency_s"))), F.lit(0.0)).alias("avg_latency"),
        F.when(span > 0, F.sum("records") / span).otherwise(0.0).alias("records_per_second"), F.when(span > 0, total * 60.0 / span).otherwise(0.0).alias("batches_per_minute"), F.max("in_flight").alias("in_flight"),
    )


def health(success_rate: Column, latency: Column, in_flight: Column) -> Column:
    """The worse of two grades wins."""
    bad = (success_rate < SUCCESS_BAD) | (latency > LATENCY_BAD) | (in_flight > FLIGHT_BAD)
    warn = (success_rate < SUCCESS_WARN) | (latency > LATENCY_WARN) | (in_flight > FLIGHT_WARN)
    return F.when(bad, "unhealthy").when(warn, "degraded").otherwise("healthy")


def destination_metrics(routed: DataFrame) -> DataFrame:
    """routed: destination, ok, seconds."""
    return routed.groupBy("destination").agg(F.count("*").alias("messages"), F.count_if("ok").alias("delivered"), (F.count_if("ok") * 100.0 / F.count("*")).alias("success_rate"), F.avg("seconds").alias("avg_seconds"))


def processor_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: processed, anomaly, error (booleans), one for each message received."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("received"), F.count_if("processed").alias("processed"), F.count_if("anomaly").alias("anomalies"), F.count_if("error").alias("errors"))
    return counts.withColumn("anomaly_rate", F.col("anomalies") / F.greatest("processed", F.lit(1))).withColumn("error_rate", F.col("errors") / F.greatest("received", F.lit(1)))


def active_alerts(connected: Column, error_rate: Column, memory_mb: Column, memory_limit: Column, queue_share: Column, breaker_open: Column) -> Column:
    found = [F.when(~connected, "mqtt_disconnected"), F.when(error_rate > 0.1, "high_error_rate"), F.when(memory_mb > memory_limit * 0.9, "high_memory_usage"), F.when(queue_share > 0.8, "queue_backlog"), F.when(breaker_open, "circuit_breaker_open")]
    return F.array_compact(F.array(*found))


def service_status(alerts: Column, database_ok: Column) -> Column:
    """Without its database or its broker a service has failed; with other alerts it is degraded."""
    return F.when(~database_ok | F.array_contains(alerts, "mqtt_disconnected"), "failed").when(F.size(alerts) > 0, "degraded").otherwise("healthy")


def operational_stage(status: Column, messages: Column, aligned: Column, samples: Column, train: Column, calibrate: Column, failed: Column) -> Column:
    """struct(stage, current, target) of a detector's life."""
    of = lambda stage, current=None, target=None: F.struct(F.lit(stage).alias("stage"), (current if current is not None else F.lit(None)).cast("long").alias("current"), (target if target is not None else F.lit(None)).cast("long").alias("target"))
    return (
        F.when(failed | (status == "failed"), of("error"))
        .when(status == "starting", of("starting"))
        .when(messages == 0, of("waiting_for_data"))
        .when(~aligned, of("aligning"))
        .when(samples < train, of("collecting", samples, train))
        .when(samples < train + calibrate, of("calibrating", samples - train, calibrate))
        .otherwise(of("operational"))
    )


def effective_stage(stage: Column, workload: Column, heartbeat: Column, now: Column) -> Column:
    """struct(stage, is_stale): terminal workload states override what was reported; an old heartbeat marks it stale."""
    terminal = workload.isin("exited", "dead", "failed", "removing", "stopped", "not_found")
    old = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(heartbeat.cast("timestamp")) > HEARTBEAT_SECONDS
    stale = ~terminal & (heartbeat.isNull() | old)
    return F.struct(F.when(terminal, F.when(workload.isin("failed", "dead"), "error").otherwise("stopped")).otherwise(F.coalesce(stage, F.lit("unknown"))).alias("stage"), F.coalesce(stale, F.lit(True)).alias("is_stale"))


def expired(services: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Terminal services last updated more than the hours ago: what a reconciliation purges."""
    return services.where(F.col("operational_stage").isin("stopped", "error") & (F.col("operational_updated_at") < now - F.expr(f"interval {hours} hours")))
