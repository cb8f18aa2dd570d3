"""Series for charts: statistics of trackers, adaptive scores, markers and panes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.evidence import finite

#: Colour and shape of markers by kind of anomaly; fixed values.
MARKERS = {"ml_conformal_static_univariate": "red/circle", "ml_conformal_static_multivariate": "purple/diamond", "ml_adaptive_stream_univariate": "orange/triangle", "ml_adaptive_stream_multivariate": "blue/square"}
COMPACT = ["service_id", "timestamp", "sequence_number", "charger_id", "sensor_set", "input_timestamps", "strategy", "model_type", "anomaly_score", "tracker_results", "threshold", "alarm", "created"]


def compact(evidence: DataFrame) -> DataFrame:
    """The columns that charts need, so that the scan reads no others; those that the table lacks are left out."""
    return evidence.select(*[c for c in COMPACT if c in evidence.columns])


def tracker_series(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, service_id, tracker_id, timestamp, value, threshold): positive finite statistics of static evidence with the tracker's latest threshold.
    Rows without tracker_results stand for a tracker named primary, by their restarted martingale."""
    static = evidence.where("strategy = 'static_baseline'")
    rows = static.select(*keys, "service_id", "timestamp", "sequence_number", F.explode("tracker_results").alias("_t"))
    rows = rows.select(*keys, "service_id", "timestamp", "sequence_number", "_t.tracker_id", F.col("_t.statistic_value").alias("value"), F.col("_t.threshold").alias("threshold"))
    legacy = static.where("coalesce(size(tracker_results), 0) <= 0").select(*keys, "service_id", "timestamp", "sequence_number", F.lit("primary").alias("tracker_id"), F.col("restarted_martingale").alias("value"), "threshold")
    every = rows.unionByName(legacy)
    latest = every.where(finite(F.col("threshold")).isNotNull()).groupBy(*keys, "service_id", "tracker_id").agg(F.max_by("threshold", F.struct("timestamp", "sequence_number")).alias("threshold"))
    shown = every.drop("threshold").where(finite(F.col("value")).isNotNull() & (F.col("value") > 0)).drop("sequence_number")
    return shown.join(latest, [*keys, "service_id", "tracker_id"], "left")


def adaptive_series(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, service_id, timestamp, value, threshold): finite scores of adaptive evidence with the service's latest threshold."""
    rows = evidence.where("strategy = 'adaptive_stream'")
    latest = rows.where(finite(F.col("threshold")).isNotNull()).groupBy(*keys, "service_id").agg(F.max_by("threshold", F.struct("timestamp", "sequence_number")).alias("threshold"))
    return rows.where(finite(F.col("anomaly_score")).isNotNull()).select(*keys, "service_id", "timestamp", F.col("anomaly_score").alias("value")).join(latest, [*keys, "service_id"], "left")


def pane_top(series: DataFrame, keys: list[str]) -> DataFrame:
    """The top of a pane: the largest of 1, the thresholds and the values."""
    return series.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.max("value"), F.max("threshold")).alias("top"))


def marker_style(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair]), kind), F.lit("red/circle"))


def for_sensor(evidence: DataFrame, sensor: str, start: Column | None = None, end: Column | None = None, service_id: str | None = None) -> DataFrame:
    """Evidence of a sensor whose own event time lies in the range, of one service if given."""
    from pulsegrid.operators.series import within

    rows = evidence.where(F.array_contains("sensor_set", sensor)).withColumn("sensor_time", F.try_element_at("input_timestamps", F.lit(sensor)))
    rows = rows.where(F.col("sensor_time").isNotNull() & within(F.col("sensor_time"), start, end))
    return rows if service_id is None else rows.where(F.col("service_id") == service_id)


def chart_model(telemetry: DataFrame, evidence: DataFrame, anomalies: DataFrame, marker_seconds: float = 5.0, zone_seconds: float = 300.0) -> DataFrame:
    """All parts of the charts of chargers in one table: charger_id, part, series, time, until, value, threshold, label.

    telemetry: charger_id, timestamp, value, arrival; evidence; anomalies: charger_id, timestamp, anomaly_type, arrival. Parts are the readings, those pending since the latest evidence, the zones of anomalies (value: their number), the
    markers of readings with an anomaly near (label: colour and shape), the statistics of trackers and the adaptive scores at the times of readings, and the extent of what is shown.
    """
    from pulsegrid.operators import matching, series

    keys = ["charger_id"]

    def part(name: str, rows: DataFrame, **columns: Column) -> DataFrame:
        empty = {"series": F.lit(None).cast("string"), "until": F.lit(None).cast(telemetry.schema["timestamp"].dataType), "value": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "label": F.lit(None).cast("string")}
        made = {"time": F.col("timestamp")} | empty | columns
        return rows.select("charger_id", F.lit(name).alias("part"), *[made[c].alias(c) for c in ("series", "time", "until", "value", "threshold", "label")])

    value = F.col("value").cast("double")
    readings = part("telemetry", telemetry, value=value)
    pending = part("pending", series.pending_points(telemetry, evidence, keys, "timestamp"), value=value)
    zones = part("zone", series.zones(anomalies, keys, "timestamp", zone_seconds), time=F.col("zone_start"), until=F.col("zone_end"), value=F.col("members").cast("double"))
    found = anomalies.select("charger_id", F.col("timestamp").alias("anomaly_time"), "anomaly_type", F.col("arrival").alias("position"))
    markers = part("marker", matching.first_match(telemetry, found, keys, "timestamp", "anomaly_time", "position", marker_seconds), value=value, label=marker_style(F.col("anomaly_type")))
    times = telemetry.select("charger_id", "timestamp").distinct()
    trackers = part("tracker", tracker_series(evidence, keys).join(times, ["charger_id", "timestamp"], "left_semi"), series=F.concat_ws("/", "service_id", "tracker_id"), value=value, threshold=F.col("threshold"))
    adaptive = part("adaptive", adaptive_series(evidence, keys).join(times, ["charger_id", "timestamp"], "left_semi"), series=F.col("service_id"), value=value, threshold=F.col("threshold"))
    shown = readings.unionByName(trackers).unionByName(adaptive)
    extent = shown.groupBy("charger_id").agg(F.min("time").alias("timestamp"), F.max("time").alias("last"))
    return shown.unionByName(pending).unionByName(zones).unionByName(markers).unionByName(part("extent", extent, until=F.col("last")))
