"""Evidence and anomaly rows from detector results, their normal forms, and backfills of older rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import anomaly_id
from pulsegrid.schemas import MULTIVARIATE

MAX_TRACKERS = 16


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def persisted(results: DataFrame) -> DataFrame:
    """Results worth keeping: alarms, and those of detectors that are past calibration."""
    return results.where("is_anomaly or (strategy = 'static_baseline' and phase = 'ready') or (strategy = 'adaptive_stream' and phase = 'operational')")


def telemetry_type(features: Column, topic_type: Column) -> Column:
    return F.when(F.size(features) > 1, MULTIVARIATE).otherwise(F.coalesce(topic_type, F.lit("unknown")))


def anomaly_type(strategy: Column, kind: Column) -> Column:
    lane = F.when(strategy == "static_baseline", "conformal_static").when(strategy == "adaptive_stream", "adaptive_stream").otherwise("tailprob")
    return F.concat(F.lit("ml_"), lane, F.when(kind == MULTIVARIATE, "_multivariate").otherwise("_univariate"))


def anomaly_value(p_value: Column, tail_p: Column, score: Column) -> Column:
    return F.coalesce(finite(p_value), finite(tail_p), finite(score))


def value_type(anomaly_kind: Column) -> Column:
    """What an anomaly's value is, where nothing was said: adaptive results fall to the default, as older rows have them."""
    return F.when(anomaly_kind.startswith("ml_conformal_"), "conformal_pvalue").when(anomaly_kind.startswith("ml_tailprob_"), "tail_pvalue").otherwise("zscore")


def result_value_type(strategy: Column) -> Column:
    return F.when(strategy == "static_baseline", "conformal_pvalue").when(strategy == "adaptive_stream", "anomaly_score").otherwise("tail_pvalue")


def sensor_set(aligned: Column, features: Column, kind: Column) -> Column:
    """The aligned sensors, else the names of the features, else the one type that is no marker."""
    return F.coalesce(F.when(F.size(aligned) > 0, F.array_distinct(aligned)), F.when(F.size(features) > 0, F.array_sort(F.map_keys(features))), F.when(kind != MULTIVARIATE, F.array(kind)))


def complete_inputs(rows: DataFrame) -> DataFrame:
    """Rows whose input_timestamps has a time for every sensor of sensor_set, those alone, with `timestamp` the latest of them."""
    kept = F.map_filter("input_timestamps", lambda k, v: F.array_contains("sensor_set", k) & v.isNotNull())
    rows = rows.withColumn("input_timestamps", kept).where("size(sensor_set) > 0 and size(input_timestamps) = size(array_distinct(sensor_set))")
    return rows.withColumn("timestamp", F.array_max(F.map_values("input_timestamps")))


def valid_evidence(rows: DataFrame) -> DataFrame:
    """Rows that the table accepts: a finite p-value for the static lane, a finite score for the adaptive one, a sequence from 1, a finite threshold."""
    static = (F.col("strategy") == "static_baseline") & finite(F.col("p_value")).isNotNull()
    adaptive = (F.col("strategy") == "adaptive_stream") & finite(F.col("anomaly_score")).isNotNull()
    return rows.where((static | adaptive) & (F.col("sequence_number") >= 1) & finite(F.col("threshold")).isNotNull())


def normal_trackers(trackers: Column) -> Column:
    """At most 16 trackers with names and a finite threshold; values that aren't finite become null."""
    named = F.filter(F.slice(F.coalesce(trackers, F.array().cast("array<struct<tracker_id:string,alarm_statistic:string,statistic_value:double,threshold:double>>")), 1, MAX_TRACKERS), lambda t: (F.length(t["tracker_id"]) > 0) & (F.length(t["alarm_statistic"]) > 0) & finite(t["threshold"]).isNotNull())
    return F.transform(named, lambda t: t.withField("statistic_value", finite(t["statistic_value"])).withField("statistic_is_infinite", F.coalesce(t["statistic_value"] == float("inf"), F.lit(False))))


def anomaly_rows(evidence: DataFrame) -> DataFrame:
    """Anomalies of evidence with an alarm."""
    kind = F.when(F.size("sensor_set") > 1, MULTIVARIATE).otherwise(F.coalesce(F.get("sensor_set", F.lit(0)), F.lit("unknown")))
    rows = evidence.where("alarm").withColumn("telemetry_type", kind)
    return rows.select(
        "charger_id", "timestamp", "telemetry_type", anomaly_type(F.col("strategy"), F.col("telemetry_type")).alias("anomaly_type"),
        anomaly_value(F.col("p_value"), F.lit(None).cast("double"), F.col("anomaly_score")).alias("anomaly_value"), result_value_type(F.col("strategy")).alias("value_type"), "sensor_set",
    )


def identities(anomalies: DataFrame) -> DataFrame:
    """One identity for each anomaly key, the same on every run."""
    keys = anomalies.select("charger_id", "timestamp", "telemetry_type").distinct()
    return keys.select(anomaly_id(F.col("charger_id"), F.col("timestamp"), F.col("telemetry_type")).alias("anomaly_id"), "*")


def missing_identities(anomalies: DataFrame, known: DataFrame) -> DataFrame:
    return identities(anomalies).join(known.select("charger_id", "timestamp", "telemetry_type"), ["charger_id", "timestamp", "telemetry_type"], "left_anti")


def backfilled(anomalies: DataFrame) -> DataFrame:
    """Older anomalies completed: value types by their kind, sensor sets of univariate ones."""
    kind = F.coalesce("value_type", value_type(F.col("anomaly_type")))
    own = F.when(F.col("sensor_set").isNull() & (F.col("telemetry_type") != MULTIVARIATE), F.array("telemetry_type")).otherwise(F.col("sensor_set"))
    return anomalies.withColumn("value_type", kind).withColumn("sensor_set", own)


def create(anomalies: DataFrame, new: DataFrame) -> DataFrame:
    """new rows whose key is free; what is left over is a conflict."""
    return new.join(anomalies.select("charger_id", "timestamp", "telemetry_type"), ["charger_id", "timestamp", "telemetry_type"], "left_anti")
