"""Joins in time: tolerance bands, nearest points, exact event times, and joins on overlapping topic filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.topics import filters_overlap
from pulsegrid.operators import scan
from pulsegrid.schemas import MULTIVARIATE


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def nearest_millis(ts: Column) -> Column:
    """The nearest whole millisecond since 1970; halves go away from 1970. It is what SQL's epoch_ms gives; unix_millis would cut the rest off."""
    n = micros(ts)
    up = F.abs(n) + 500
    away = ((up - up % 1000) / 1000).cast("long")
    return F.when(n < 0, -away).otherwise(away)


def _marks(right: DataFrame, keys: list[str], time: str, position: str) -> DataFrame:
    """Rows of right with a time and all keys as marks: keys, _at, _position, and _row, the other columns."""
    rest = [c for c in right.columns if c not in keys]
    return right.dropna(subset=[*keys, time]).select(*keys, micros(F.col(time)).alias("_at"), F.col(position).cast("long").alias("_position"), F.struct(*rest).alias("_row"), F.lit(True).alias("_mark"))


def _swept(rows: DataFrame, marks: DataFrame, keys: list[str], order: list[Column], fold: Callable[[DataFrame], scan.Fold]) -> DataFrame:
    """rows, which have _at, with what the fold makes of the marks before them. Both sides are united and sorted: no row meets another one."""
    both = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    made = scan.scanned(both, keys, order, fold(both)).where("not _mark")
    return made.drop(*[c for c in marks.columns if c not in rows.columns])


def first_match(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, position: str, tolerance_seconds: float = 5.0) -> DataFrame:
    """left rows that have a row of right within the tolerance, with that of the smallest position, a whole number: markers of anomalies on a series.

    Buckets of time are as wide as the tolerance. What lies within it is all of a row's own bucket, the end of the one before and the beginning of the next; the least position in
    these comes from a group by, and from scans over both sides in order of time, one from either end. Rows without a time or a key match nothing; equal rows are matched each.
    """
    width = max(1, int(tolerance_seconds * 1_000_000))
    own, bucket = left.columns, lambda at: F.floor(at / width).cast("long")
    marks = _marks(right, keys, right_time, position).withColumn("_bucket", bucket(F.col("_at")))
    whole = marks.groupBy(*keys, F.col("_bucket").alias("_here")).agg(F.min_by(F.struct("_position", "_row"), "_position").alias("_whole"))
    rows = left.withColumn("_t", micros(F.col(left_time))).withColumn("_here", bucket(F.col("_t"))).join(whole, [*keys, "_here"], "left").drop("_here")
    pair = marks.withColumn("_value", F.struct("_position", "_row")).drop("_row")
    for name, at, order in (("_ahead", F.col("_t") + width, F.col("_at").asc()), ("_behind", F.col("_t") - width, F.col("_at").desc())):
        rows = rows.withColumn("_at", at).withColumn("_bucket", bucket(F.col("_at")))
        rows = _swept(rows, pair, keys, [order, F.col("_mark").desc()], lambda both, name=name: scan.BucketLeast("_mark", "_bucket", "_position", "_value", name, both.schema))
    found = [F.col(c) for c in ("_whole", "_ahead", "_behind")]
    least = F.least(*[c["_position"] for c in found])
    best = F.coalesce(*[F.when(c["_position"] == least, c["_row"]) for c in found])
    rest = [c for c in right.columns if c not in keys]
    made = rows.where(F.col("_t").isNotNull()).withColumn("_best", best).where("_best is not null")
    return made.select(*[F.col(c) for c in own], *[F.col(f"_best.{c}").alias(c) for c in rest])


def has_match(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance_seconds: float = 5.0) -> DataFrame:
    """left rows for which right has a row within the tolerance."""
    width = max(1, int(tolerance_seconds * 1_000_000))
    bucket = lambda c: F.floor(micros(F.col(c)) / width)
    spread = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(right_time).alias("_time"), F.explode(F.array(*[bucket(right_time) + k for k in (-1, 0, 1)])).alias("_spot"))
    on = (bucket(left_time) == F.col("_spot")) & (F.abs(micros(F.col(left_time)) - micros(F.col("_time"))) <= width)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return left.join(spread, on, "left_semi")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, position: str, most_seconds: float = 60.0) -> DataFrame:
    """left rows with the nearest row of right within the bound; of equally near ones that of the smallest position, a whole number.

    Both sides are united and sorted by time; two scans, one from either end, carry the last row of right on. Rows without a time or a key match nothing; equal rows are matched each.
    """
    width, own = max(1, int(most_seconds * 1_000_000)), left.columns
    marks = _marks(right, keys, right_time, position).withColumn("_value", F.struct("_at", "_position", "_row"))
    rows = left.withColumn("_at", micros(F.col(left_time))).where("_at is not null")
    for name, order in (("_before", F.col("_at").asc()), ("_after", F.col("_at").desc())):
        rows = _swept(rows, marks, keys, [order, F.col("_mark").desc(), F.col("_position").desc()], lambda both, name=name: scan.Carried("_mark", {"_value": name}, both.schema))
    gaps = [F.abs(F.col(c)["_at"] - F.col("_at")) for c in ("_before", "_after")]
    earlier = gaps[1].isNull() | (gaps[0] < gaps[1]) | ((gaps[0] == gaps[1]) & (F.col("_before._position") <= F.col("_after._position")))
    rest = [c for c in right.columns if c not in keys]
    made = rows.withColumn("_best", F.when(gaps[0].isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after"))).where(F.abs(F.col("_best._at") - F.col("_at")) <= width)
    return made.select(*[F.col(c) for c in own], *[F.col(f"_best._row.{c}").alias(c) for c in rest])


def applicable(anomalies: DataFrame, series: DataFrame) -> DataFrame:
    """anomalies with each type of `series` (charger_id, type) that they belong to: their own, or, if multivariate, every type of their set, or
    every type of the charger where the set is missing or empty."""
    several = anomalies["telemetry_type"] == MULTIVARIATE
    named = F.coalesce(F.size(anomalies["sensor_set"]) > 0, F.lit(False))
    types = series.select(F.col("charger_id").alias("_charger"), "type").distinct()
    # equality where the type is named, the charger's types where it is not
    exact = anomalies.withColumn("_type", F.explode(F.when(~several, F.array("telemetry_type")).when(named, F.array_distinct("sensor_set")).otherwise(F.array().cast("array<string>"))))
    exact = exact.join(types, (F.col("charger_id") == F.col("_charger")) & (F.col("_type") == F.col("type"))).drop("_charger", "_type")
    legacy = anomalies.where(several & ~named).join(types, F.col("charger_id") == F.col("_charger")).drop("_charger")
    return exact.unionByName(legacy)


def evidence_points(evidence: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Evidence rows exploded by sensor, where the sensor's event time is, to the nearest millisecond, that of a reading."""
    rows = evidence.select(*[c for c in evidence.columns if c != "input_timestamps"], F.explode("input_timestamps").alias("type", "event_ts"))
    times = telemetry.select(F.col("charger_id").alias("_c"), F.col("type").alias("_t"), nearest_millis(F.col("timestamp")).alias("_ms")).distinct()
    on = (F.col("charger_id") == F.col("_c")) & (F.col("type") == F.col("_t")) & (nearest_millis(F.col("event_ts")) == F.col("_ms"))
    return rows.join(times, on, "left_semi")


def with_gaps(telemetry: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """A score for each telemetry time, null where there is none."""
    return telemetry.select(*keys).distinct().join(scores, keys, "left")


def _keyed_levels(frame: DataFrame, column: str, own: str, other: str) -> DataFrame:
    """A row for each set of the first three levels that a filter to be met may have fixed: the two sets, as bits, and the tokens of the levels in both."""
    levels = F.split(column, "/")
    first = [F.coalesce(F.get(levels, F.lit(k)), F.lit("#")) for k in range(3)]
    fixed = [reduce(Column.__and__, [x != "#" for x in first[: k + 1]]) & (first[k] != "+") for k in range(3)]
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fixed)), F.lit(0))
    rows = frame.withColumn(own, bits).withColumn(other, F.explode(F.array(*map(F.lit, range(8)))))
    shared = F.col(own).bitwiseAND(F.col(other))
    return rows.withColumn("_tokens", F.array(*[F.when(shared.bitwiseAND(1 << k) > 0, x) for k, x in enumerate(first)])).withColumn("_tokens", F.to_json("_tokens"))


def overlapping(left: DataFrame, right: DataFrame, left_filter: str, right_filter: str) -> DataFrame:
    """Pairs of rows whose topic filters can match one topic. Two filters meet on the tokens of those of the first three levels that both of them fix: each goes to eight keys, one for each
    set of levels that the other may fix, and a pair has exactly one in common."""
    a, b = _keyed_levels(left, left_filter, "_l", "_r"), _keyed_levels(right, right_filter, "_r", "_l")
    return a.join(b, ["_l", "_r", "_tokens"]).where(filters_overlap(F.col(left_filter), F.col(right_filter))).drop("_l", "_r", "_tokens")


def sensor_claims(sensors: DataFrame, services: DataFrame) -> DataFrame:
    """Each (charger_id, type) with the first service, active ones first and then the newest, that has a filter for it.
    services: id, mqtt_topic (array), active, created_at."""
    wanted = sensors.select("charger_id", "type", F.concat_ws("/", F.lit("device/evCharger"), "charger_id", "type").alias("_topic")).distinct()
    filters = services.select("id", "active", "created_at", F.explode("mqtt_topic").alias("_filter"))
    found = overlapping(wanted, filters, "_topic", "_filter")
    rank = Window.partitionBy("charger_id", "type").orderBy(F.col("active").desc(), F.col("created_at").desc(), "id")
    return found.withColumn("_n", F.row_number().over(rank)).where("_n = 1").select("charger_id", "type", F.col("id").alias("service_id"))


def topic_conflicts(requested: DataFrame, active: DataFrame) -> DataFrame:
    """Pairs (topic, service_id, claimed) of requested topics (topic) and claims of active services (service_id, claimed) that overlap."""
    return overlapping(requested, active, "topic", "claimed").select("topic", "service_id", "claimed").distinct()


def services_of(services: DataFrame, charger_id: str) -> DataFrame:
    """Services with a filter that can match a topic of the charger."""
    return services.where(F.exists("mqtt_topic", lambda t: filters_overlap(t, F.lit(f"device/evCharger/{charger_id}/#"))))
