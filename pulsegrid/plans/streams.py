"""Queries of ordered recursions: alignment, lanes, guards. SQL has no plain form for most; they are tested against scripted cases."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pulsegrid.functions.payloads import parse_for_detection
from pulsegrid.operators import sequential, thresholds
from pulsegrid.plans import tables as t
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import sql
from pulsegrid.shared import cut
from pulsegrid.sources import synthetic
from pulsegrid.streaming import alignment, controls, lanes


def _readings(spark, sf):
    rows = t.telemetry(spark, sf, dense=True).where("type in ('click', 'error', 'view')")
    at = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000.0
    return rows.select("charger_id", F.col("type").alias("sensor"), "value", at.alias("received_at"), at.alias("event_ts"), F.col("arrival").alias("seq"))


@query(sql("""SELECT charger_id, arrival AS seq, CASE WHEN type = 'click' THEN 'direct_pass_through' ELSE 'ignored_sensor' END AS status, CASE WHEN type = 'click' THEN value END AS value, CASE WHEN type = 'click' THEN epoch_us("timestamp") / 1000000.0::DOUBLE END AS sample_timestamp FROM dense WHERE type IN ('click', 'error', 'view')""", "dense"))
def direct_pass_through(spark, sf):
    rows = alignment.align(_readings(spark, sf), ["click"])
    return rows.select("charger_id", "seq", "status", F.try_element_at("features", F.lit("click")).alias("value"), "sample_timestamp")


#: A charger's readings one after another; `emitted` is the place of its last vector. What is held of a sensor is its reading of the largest place so far.
_SENSORS = {"c": "click", "e": "error", "v": "view"}
_BARRIER = sql(", m AS MATERIALIZED (SELECT charger_id, arrival AS seq, type, value, epoch_us(\"timestamp\") / 1000000.0::DOUBLE AS stamp, row_number() OVER (PARTITION BY charger_id ORDER BY arrival) AS n, "
+ ", ".join(f"max(CASE WHEN type = '{t}' THEN arrival END) OVER (PARTITION BY charger_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS {k}" for k, t in _SENSORS.items()) + " FROM dense WHERE type IN ('click', 'error', 'view')),\n"
+ "w AS MATERIALIZED (SELECT m.charger_id, m.seq, m.n, m.c, m.e, m.v, " + ", ".join(f"{k}_.value AS {k}_value, {k}_.stamp AS {k}_stamp, coalesce(m.stamp - {k}_.stamp > 1800.0::DOUBLE, false) AS {k}_stale" for k in _SENSORS)
+ " FROM m " + " ".join(f"LEFT JOIN m {k}_ ON {k}_.seq = m.{k}" for k in _SENSORS) + """),
r AS (SELECT charger_id, n, seq, -1::BIGINT AS before, CASE WHEN c IS NOT NULL AND e IS NOT NULL AND v IS NOT NULL THEN seq ELSE -1 END AS emitted FROM w WHERE n = 1
UNION ALL SELECT w.charger_id, w.n, w.seq, r.emitted, CASE WHEN least(w.c, w.e, w.v) > r.emitted AND w.c IS NOT NULL AND w.e IS NOT NULL AND w.v IS NOT NULL AND NOT (c_stale OR e_stale OR v_stale) THEN w.seq ELSE r.emitted END FROM r JOIN w ON w.charger_id = r.charger_id AND w.n = r.n + 1)
SELECT charger_id, seq, status, CASE status WHEN 'waiting_for_all' THEN concat_ws(',', CASE WHEN c IS NULL THEN 'click' END, CASE WHEN e IS NULL THEN 'error' END, CASE WHEN v IS NULL THEN 'view' END) WHEN 'stale_sensor_block' THEN concat_ws(',', CASE WHEN c_stale THEN 'click' END, CASE WHEN e_stale THEN 'error' END, CASE WHEN v_stale THEN 'view' END)
WHEN 'waiting_for_barrier' THEN concat_ws(',', CASE WHEN c <= before THEN 'click' END, CASE WHEN e <= before THEN 'error' END, CASE WHEN v <= before THEN 'view' END) ELSE '' END AS blocking,
CASE WHEN status = 'aligned_emit' THEN c_value END AS click, CASE WHEN status = 'aligned_emit' THEN e_value END AS error, CASE WHEN status = 'aligned_emit' THEN v_value END AS "view", CASE WHEN status = 'aligned_emit' THEN greatest(c_stamp, e_stamp, v_stamp) END AS sample_timestamp
FROM (SELECT w.*, r.before, CASE WHEN c IS NULL OR e IS NULL OR v IS NULL THEN 'waiting_for_all' WHEN c_stale OR e_stale OR v_stale THEN 'stale_sensor_block' WHEN r.emitted <> w.seq THEN 'waiting_for_barrier' ELSE 'aligned_emit' END AS status FROM w JOIN r ON r.charger_id = w.charger_id AND r.n = w.n) t""", "dense").replace("WITH", "WITH RECURSIVE", 1)


@query(_BARRIER)
def barrier_align(spark, sf):
    rows = alignment.align(_readings(spark, sf), ["click", "error", "view"], 1800.0)
    values = [F.try_element_at("features", F.lit(s)).alias(s) for s in ("click", "error", "view")]
    return rows.select("charger_id", "seq", "status", F.array_join("blocking", ",").alias("blocking"), *values, "sample_timestamp")


def _vectors(spark, sf):
    rows = t.telemetry(spark, sf, dense=True)
    return rows.select(F.concat(F.lit("svc-"), "charger_id").alias("service_id"), F.col("arrival").alias("seq"), F.create_map(F.lit("value"), F.col("value"), F.lit("phase"), (F.col("arrival") % 17).cast("double")).alias("features"))


@query()
def static_lane(spark, sf):
    return lanes.static_lane(_vectors(spark, sf), "hbos", train=400, calibrate=200)


@query()
def adaptive_lane(spark, sf):
    return lanes.adaptive_lane(_vectors(spark, sf), "half_space_trees", warm_up=300, calibrate=200, q=0.99, params={"window_size": 100})


#: `held` are the times of the last accepted messages, in their order; those at its front that are an hour old go first.
_LIMIT = sql(""", m AS MATERIALIZED (SELECT charger_id AS key, arrival AS seq, epoch_us("timestamp") / 1000000.0::DOUBLE AS stamp, row_number() OVER (PARTITION BY charger_id ORDER BY arrival) AS n FROM dense),
r AS (SELECT key, seq, n, true AS accepted, [stamp] AS held FROM m WHERE n = 1
UNION ALL SELECT key, seq, n, len(kept) < 4, CASE WHEN len(kept) < 4 THEN list_append(kept, stamp) ELSE kept END FROM (SELECT m.key, m.seq, m.n, m.stamp, list_slice(r.held, coalesce(nullif(list_position(list_transform(r.held, lambda t: m.stamp - t < 3600.0::DOUBLE), true), 0), len(r.held) + 1), len(r.held)) AS kept FROM r JOIN m ON m.key = r.key AND m.n = r.n + 1))
SELECT key, seq, accepted FROM r""", "dense")


@query(_LIMIT.replace("WITH", "WITH RECURSIVE", 1))
def rate_limit(spark, sf):
    at = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000.0
    return controls.rate_limit(t.telemetry(spark, sf, dense=True).select(F.col("charger_id").alias("key"), F.col("arrival").alias("seq"), at.alias("at")), 4, 3600.0)


#: A message after another: the time of the opening that holds, if one does, and the errors kept.
_BREAK = sql(""", m AS MATERIALIZED (SELECT charger_id AS key, arrival AS seq, type = 'error' AS error, max(epoch_us("timestamp") / 1000000.0::DOUBLE) OVER (PARTITION BY charger_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS clock, row_number() OVER (PARTITION BY charger_id ORDER BY arrival) AS n FROM dense),
r AS (SELECT key, seq, n, false AS open, CASE WHEN error THEN 1 ELSE 0 END AS errors, NULL::DOUBLE AS opened FROM m WHERE n = 1
UNION ALL SELECT key, seq, n, still, CASE WHEN error AND NOT still THEN least(errors + 1, 100) ELSE errors END, CASE WHEN still THEN opened WHEN error AND least(errors + 1, 100) / 100.0::DOUBLE > 0.1::DOUBLE THEN clock END
FROM (SELECT m.key, m.seq, m.n, m.error, m.clock, r.errors, r.opened, coalesce(m.clock < r.opened + 21600.0::DOUBLE, false) AS still FROM r JOIN m ON m.key = r.key AND m.n = r.n + 1) t)
SELECT key, seq, open, errors::BIGINT AS errors FROM r""", "dense").replace("WITH", "WITH RECURSIVE", 1)


@query(_BREAK)
def circuit_breaker(spark, sf):
    at = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000.0
    rows = t.telemetry(spark, sf, dense=True).select(F.col("charger_id").alias("key"), F.col("arrival").alias("seq"), at.alias("at"), (F.col("type") == "error").alias("error"))
    return controls.circuit_breaker(rows, 0.1, 21600.0)


@query()
def calibrated_threshold(spark, sf):
    """Thresholds of three trackers for each charger, from as many calibration scores as it has, and the alarms that its p-values raise with them."""
    trackers = [thresholds.Tracker("power"), thresholds.Tracker("mixture", "shiryaev_roberts", "mixture", grid=(0.1, 0.4, 0.7, 1.0)), thresholds.Tracker("jumper", "restarted_martingale", "jumper", jump=0.05)]
    rows = t.telemetry(spark, sf, dense=True).select("charger_id", "arrival", "value")
    scores = rows.where("arrival % 5 = 0")
    sizes = cut(scores.where("charger_id is not null").groupBy(F.col("charger_id").alias("_charger")).agg(F.count("*").alias("calibration")))
    found = {n: thresholds.resolved(spark, trackers, calibration=n, horizon=50, paths=400, alpha=0.1, seed=7) for (n,) in sorted(sizes.select("calibration").distinct().collect())}
    held = lambda x: F.create_map(*[y for n, limits in found.items() for y in (F.lit(n).cast("long"), F.lit(limits[x.id]))])[F.col("calibration")]
    # one ensemble over all chargers: the number of its calibration scores is part of a charger's key
    tested = sequential.p_values(rows.where("arrival % 5 <> 0"), scores, ["charger_id"], "value").join(sizes, F.col("charger_id") == F.col("_charger"))
    keys, dealt = ["charger_id", "calibration"], cut(tested.select("charger_id", F.col("calibration").cast("long"), "arrival", "p_value"))
    fired = sequential.ensemble(dealt, keys, "arrival", "p_value", [replace(x, threshold=held(x)) for x in trackers])
    made = fired.groupBy(*keys).agg(F.count_if("alarm").alias("alarms"), F.max("tested_count").alias("tested"))
    known = F.create_map(*[y for x in trackers for y in (F.lit(x.id), held(x))])
    return made.select("charger_id", "calibration", "tested", "alarms", F.explode(known).alias("tracker_id", "threshold")).withColumn("calibration", F.col("calibration").cast("int"))


@query()
def synthetic_readings(spark, sf):
    return parse_for_detection(synthetic.batch(spark, 500, chargers=2, seed=3)).select("charger_id", "sensor", F.col("seq"))
