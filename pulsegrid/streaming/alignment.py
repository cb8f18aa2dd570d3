"""Barrier alignment: a vector leaves when every required sensor has a fresh reading that is newer than the last vector."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import chains, scan
from pulsegrid.shared import cut
from pulsegrid.streaming.ordered import fold_stream

#: sensor readings: charger_id, sensor, value, received_at (seconds), event_ts (seconds or null), seq
ALIGNED = "charger_id string, seq long, status string, blocking array<string>, features map<string,double>, input_timestamps map<string,double>, sample_timestamp double"


@dataclass
class Barrier:
    readings: dict = field(default_factory=dict)
    emitted: int = -1


def align_step(required: tuple[str, ...], max_age: float, state: Barrier, row: dict) -> list[dict]:
    """Blockers are looked for in this order: missing sensors, stale ones, ones not renewed since the last vector, ones without a number."""
    out = {"charger_id": row["charger_id"], "seq": row["seq"], "status": "direct_pass_through", "blocking": [], "features": None, "input_timestamps": None, "sample_timestamp": None}
    event = row["event_ts"] if row["event_ts"] is not None else row["received_at"]
    if len(required) < 2:
        if row["value"] is not None and (not required or row["sensor"] == required[0]):
            out |= {"features": {row["sensor"]: row["value"]}, "input_timestamps": {row["sensor"]: event}, "sample_timestamp": event}
        else:
            out["status"] = "ignored_sensor"
        return [out]
    if row["sensor"] not in required:
        return [out | {"status": "ignored_sensor"}]
    state.readings[row["sensor"]] = (row["value"], event, row["received_at"], row["seq"])
    held = state.readings
    missing = [s for s in required if s not in held]
    stale = [s for s in required if s in held and row["received_at"] - held[s][2] > max_age]
    waiting = [s for s in required if s in held and held[s][3] <= state.emitted]
    empty = [s for s in required if s in held and held[s][0] is None]
    for status, sensors in (("waiting_for_all", missing), ("stale_sensor_block", stale), ("waiting_for_barrier", waiting), ("waiting_for_all", empty)):
        if sensors:
            return [out | {"status": status, "blocking": sensors}]
    state.emitted = row["seq"]
    times = {s: held[s][1] for s in required}
    return [out | {"status": "aligned_emit", "features": {s: held[s][0] for s in required}, "input_timestamps": times, "sample_timestamp": max(times.values())}]


def _start(_: tuple) -> Barrier:
    return Barrier()


def _passed(rows: DataFrame, required: list[str]) -> DataFrame:
    """With fewer than two sensors each reading of a wanted one is a vector."""
    wanted = F.col("value").isNotNull() & (F.col("sensor") == required[0] if required else F.lit(True))
    event = F.coalesce("event_ts", "received_at")
    shown = lambda column: F.when(wanted, column)
    return rows.select(
        "charger_id", "seq", F.when(wanted, "direct_pass_through").otherwise("ignored_sensor").alias("status"), F.array().cast("array<string>").alias("blocking"),
        shown(F.create_map("sensor", "value")).alias("features"), shown(F.create_map("sensor", event)).alias("input_timestamps"), shown(event).alias("sample_timestamp"),
    )


def _emissions(rows: DataFrame) -> DataFrame:
    """(charger_id, seq) of the vectors, from rows that are ready (charger_id, seq, oldest): the first, and then always the first at which every sensor's reading is newer than the last vector.

    `oldest`, the place of the oldest of the sensors' last readings, never falls, so the next vector after one is a function of its place."""
    links = chains.following(rows, ["charger_id"], "seq", F.col("oldest"), F.col("seq"), beyond=True)
    heads = rows.groupBy("charger_id").agg(F.min("seq").alias("node"))
    return chains.chained(links, ["charger_id"], heads).select("charger_id", F.col("node").alias("seq"))


def align(readings: DataFrame, required: list[str], max_age: float = 30.0) -> DataFrame:
    """One row of ALIGNED for each reading, as `align_step` gives them in order of seq, which tells a charger's readings apart and isn't negative.

    A scan carries each sensor's last reading on; what is missing, stale or empty follows from it. Which rows become vectors is a chain through the rows that are ready, marked by pointer doubling, and a
    second scan tells each row the last vector before it. No charger's readings are one task's.
    """
    required, max_age = sorted(set(required)), max(0.1, max_age)
    rows = readings.select(F.col("charger_id").cast("string").alias("charger_id"), "sensor", F.col("value").cast("double").alias("value"), F.col("received_at").cast("double").alias("received_at"), F.col("event_ts").cast("double").alias("event_ts"), F.col("seq").cast("long").alias("seq"))
    if len(required) < 2:
        return _passed(rows, required)
    rows = rows.withColumn("_reading", F.struct("value", F.coalesce("event_ts", "received_at").alias("event"), "received_at", "seq"))
    rows = rows.withColumns({f"_is{k}": F.coalesce(F.col("sensor") == s, F.lit(False)) for k, s in enumerate(required)})
    parts = scan.ordered(rows, ["charger_id"], ["seq"])
    held = scan.scan(parts, ["charger_id"], scan.Together(*[scan.Carried(f"_is{k}", {"_reading": f"_held{k}"}, parts.schema) for k in range(len(required))])).drop(scan.PART)
    last = [F.col(f"_held{k}") for k in range(len(required))]
    named = lambda tests: F.array_compact(F.array(*[F.when(test, s) for s, test in zip(required, tests, strict=True)]))
    held = held.select(
        "charger_id", "seq", "sensor", *[f"_held{k}" for k in range(len(required))], F.col("sensor").isin(required).alias("_needed"), named([x.isNull() for x in last]).alias("_missing"),
        named([F.col("received_at") - x["received_at"] > max_age for x in last]).alias("_stale"), named([x.isNotNull() & x["value"].isNull() for x in last]).alias("_empty"), F.least(*[x["seq"] for x in last]).alias("oldest"),
    )
    held = cut(held)
    ready = held.where((F.size("_missing") == 0) & (F.size("_stale") == 0) & (F.size("_empty") == 0) & F.col("_needed"))
    found = _emissions(ready.select("charger_id", "seq", "oldest")).select(F.struct("charger_id", "seq").alias("_vector"))
    marked = held.join(found, F.struct("charger_id", "seq") == F.col("_vector"), "left").withColumn("_emitted", F.col("_vector").isNotNull()).drop("_vector")
    known = scan.scanned(marked, ["charger_id"], ["seq"], scan.Carried("_emitted", {"seq": "_last"}, marked.schema))
    waiting = named([x["seq"] <= F.col("_last") for x in last])
    rules = [("waiting_for_all", F.col("_missing")), ("stale_sensor_block", F.col("_stale")), ("waiting_for_barrier", waiting), ("waiting_for_all", F.col("_empty"))]
    status, blocking = F.when(~F.coalesce("_needed", F.lit(False)), "ignored_sensor").when(F.col("_emitted"), "aligned_emit"), F.when(F.col("_emitted") | ~F.coalesce("_needed", F.lit(False)), F.array().cast("array<string>"))
    for name, sensors in rules:
        status, blocking = status.when(F.size(sensors) > 0, name), blocking.when(F.size(sensors) > 0, sensors)
    shown = lambda column: F.when(F.col("_emitted"), column)
    of = lambda field: F.create_map(*[x for s, r in zip(required, last, strict=True) for x in (F.lit(s), r[field])])
    return known.select("charger_id", "seq", status.alias("status"), blocking.alias("blocking"), shown(of("value")).alias("features"), shown(of("event")).alias("input_timestamps"), shown(F.greatest(*[x["event"] for x in last])).alias("sample_timestamp"))


def align_stream(readings: DataFrame, required: list[str], max_age: float = 30.0, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """The same over a stream, a step a reading; a charger's state is dropped an hour after its last reading. Runs that take what there is and end need ttl_ms=None: a clock never ends them."""
    return fold_stream(readings.select("charger_id", "sensor", "value", "received_at", "event_ts", "seq"), ["charger_id"], ["seq"], _start, partial(align_step, tuple(sorted(set(required))), max(0.1, max_age)), ALIGNED, ttl_ms)
