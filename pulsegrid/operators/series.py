"""Series in time: zones, extents, ranges, phases, alarm edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from pulsegrid.operators import scan
from pulsegrid.operators.matching import micros
from pulsegrid.shared import cut


#: Rows of a part of zones: what a task sorts is bounded, however large the table is.
PART_ROWS = 1_000_000


def _closed(names: list[str], time: str):
    """A row for each run of equal names in a part of sorted rows, whether batches end in it or not; _edge marks the first and the last one, which other parts may continue."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # of the last run: its row before it is given away

        def given(rows: pa.Table, edges: list[bool]) -> list[pa.RecordBatch]:
            return rows.append_column("_edge", pa.array(edges)).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.array([0, *scan._changes(batch, names)])
            ends = np.append(starts[1:], batch.num_rows)
            own = pa.Table.from_batches([batch.select(names)]).take(pa.array(starts))
            for name, places in (("zone_start", starts), ("zone_end", ends - 1)):
                own = own.append_column(name, batch.column(time).take(pa.array(places)))
            own = own.append_column("members", pa.array(ends - starts))
            if held is not None:
                same = held.select(names).to_pylist() == own.select(names).slice(0, 1).to_pylist()
                if same:
                    more = held["members"][0].as_py() + own["members"][0].as_py()
                    one = own.slice(0, 1).set_column(len(names), "zone_start", held["zone_start"]).set_column(len(names) + 2, "members", pa.array([more]))
                    own = pa.concat_tables([one, own.slice(1)])
                else:
                    own = pa.concat_tables([held, own])
            held = own.slice(own.num_rows - 1)
            if own.num_rows > 1:
                yield from given(own.slice(0, own.num_rows - 1), [first, *[False] * (own.num_rows - 2)])
                first = False
        if held is not None:
            yield from given(held, [True])

    return run


def zones(rows: DataFrame, keys: list[str], time: str, gap_seconds: float = 300.0) -> DataFrame:
    """(keys, zone, zone_start, zone_end, members): runs of rows in which none is later than its predecessor by more than the gap. Rows without a time are left out.

    Zones are numbered by a scan over parts of at most so many rows, about, and closed where they end in a part; only the first and the last one of each part are grouped."""
    known = rows.where(F.col(time).isNotNull()).select(*keys, time)
    parts = max(known.sparkSession.sparkContext.defaultParallelism, -(-known.count() // PART_ROWS))
    numbered = scan.scan(scan.ordered(known.withColumn("_at", micros(F.col(time))), keys, ["_at"], parts), keys, scan.Zone("_at", int(gap_seconds * 1_000_000)))
    kind, names = known.schema[time].dataType, [*keys, "zone"]
    schema = StructType([*(known.schema[k] for k in keys), StructField("zone", LongType()), StructField("zone_start", kind), StructField("zone_end", kind), StructField("members", LongType()), StructField("_edge", BooleanType())])
    made = cut(numbered.select(*names, time).mapInArrow(_closed(names, time), schema))
    split = made.where("_edge").groupBy(*names).agg(F.min("zone_start").alias("zone_start"), F.max("zone_end").alias("zone_end"), F.sum("members").alias("members"))
    return made.where("not _edge").drop("_edge").unionByName(split)


def session_zones(stream: DataFrame, keys: list[str], time: str, gap: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """The same over a stream, as session windows; the end of a session lies a gap after its last row."""
    found = stream.withWatermark(time, watermark).groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("members"))
    return found.select(*keys, F.col("_w.start").alias("zone_start"), (F.col("_w.end") - F.expr(f"interval {gap}")).alias("zone_end"), "members")


def extent(*series: tuple[DataFrame, str]) -> DataFrame:
    """(low, high): the earliest and latest of all times of several series; each is reduced before they meet."""
    ends = None
    for rows, time in series:
        own = rows.agg(F.min(time).alias("low"), F.max(time).alias("high"))
        ends = own if ends is None else ends.unionByName(own)
    return ends.agg(F.min("low").alias("low"), F.max("high").alias("high"))


def last_hours(rows: DataFrame, keys: list[str], time: str, hours: int) -> DataFrame:
    """Rows of the last hours before each series' own latest time."""
    latest = rows.groupBy(*keys).agg(F.max(time).alias("_latest"))
    return rows.join(latest, keys).where(F.col(time) >= F.col("_latest") - F.expr(f"interval {int(hours)} hours")).drop("_latest")


def retained(rows: DataFrame, time: str, now: Column, days: int = 14) -> DataFrame:
    """Rows not older than 1 to 365 days."""
    if not 1 <= days <= 365:
        raise ValueError("retention is from 1 to 365 days")
    return rows.where(F.col(time) >= now - F.expr(f"interval {days} days"))


def within(time: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """Inclusive range, open at ends that are not given."""
    inside = F.lit(True) if start is None else time >= start
    return inside if end is None else inside & (time <= end)


def recent(rows: DataFrame, keys: list[str], time: str, now: Column, seconds: float = 60.0) -> DataFrame:
    """(keys, latest, age_seconds, is_recent)."""
    age = (micros(now) - micros(F.col("latest"))) / 1_000_000.0
    return rows.groupBy(*keys).agg(F.max(time).alias("latest")).withColumn("age_seconds", age).withColumn("is_recent", (F.col("age_seconds") >= 0) & (F.col("age_seconds") <= seconds))


def normalized(points: DataFrame, keys: list[str], time: str, value: str, position: str) -> DataFrame:
    """One finite point for each millisecond, the last given one: (keys, ms, value)."""
    ms = points.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))).withColumn("ms", F.unix_millis(F.col(time).cast("timestamp")))
    return ms.groupBy(*keys, "ms").agg(F.max_by(value, position).alias(value))


def phases(rows: DataFrame, keys: list[str], order: str, train: int, calibrate: int) -> DataFrame:
    """rows with `n` (from 1) and the phase of the sample counts: collecting, calibrating, operational."""
    marked = scan.scanned(rows, keys, [order], scan.Place())
    return marked.withColumn("phase", F.when(F.col("n") <= train, "collecting").when(F.col("n") <= train + calibrate, "calibrating").otherwise("operational"))


def alarm_edges(rows: DataFrame, keys: list[str], order: str, crossed: Column) -> DataFrame:
    """rows with crossed, fired (crossed now but not at the row before) and alarm_count (fired so far)."""
    return scan.scanned(rows.withColumn("crossed", crossed), keys, [order], scan.Edges())


def pending_points(telemetry: DataFrame, evidence: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Readings later than the latest evidence of their series."""
    latest = evidence.groupBy(*keys).agg(F.max("timestamp").alias("_latest"))
    return telemetry.join(latest, keys).where(F.col(time) > F.col("_latest")).drop("_latest")


def moving_average(rows: DataFrame, keys: list[str], order: str, value: str, size: int = 1000) -> DataFrame:
    """rows with the mean of the values of the last `size` rows, this one among them."""
    return scan.scanned(rows, keys, [order], scan.MovingAverage(value, size))


def quantile_higher(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys, threshold): the smallest value at or above rank q * (n - 1). By rank rather than by gathering a key's values: (value, copies) pairs are counted first."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    sums = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("_n").over(sums)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    wanted = F.ceil(F.lit(float(q)) * (F.col("_all") - 1)) + 1
    return ranked.where((F.col("_to") >= wanted) & (F.col("_to") - F.col("_n") < wanted)).select(*keys, F.col(value).alias("threshold"))
