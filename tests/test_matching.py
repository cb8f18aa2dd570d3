"""Evidence and readings meet on the millisecond that SQL's epoch_ms gives."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from pulsegrid.operators import matching


def test_evidence_meets_readings_on_the_nearest_millisecond(spark):
    base = datetime(2024, 1, 1)
    at = lambda us: base + timedelta(microseconds=us)
    rows = [("c", k, {"click": at(us)}) for k, us in enumerate((400, 600, 1400, 1500))]
    evidence = spark.createDataFrame(rows, "charger_id string, sequence_number long, input_timestamps map<string,timestamp_ntz>")
    telemetry = spark.createDataFrame([("c", "click", at(900))], "charger_id string, type string, timestamp timestamp_ntz")
    assert sorted(r.sequence_number for r in matching.evidence_points(evidence, telemetry).collect()) == [1, 2]


def test_nearest_millis_is_epoch_ms(spark):
    micros = [k * 500 + d for k in (-3, -2, -1, 0, 1, 2, 3, 3408134400000) for d in (-1, 0, 1)]
    want = duckdb.connect().execute("SELECT epoch_ms(make_timestamp(unnest(?::BIGINT[])))", [micros]).fetchall()
    got = spark.createDataFrame([(m,) for m in micros], "us long").coalesce(1).select(matching.nearest_millis(F.timestamp_micros("us")).alias("ms")).collect()
    assert [r.ms for r in got] == [w[0] for w in want]
