"""Zones over many parts of a key, against one pass over its rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np

from pulsegrid.operators import scan, series


def test_zones_over_many_parts(spark, monkeypatch):
    """Parts of about 40 rows and batches of 15: zones that span parts and batches, equal times, a null key, rows without a time."""
    rng, base, rows, want = np.random.default_rng(2), datetime(2024, 1, 1), [], {}
    for key, n, most in (("long", 300, 8), ("many", 300, 40), ("one", 1, 1), (None, 30, 20)):
        at, zone = 0, 0
        for k in range(n):
            step = int(rng.integers(0, most))
            at += step
            if k == 0 or step > 10:
                zone += 1
            when = base + timedelta(seconds=at)
            rows.append((key, when))
            start, _, members = want.get((key, zone), (when, when, 0))
            want[key, zone] = (start, when, members + 1)
    rows += [("one", None), ("many", None)]
    dealt, ordered = [], scan.ordered
    monkeypatch.setattr(scan, "ordered", lambda *a: dealt.append(ordered(*a)) or dealt[-1])
    monkeypatch.setattr(series, "PART_ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "15")
    try:
        got = series.zones(spark.createDataFrame(rows, "k string, t timestamp_ntz"), ["k"], "t", 10.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {(r.k, r.zone): (r.zone_start, r.zone_end, r.members) for r in got} == want
    assert dealt[0].groupBy(scan.PART).count().count() >= 12
