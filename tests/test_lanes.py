"""Lanes as scans: each row as the step gives it, whatever the parts; one key is read by many tasks."""

from __future__ import annotations

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import scan
from pulsegrid.streaming import lanes, models

NAMES = [f.strip().split(" ")[0] for f in lanes.RESULT.split(",")]


@pytest.fixture
def many_parts(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows_of(broken: dict) -> list[tuple]:
    """Vectors of four keys; at some places another feature is missing."""
    rng, rows = np.random.default_rng(8), []
    for key, n in (("hot", 700), ("odd", 300), ("short", 30), ("one", 1)):
        for k in range(n):
            x = {"b": round(float(rng.normal()), 2) * (30 if k % 90 == 80 else 1), "a": float(k % 17)}
            if k % 50 == 7:
                x["a"] = None
            rows.append((key, k + 1, {"b": x["b"]} if k in broken.get(key, ()) else x))
    return rows


def stepped(rows, start, step) -> dict:
    states, out = {}, {}
    for key, seq, features in rows:
        state = states.setdefault(key, start())
        out[key, seq] = step(state, {"service_id": key, "seq": seq, "features": features})[0]
    return out


def same(frame, want) -> None:
    got = frame.collect()
    assert len(got) == len(want)
    for r in got:
        for name in NAMES:
            a, b = r[name], want[r.service_id, r.seq][name]
            assert a == b or (isinstance(b, float) and np.isclose(a, b, rtol=1e-9, atol=0)), (r, want[r.service_id, r.seq])


@pytest.mark.parametrize("broken", [{}, {"odd": (250,), "hot": (0,)}, {"short": (3, 9), "odd": (60,)}])
def test_half_space_lane_is_its_step(spark, many_parts, broken):
    rows, params = rows_of(broken), {"window_size": 40, "n_trees": 4, "height": 5}
    want = stepped(rows, lambda: lanes.Adaptive(models.online("half_space_trees", params)), partial(lanes.adaptive_step, "half_space_trees", 55, 30, 0.9))
    frame = spark.createDataFrame(rows, "service_id string, seq long, features map<string,double>")
    same(lanes.adaptive_lane(frame, "half_space_trees", 55, 30, 0.9, params), want)
    assert not broken or any(r["phase"] == "failed" for r in want.values())


@pytest.mark.parametrize("kind,broken", [("hbos", {}), ("hbos", {"odd": (0,), "hot": (5, 690)}), ("pca", {"short": (1,)}), ("no such model", {"hot": (3, 650)})])
def test_static_lane_is_its_step(spark, many_parts, kind, broken):
    rows = [(k, s, {n: 0.5 if x is None else x for n, x in f.items()}) for k, s, f in rows_of(broken)]
    want = stepped(rows, lanes.Static, partial(lanes.static_step, kind, 60, 25, 0.5, 1.1, 0))
    frame = spark.createDataFrame(rows, "service_id string, seq long, features map<string,double>")
    same(lanes.static_lane(frame, kind, 60, 25, 0.5, 1.1), want)
    assert {r["phase"] for r in want.values()} >= ({"failed"} if kind == "no such model" else {"ready"})


@pytest.mark.parametrize("lane", ["static", "adaptive"])
def test_one_key_is_read_by_many_tasks(spark, many_parts, monkeypatch, lane):
    dealt, ordered = [], scan.ordered
    monkeypatch.setattr(scan, "ordered", lambda *a: dealt.append(ordered(*a)) or dealt[-1])
    frame = spark.range(1000).select(F.lit("s").alias("service_id"), F.col("id").alias("seq"), F.create_map(F.lit("x"), (F.col("id") * 37 % 101).cast("double")).alias("features"))
    made = lanes.static_lane(frame, "hbos", 60, 25) if lane == "static" else lanes.adaptive_lane(frame, "half_space_trees", 60, 25, params={"window_size": 50})
    assert made.count() == 1000 and dealt[0].groupBy(scan.PART).count().count() >= 5
