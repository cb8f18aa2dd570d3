"""Arbitration by rounds against requests taken one after another."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.topics import overlap
from pulsegrid.operators import claims


def in_turn(rows):
    granted, out = [], {}
    for request, at, service, topics, settings in sorted(rows, key=lambda r: (r[1], r[0])):
        mark = (sorted(set(topics or [])), sorted((settings or {}).items()))
        way = next((g for g in granted if any(overlap(a, b) for a in topics or [] for b in g[1])), None)
        if way is None:
            granted.append((request, topics or [], service, mark))
            out[request] = ("create", request)
        else:
            out[request] = ("reuse" if way[3] == mark else "replace" if way[2] == service else "conflict", way[0])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rounds_are_turns(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda: f"device/evCharger/{rng.choice(['a', 'b', 'c', 'd', 'e', '+'], p=[0.3, 0.2, 0.2, 0.15, 0.13, 0.02])}/{rng.choice(['x', 'y', 'z', '#', '+', 'x/1'], p=[0.3, 0.2, 0.2, 0.05, 0.05, 0.2])}"
    rows = [(int(k), int(rng.integers(40)), f"s{rng.integers(4)}", [pick() for _ in range(rng.integers(0, 4))] if rng.random() > 0.03 else None, {"model": str(rng.integers(2)), "b": "1"} if rng.random() > 0.1 else None) for k in rng.permutation(120)]
    got = claims.arbitrate(spark.createDataFrame(rows, "request_id long, at long, service string, topics array<string>, settings map<string,string>")).collect()
    assert {r.request_id: (r.verdict, r.granted_id) for r in got} == in_turn(rows) and len(got) == len(rows)


def test_many_requests_for_one_filter(spark):
    rows = spark.range(3000).select(F.col("id").alias("request_id"), (F.lit(5000) - F.col("id")).alias("at"), F.lit("s").alias("service"), F.array(F.lit("device/evCharger/a/x")).alias("topics"), F.create_map(F.lit("m"), (F.col("id") % 2).cast("string")).alias("settings"))
    got = {r.verdict: r["count"] for r in claims.arbitrate(rows).groupBy("verdict").count().collect()}
    assert got == {"create": 1, "reuse": 1499, "replace": 1500} and claims.arbitrate(rows.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = spark.createDataFrame([(["b", "a", "a"], {"x": "1", "y": "2"}), (["a", "b"], {"y": "2", "x": "1"}), (["a", "b"], {"x": "1"})], "t array<string>, s map<string,string>")
    a, b, c = (r[0] for r in rows.select(claims.fingerprint(F.col("t"), F.col("s"))).collect())
    assert a == b != c
