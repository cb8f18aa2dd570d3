"""Chains by pointer doubling over pieces against a walk, and the guards made of them against their steps on random streams."""

from __future__ import annotations

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import chains
from pulsegrid.streaming import alignment, controls


@pytest.fixture
def small_pieces(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(3))
def test_chains_are_walks(spark, small_pieces, seed):
    rng = np.random.default_rng(seed)
    links, heads, want = [], [], set()
    for key, n in ((None, 60), ("a", 400), ("b", 1), ("c", 90)):
        nodes = np.sort(rng.choice(5000, n, replace=False)).tolist()
        after = {x: (int(nodes[min(n - 1, k + 1 + int(rng.integers(3)))]) if k + 1 < n and rng.random() > 0.003 else None) for k, x in enumerate(nodes)}
        links += [(key, x, y) for x, y in after.items()]
        heads.append((key, nodes[0]))
        at = nodes[0]
        while at is not None:
            want.add((key, at))
            at = after[at]
    got = chains.chained(spark.createDataFrame(links, "k string, node long, after long").repartition(5), ["k"], spark.createDataFrame(heads, "k string, node long")).collect()
    assert len(got) == len(want) and {(r.k, r.node) for r in got} == want


def test_no_chain(spark):
    none = spark.createDataFrame([], "k string, node long, after long")
    assert chains.chained(none, ["k"], none.select("k", "node")).count() == 0


def test_following(spark):
    rows = [("k", n, p) for n, p in enumerate([1, 1, 2, 5, 5, 9])] + [("j", 0, 4)]
    frame = spark.createDataFrame(rows, "k string, n long, p long")
    for beyond in (True, False):
        got = {(r.k, r.node): r.after for r in chains.following(frame, ["k"], "n", F.col("p"), F.col("p") + 1, beyond=beyond).collect()}
        want = {(k, n): min((m for kk, m, q in rows if kk == k and (q > p + 1 if beyond else q >= p + 1)), default=None) for k, n, p in rows}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_breaker_is_its_step(spark, small_pieces, seed):
    """Long outages, several openings, a clock that runs back now and then, two keys."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0.0
    for n in range(900):
        at += float(rng.choice([-1.0, 0.5, 2.0, 40.0], p=[0.05, 0.6, 0.3, 0.05]))
        rows.append((str(rng.choice(["x", "x", "y"])), n, at, bool(rng.random() < 0.5)))
    frame = spark.createDataFrame(rows, "key string, seq long, at double, error boolean")
    for share, timeout in ((0.1, 60.0), (0.02, 7.5), (1.0, 5.0)):
        states, want = {}, {}
        for key, seq, when, error in rows:
            (made,) = controls.breaker_step(share, timeout, states.setdefault(key, controls.Breaker()), {"key": key, "seq": seq, "at": when, "error": error})
            want[seq] = (key, made["open"], made["errors"])
        got = {r.seq: (r.key, r.open, r.errors) for r in controls.circuit_breaker(frame, share, timeout).collect()}
        assert got == want and (share == 1.0 or any(o for _, o, _ in want.values()))


@pytest.mark.parametrize("seed", range(2))
def test_barrier_is_its_step(spark, small_pieces, seed):
    rng = np.random.default_rng(seed)
    required, rows, at = ("p", "q", "r"), [], 0.0
    for n in range(700):
        at += float(rng.choice([0.1, 0.5, 6.0], p=[0.6, 0.37, 0.03]))
        rows.append((str(rng.choice(["c1", "c1", "c2"])), str(rng.choice([*required, "z"])), None if rng.random() < 0.05 else float(n), at, None if rng.random() < 0.5 else at - 3.0, n))
    names = "charger_id sensor value received_at event_ts seq".split()
    frame = spark.createDataFrame(rows, "charger_id string, sensor string, value double, received_at double, event_ts double, seq long")
    step, states, want = partial(alignment.align_step, required, 4.0), {}, {}
    for row in rows:
        (made,) = step(states.setdefault(row[0], alignment.Barrier()), dict(zip(names, row, strict=True)))
        want[row[-1]] = made
    got = {r.seq: r.asDict() for r in alignment.align(frame, list(required), 4.0).collect()}
    assert got == want and sum(r["status"] == "aligned_emit" for r in want.values()) > 30
