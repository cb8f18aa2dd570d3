"""The parallel scan: one key over many parts, folds against one pass over all rows, and the joins and moving statistics made of it against brute force."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import matching, moving, scan, sequential, series


@pytest.fixture
def many_parts(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    yield 9
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def folds():
    value = pa.array([1.0, None, 3.0])
    schema = pa.schema([("v", pa.float64())])
    assert value.type == schema.field("v").type
    return {
        "place": scan.Place(), "running": scan.Running("i", "sum"), "edges": scan.Edges("b"), "average": scan.MovingAverage("v", 7), "statistics": sequential.Statistics(), "mixture": sequential.Mixture("p", [0.2, 0.6, 1.0]),
        "jumper": sequential.Jumper("p", 0.05), "median": moving.Sliding("v", 5, "median", 0.5), "deviation": moving.Sliding("v", 6, "average_absolute_deviation", 0.5),
    }


@pytest.mark.parametrize("name", list(folds()))
def test_folds_are_associative(name):
    """A state after any cut into runs, each summarised or run through, is that after one pass."""
    rng, fold = np.random.default_rng(len(name)), folds()[name]
    n = 200
    v = rng.normal(size=n).round(1)
    columns = {
        "i": pa.array(rng.integers(-3, 4, n), mask=rng.random(n) < 0.1), "b": pa.array(rng.random(n) < 0.5, mask=rng.random(n) < 0.1), "v": pa.array(v, mask=rng.random(n) < 0.05), "p": pa.array(rng.random(n), mask=rng.random(n) < 0.05),
        "_log_e": pa.array(rng.normal(size=n), mask=rng.random(n) < 0.05),
    }
    part = lambda a, b: (np.arange(a + 1, b + 1), {c: columns[c].slice(a, b - a) for c in fold.inputs})
    whole, _ = fold.run(fold.fresh, *part(0, n))
    frame = lambda out: pd.DataFrame({k: (x if isinstance(x, pa.Array) else pa.array(x)).to_pandas() for k, x in enumerate(out)}).astype(float)
    for _ in range(5):
        cuts = [0, *sorted(set(rng.integers(1, n, 6).tolist())), n]
        state, made = fold.fresh, []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            made.append(frame(fold.run(state, *part(a, b))[0]))
            half, summary = (a + b) // 2, fold.neutral
            for i, j in ((a, half), (half, b)):
                if j > i:
                    summary = fold.summarise(summary, *part(i, j))
            state = fold.join(state, summary)
        assert np.allclose(pd.concat(made).to_numpy(), frame(whole).to_numpy(), equal_nan=True)


@pytest.mark.parametrize("keys", [["a"], ["a", None, "b", "c"], [str(k) for k in range(150)]])
def test_scan_over_parts(spark, many_parts, keys):
    rng = np.random.default_rng(7)
    rows = [(keys[int(rng.integers(len(keys)) ** 2 / len(keys))], int(k), float(rng.normal())) for k in rng.permutation(900)]
    frame = spark.createDataFrame(rows, "k string, at long, x double")
    parts = scan.ordered(frame, ["k"], ["at"])
    assert parts.select(scan.PART).distinct().count() == many_parts if len(keys) == 1 else True
    got = sequential.statistics(frame.withColumn("log_e", F.col("x")), ["k"], "at").toPandas()
    edges = series.alarm_edges(frame, ["k"], "at", F.col("x") > 0).toPandas()
    jumps = sequential.jumper(frame.withColumn("p", F.lit(1.0) / (1.0 + F.exp("x"))), ["k"], "at", "p", 0.1).toPandas()
    for key in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == key)
        mine = lambda f: f[f.k.isna() if key is None else f.k == key].sort_values("at")  # noqa: B023, E731
        assert mine(got).n.tolist() == list(range(1, len(own) + 1)) and np.allclose(mine(got).log_martingale, np.cumsum([x for _, x in own]))
        low = np.minimum.accumulate([0.0, *np.cumsum([x for _, x in own])])[:-1]
        assert np.allclose(mine(got).log_cusum, np.cumsum([x for _, x in own]) - low)
        up = np.array([x > 0 for _, x in own])
        fired = up & ~np.concatenate(([False], up[:-1]))
        assert mine(edges).alarm_count.tolist() == np.cumsum(fired).tolist() and mine(edges).fired.tolist() == fired.tolist()
        accounts, want = np.full(3, 1 / 3), []
        for _, x in own:
            accounts = (0.9 * accounts + 0.1 / 3 * accounts.sum()) * (1 + np.array([-1, 0, 1]) * (1 / (1 + np.exp(x)) - 0.5))
            want.append(np.log(accounts.sum()))
        assert np.allclose(mine(jumps).log_martingale, want)


def test_scan_of_nothing(spark):
    frame = spark.createDataFrame([], "k string, at long, p double")
    assert sequential.jumper(frame, ["k"], "at", "p").count() == 0 and sequential.mixture(frame, ["k"], "at", "p", [0.5]).count() == 0
    assert sequential.p_values(frame, frame, ["k"], "p").count() == 0


def test_ranks_with_ties_and_hot_key(spark, many_parts):
    rng = np.random.default_rng(9)
    scores = [("hot" if k % 10 else "cold", k, float(rng.integers(20))) for k in range(700)] + [("none", 700, 1.0)]
    frame = spark.createDataFrame(scores, "k string, at long, s double")
    got = sequential.p_values(frame.where("at % 3 > 0"), frame.where("at % 3 = 0 and k <> 'none'"), ["k"], "s").collect()
    cal = {key: np.array([s for k, at, s in scores if k == key and at % 3 == 0]) for key in ("hot", "cold", "none")}
    cal["none"] = np.zeros(0)
    assert len(got) == sum(at % 3 > 0 for _, at, _ in scores)
    assert all(r.p_value == ((cal[r.k] >= r.s).sum() + 1) / (len(cal[r.k]) + 1) for r in got)


@pytest.mark.parametrize("kind,q", [("median", 0.5), ("quantile", 0.9), ("interquartile_range", 0.5), ("average_absolute_deviation", 0.5)])
def test_sliding_windows(spark, many_parts, kind, q):
    rng = np.random.default_rng(5)
    values = [None if x < 0.02 else float("nan") if x < 0.03 else float(rng.choice([rng.normal() * 1e6, rng.integers(5)])) for x in rng.random(400)]
    got = moving.moving_scores(spark.createDataFrame([("k", n, x) for n, x in enumerate(values)], "k string, n long, x double"), ["k"], "n", "x", kind, 8, q).toPandas().sort_values("n").statistic
    for n, found in enumerate(got):
        window = values[max(0, n - 8) : n]
        if len(window) < 8 or None in window:
            assert pd.isna(found)
        elif kind == "average_absolute_deviation":
            assert np.isclose(found, np.abs(np.array(window) - np.mean(window)).mean(), equal_nan=True)
        else:
            ranked = np.sort(window)  # NaN last
            at = lambda p: ranked[int(np.floor(p * 7))] + (ranked[int(np.ceil(p * 7))] - ranked[int(np.floor(p * 7))]) * (p * 7 - np.floor(p * 7))  # noqa: B023, E731
            want = at(0.75) - at(0.25) if kind == "interquartile_range" else at(q)
            assert np.isclose(found, want, equal_nan=True)


@pytest.mark.parametrize("kind", moving.ORDER_STATISTICS)
def test_wide_windows_take_little_longer(kind):
    rng = np.random.default_rng(1)
    column = {"x": pa.array(rng.normal(size=30_000))}

    def seconds(size: int) -> float:
        fold, began = moving.Sliding("x", size, kind, 0.9), time.process_time()
        fold.run(fold.fresh, np.arange(30_000), column)
        return time.process_time() - began

    assert min(seconds(1000) for _ in range(3)) <= 2.5 * min(seconds(50) for _ in range(3))


def test_matches_against_all_pairs(spark, many_parts):
    """Many equal times, rows without a time or key, several keys: no pairs are made, but the results are those of all pairs."""
    rng = np.random.default_rng(3)
    base = datetime(2024, 1, 1)
    when = lambda: None if rng.random() < 0.03 else base + timedelta(seconds=float(rng.choice([100.0, 104.9, 110.0, rng.integers(0, 400) / 2])))
    key = lambda: rng.choice(["a", "a", "a", "b", "c"])
    left = [(str(key()), when(), k) for k in range(300)] + [(None, base, 300)]
    right = [(str(key()), when(), k, f"r{k}") for k in rng.permutation(200).tolist()] + [(None, base, 500, "x")]
    frames = spark.createDataFrame(left, "k string, t timestamp_ntz, id long"), spark.createDataFrame(right, "k string, u timestamp_ntz, pos int, name string")
    for seconds in (0.5, 5.0, 60.0):
        near, first = {}, {}
        for k, t, i in left:
            found = [(abs((t - u).total_seconds()), pos, name) for kk, u, pos, name in right if k is not None and kk == k and t is not None and u is not None and abs((t - u).total_seconds()) <= seconds]
            if found:
                near[i], first[i] = min(found)[2], min(f[1:] for f in found)[1]
        assert {r.id: r.name for r in matching.nearest(*frames, ["k"], "t", "u", "pos", seconds).collect()} == near
        assert {r.id: r.name for r in matching.first_match(*frames, ["k"], "t", "u", "pos", seconds).collect()} == first


def test_equal_times_make_no_pairs(spark):
    """Rows that leave the joins are as many as those that enter: 3000 points and 3000 marks at one time."""
    at = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz")
    points, marks = spark.range(3000).select(F.lit("k").alias("k"), at.alias("t"), "id"), spark.range(3000).select(F.lit("k").alias("k"), at.alias("u"), F.col("id").alias("pos"))
    began = time.time()
    for found in (matching.first_match(points, marks, ["k"], "t", "u", "pos"), matching.nearest(points, marks, ["k"], "t", "u", "pos")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert found.agg(F.count("*"), F.max("pos")).first()[:] == (3000, 0)
    assert time.time() - began < 60
