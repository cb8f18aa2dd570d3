"""Alignment, lanes, guards, sequential statistics and sinks on scripted cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import relational, sequential, series
from pulsegrid.plans import analytics, registry  # noqa: F401
from pulsegrid.plans import tables as t
from pulsegrid.streaming import alignment, controls, lanes, models

READINGS = "charger_id string, sensor string, value double, received_at double, event_ts double, seq long"


def align(spark, rows, required, age=5.0):
    made = [("c", sensor, value, float(at), event, k) for k, (at, sensor, value, event) in enumerate(rows)]
    return alignment.align(spark.createDataFrame(made, READINGS), required, age).orderBy("seq").collect()


def simulated(rows, required, age):
    """(status, blocking, features, sample time) of each reading, by looking back over all earlier ones."""
    out, last = [], -1
    for k, (at, sensor, *_) in enumerate(rows):
        if sensor not in required:
            out.append(("ignored_sensor", [], None, None))
            continue
        newest = {s: max((i for i in range(k + 1) if rows[i][1] == s), default=None) for s in sorted(required)}
        rules = {
            "missing": [s for s, i in newest.items() if i is None], "stale": [s for s, i in newest.items() if i is not None and at - rows[i][0] > age],
            "waiting": [s for s, i in newest.items() if i is not None and i <= last], "empty": [s for s, i in newest.items() if i is not None and rows[i][2] is None],
        }
        named = {"missing": "waiting_for_all", "stale": "stale_sensor_block", "waiting": "waiting_for_barrier", "empty": "waiting_for_all"}
        held = next((rule for rule, sensors in rules.items() if sensors), None)
        if held:
            out.append((named[held], rules[held], None, None))
        else:
            last = k
            times = [rows[i][0] if rows[i][3] is None else rows[i][3] for i in newest.values()]
            out.append(("aligned_emit", [], {s: rows[i][2] for s, i in newest.items()}, float(max(times))))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_alignment_of_generated_readings(spark, seed):
    """Two to four sensors with gaps, missing numbers, event times of their own and a sensor that isn't asked for."""
    rng = np.random.default_rng(seed)
    required = [f"q{k}" for k in range(2 + seed % 3)]
    at, rows = 50.0, []
    for _ in range(120):
        at += float(rng.choice([0.25, 0.5, 1.5, 7.0], p=[0.4, 0.3, 0.25, 0.05]))
        rows.append((at, str(rng.choice([*required, "other"])), None if rng.random() < 0.1 else float(rng.integers(100)), at - float(rng.integers(9)) if rng.random() < 0.3 else None))
    got = align(spark, rows, required, 4.0)
    want = simulated(rows, required, 4.0)
    assert [(r.status, r.blocking, r.features, r.sample_timestamp) for r in got] == want
    assert {w[0] for w in want} >= {"aligned_emit", "waiting_for_barrier", "waiting_for_all", "ignored_sensor"}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, s, float(k), float(k), None, k * 4 + n) for k in range(30) for n, (c, s) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")])]
    readings = spark.createDataFrame(rows, READINGS)
    for k in range(3):
        readings.where(F.col("seq") % 120 >= 40 * k).where(F.col("seq") % 120 < 40 * (k + 1)).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    query = alignment.align_stream(stream, ["x", "y"], 5.0, ttl_ms=None).writeStream.format("memory").queryName("aligned").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.charger_id, r.seq)
    assert sorted(spark.table("aligned").collect(), key=key) == sorted(alignment.align(readings, ["x", "y"], 5.0).collect(), key=key)


def vectors(spark, values):
    return spark.createDataFrame([("s", k, v) for k, v in enumerate(values, 1)], "service_id string, seq long, features map<string,double>")


def test_static_phases(spark):
    rows = [{"L1": float(i), "L2": float(i % 4)} for i in range(25)] + [{"L1": 1.0}, {"L1": 1000.0, "L2": 9.0}]
    got = lanes.static_lane(vectors(spark, rows), "hbos", train=20, calibrate=5, threshold=1.2).orderBy("seq").collect()
    assert [r.phase for r in got] == ["collecting"] * 19 + ["calibrating"] * 5 + ["training_started", "schema_mismatch", "ready"]
    assert got[-1].p_value == 1 / 6 and got[-1].tested_count == 1


@pytest.mark.parametrize("kind", ["hbos", "knn", "lof", "pca", "iforest", "ocsvm"])
def test_static_models_rank_outliers(kind):
    rng = np.random.default_rng(0)
    model = models.fitted(f"pyod_{kind}", rng.normal(size=(300, 3)), seed=1)
    assert model.score(np.full((1, 3), 8.0))[0] > np.quantile(model.score(rng.normal(size=(200, 3))), 0.95)


@pytest.mark.parametrize("kind", [k for k in models.catalogue() if not k.startswith("moving_") or k == "moving_mahalanobis_distance"])
def test_online_models_learn_and_score(kind):
    rng = np.random.default_rng(1)
    params = {"half_space_trees": {"window_size": 60}, "x_stream": {"window_size": 60}, "asd_isolation_forest": {"max_samples": 60, "n_estimators": 20}, "random_cut_forest": {"sample_size": 60, "n_trees": 20}, "mondrian_forest": {"subspace_size": 60, "n_estimators": 20}}.get(kind, {})
    model = models.online(kind, params)
    for x in rng.normal(size=(200, 3)):
        model.learn_one(x)
    usual = [model.score_one(x) for x in rng.normal(size=(40, 3))]
    assert np.isfinite(usual).all() and np.isfinite(model.score_one(np.full(3, 9.0)))
    if kind not in ("gadget_svm",):
        assert model.score_one(np.full(3, 9.0)) >= np.median(usual)


def test_pipeline_order_and_warm_up(spark):
    model = models.online("knn", {"steps": [("standard_scaler", {}), ("random_projection", {"n_components": 2})]})
    for x in np.random.default_rng(2).normal(size=(30, 4)):
        assert np.isfinite(model.score_one(x))
        model.learn_one(x)
    with pytest.raises(ValueError, match="scaler"):
        models.online("knn", {"steps": [("random_projection", {"n_components": 2}), ("standard_scaler", {})]})
    with pytest.raises(ValueError, match="neighbours"):
        models.online("knn", {"k": 30, "warm_up": 20})
    with pytest.raises(ValueError, match="warm-up"):
        lanes.adaptive_lane(vectors(spark, []), "half_space_trees", warm_up=10)


def test_adaptive_phases(spark):
    rows = [{f"x{j}": i + j / 10 for j in range(2)} for i in range(12)] + [{"x0": 1.0}, {"x0": 1.0, "x1": 1.0}]
    got = lanes.adaptive_lane(vectors(spark, rows), "knn", warm_up=6, calibrate=3, q=1.0, params={"warm_up": 6}).orderBy("seq").collect()
    assert [r.phase for r in got] == ["warmup"] * 6 + ["calibrating"] * 3 + ["operational"] * 3 + ["failed"] * 2
    assert not any(r.is_anomaly for r in got)  # equal scores are not above the threshold


def p_stream(spark, values):
    return spark.createDataFrame([("s", k, p) for k, p in enumerate(values, 1)], "k string, n long, p double")


def test_power_statistics(spark):
    got = sequential.power(p_stream(spark, [0.8, 0.2, 0.01, 0.6]), ["k"], "n", "p", 0.5).orderBy("n").collect()
    for name, want in {"martingale": (0.5590, 0.6250, 3.1250, 2.0172), "cusum": (0.5590, 1.1180, 5.5902, 3.6084), "shiryaev_roberts": (0.5590, 1.7430, 13.7152, 9.4986), "restarted_martingale": (0.7795, 0.8322, 3.1609, 2.1112)}.items():
        assert np.allclose([r[name] for r in got], want, atol=1e-4)
    first = sequential.power(p_stream(spark, [(0.5 / 150) ** 2]), ["k"], "n", "p", 0.5).first()
    assert np.isclose(first.martingale, 150) and np.isclose(first.restarted_martingale, 75.5)


def test_long_null_streams_stay_numbers(spark):
    """Under null p-values exp(-S) leaves the doubles after some thousand rows; keys are also told apart within and across batches."""
    streams = {k: np.random.default_rng(seed).uniform(1e-4, 1, n) for k, seed, n in (("a", 6, 7000), ("b", 7, 12000), ("c", 8, 3))}
    rows = spark.createDataFrame([(k, n, float(p)) for k, ps in streams.items() for n, p in enumerate(ps, 1)], "k string, n_ long, p double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        found = sequential.power(rows, ["k"], "n_", "p", 0.5).toPandas().sort_values(["k", "n_"])
        alarms = sequential.ensemble(rows, ["k"], "n_", "p", [("s", 0.5, "shiryaev_roberts", 1e6), ("r", 0.5, "restarted_martingale", 1e6)]).where("alarm").count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, ps in streams.items():
        s, low, sr, weights, want = 0.0, 0.0, -np.inf, -np.inf, []
        for n, x in enumerate(np.log(0.5) - 0.5 * np.log(ps), 1):
            weights = np.logaddexp(weights, -s - np.log(n * (n + 1.0)))
            s, sr = s + x, x + np.logaddexp(0.0, sr)
            want.append((s, s - low, sr, np.logaddexp(s + weights, -np.log(n + 1.0))))
            low = min(low, s)
        own = found[found.k == k]
        assert own.n.tolist() == list(range(1, len(ps) + 1))
        assert np.isfinite(own[["cusum", "shiryaev_roberts", "restarted_martingale"]]).all(axis=None)
        assert np.allclose(own[["log_martingale", "log_cusum", "log_shiryaev_roberts", "log_restarted_martingale"]], want, atol=1e-7)
    assert alarms == 0


def test_statistics_beyond_a_zero_p(spark):
    got = sequential.power(p_stream(spark, [0.5, 0.0, 0.5]).withColumnRenamed("n", "at"), ["k"], "at", "p", 0.5)
    assert all(r[s] == float("inf") for r in got.where("at > 1").collect() for s in sequential.STATISTICS)


@pytest.mark.parametrize("name", ["power_martingale", "cusum", "shiryaev_roberts", "restarted_martingale", "mixture_martingale", "jumper_martingale", "ensemble_alarm"])
def test_sequential_queries_take_every_row(spark, name):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES[name](spark, sf)
    assert got.count() == t.telemetry(spark, sf, dense=True).where("arrival % 5 <> 0").count()
    assert got.where(" or ".join(f"isnan({c}) or {c} is null" for c, kind in got.dtypes if kind == "double") or "false").count() == 0


def test_zero_p_and_payload(spark):
    row = sequential.power(p_stream(spark, [0.0]), ["k"], "n", "p", 0.5).select(sequential.payload(F.col("log_martingale")).alias("x")).first().x
    assert row.value is None and row.is_infinite and row.log_value is None
    row = spark.range(1).select(sequential.payload(F.lit(float("nan"))).alias("x")).first().x
    assert row.value is None and not row.is_infinite


def test_jumper_is_the_recursion(spark):
    values = np.random.default_rng(3).random(20)
    accounts, want = np.full(3, 1 / 3), []
    for p in values:
        accounts = 0.9 * accounts + 0.1 / 3 * accounts.sum()
        accounts = accounts * (1 + np.array([-1, 0, 1]) * (p - 0.5))
        want.append(np.log(accounts.sum()))
    got = sequential.jumper(p_stream(spark, values.tolist()), ["k"], "n", "p", 0.1).orderBy("n").collect()
    assert np.allclose([r.log_martingale for r in got], want)


def test_fallback_is_the_recursion(spark):
    values = np.random.default_rng(4).random(5200)
    mean, want = values[0], [0.0]
    for n, x in enumerate(values[1:], 2):
        mean += (x - mean) / min(n, 100)
        want.append(min(abs(x - mean) / (1 + 1e-8), 1))
    got = sequential.fallback_scores(p_stream(spark, values.tolist()), ["k"], "n", "p").orderBy("n").collect()
    assert np.allclose([r.score for r in got], want, atol=1e-9)


def test_fallback_query_takes_every_row(spark):
    sf = "/root/testdata/sf0.001"
    rows = t.telemetry(spark, sf, dense=True).orderBy("arrival").select("charger_id", "arrival", "value").collect()
    state, want = {}, {}
    for r in rows:
        n, mean = state.get(r.charger_id, (0, 0.0))
        x, n = r.value / 100.0, n + 1
        mean += (x - mean) / min(n, 100)
        state[r.charger_id], want[r.arrival] = (n, mean), min(abs(x - mean) / (1 + 1e-8), 1)
    got = {r.arrival: r.score for r in registry.QUERIES["fallback_score"](spark, sf).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), atol=2e-9)


def test_guards(spark):
    rows = spark.createDataFrame([("k", n, float(n), True) for n in range(20)] + [("k", 20, 400.0, False)], "key string, seq long, at double, error boolean")
    got = controls.circuit_breaker(rows).orderBy("seq").collect()
    assert [r.seq for r in got if r.open] == list(range(11, 20)) and got[10].errors == 11
    got = controls.rate_limit(rows, limit=3, window=5.0).orderBy("seq").collect()
    assert [r.accepted for r in got[:9]] == [True, True, True, False, False, True, True, True, False]


def test_equal_rows_are_matched_each(spark):
    """Joins and mixtures answer for each row, also for rows that are equal."""
    from pulsegrid.operators import matching

    points = spark.createDataFrame([("c", "2024-01-01 08:00:00", 1.0)] * 3, "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    marks = spark.createDataFrame([("c", "2024-01-01 08:00:03", 7)], "k string, at string, pos int").withColumn("at", F.to_timestamp("at"))
    assert matching.first_match(points, marks, ["k"], "ts", "at", "pos").count() == 3
    assert matching.nearest(points, marks, ["k"], "ts", "at", "pos").count() == 3
    rows = spark.createDataFrame([("s", 1, 0.5), ("s", 1, 0.5), ("s", 2, 0.1)], "k string, n long, p double")
    assert sequential.mixture(rows, ["k"], "n", "p", [0.2, 0.8]).count() == 3


def test_session_zones_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("c", m) for m in ("08:00", "08:04", "09:00", "08:09")], "charger_id string, m string").select("charger_id", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "m")).alias("timestamp"))
    batch = series.zones(rows, ["charger_id"], "timestamp").orderBy("zone_start").collect()
    assert [(str(z.zone_start)[11:16], str(z.zone_end)[11:16], z.members) for z in batch] == [("08:00", "08:09", 3), ("09:00", "09:00", 1)]
    rows.write.json(str(tmp_path / "z"))
    stream = spark.readStream.schema("charger_id string, timestamp timestamp").json(str(tmp_path / "z"))
    query = series.session_zones(stream, ["charger_id"], "timestamp").writeStream.format("memory").queryName("zones").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.table("zones").orderBy("zone_start").collect()
    assert [(z.zone_start, z.zone_end, z.members) for z in found] == [(z.zone_start, z.zone_end, z.members) for z in batch]


def test_pages_and_limits(spark):
    rows = t.telemetry(spark, "/root/testdata/sf0.001").orderBy("created", "timestamp", "arrival")
    page = relational.page(rows, ["created", "timestamp"], 2)
    assert page["has_more"] and page["next_cursor"]["timestamp"] == page["items"][-1]["timestamp"]
    assert relational.page(rows.limit(0), ["created"], 2) == {"items": [], "has_more": False, "next_cursor": None}
    for kind, n in (("telemetry", 0), ("telemetry", 10001), ("anomalies", 1001)):
        with pytest.raises(ValueError, match="limit"):
            relational.checked_limit(kind, n)

