"""Automatic thresholds against step-by-step recursions of every bet and statistic, their order, budget and speed, and trackers of all bets on a stream."""

from __future__ import annotations

import itertools
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import sequential
from pulsegrid.operators import thresholds as th

GRID = (0.1, 0.5, 0.9)
KINDS = [th.Tracker(f"{bet}-{statistic}", statistic, bet, 0.4, GRID, 0.1) for bet, statistic in itertools.product(th.BETS, th.STATISTICS)]


def steps(p: list[float], tracker: th.Tracker) -> list[float]:
    """The statistic after each step, one after another."""
    capitals, accounts, out = np.zeros(len(GRID)), np.full(3, 1 / 3), []
    logs, cusum, sr, weighed, s = 0.0, -np.inf, -np.inf, -np.inf, 0.0
    for n, x in enumerate(p, 1):
        if tracker.bet == "power":
            log_e = np.log(tracker.epsilon) + (tracker.epsilon - 1) * np.log(x)
        elif tracker.bet == "mixture":
            capitals = capitals + np.log(GRID) + (np.array(GRID) - 1) * np.log(x)
            now = np.log(np.exp(capitals).mean())
            log_e, logs = now - logs, now
        else:
            accounts = (0.9 * accounts + 0.1 / 3 * accounts.sum()) * (1 + np.array([-1, 0, 1]) * (x - 0.5))
            log_e, accounts = np.log(accounts.sum()), accounts / accounts.sum()
        weighed = np.logaddexp(weighed, -s - np.log(n * (n + 1)))
        s, cusum, sr = s + log_e, log_e + max(cusum, 0.0), log_e + np.logaddexp(0.0, sr)
        out.append({"martingale": s, "cusum": cusum, "shiryaev_roberts": sr, "restarted_martingale": np.logaddexp(s + weighed, -np.log(n + 1))}[tracker.statistic])
    return out


@pytest.mark.parametrize("tracker", KINDS, ids=lambda t: t.id)
def test_paths_are_the_recursion(tracker):
    for paths, horizon in ((5, 40), (1, 300)):
        p = th.null_p_values(np.arange(paths), 30, horizon, 3)
        assert np.allclose(th.highest(th.growth(p, tracker), tracker.statistic), [max(steps(row, tracker)) for row in p.tolist()], atol=1e-9)


def test_thresholds_are_the_order_statistic(spark):
    paths, alpha = 300, 0.3
    found = th.resolved(spark, [*KINDS, th.Tracker("own", threshold=9.0)], calibration=20, horizon=25, paths=paths, alpha=alpha, seed=5)
    assert found.pop("own") == 9.0
    p, place = th.null_p_values(np.arange(paths), 20, 25, 5), int(np.ceil((paths + 1) * (1 - alpha / len(KINDS)))) - 1
    for tracker in KINDS:
        maxima = np.sort(th.highest(th.growth(p, tracker), tracker.statistic))
        assert found[tracker.id] == np.nextafter(np.exp(maxima[place]), np.inf)
        assert (np.exp(maxima) >= found[tracker.id]).mean() <= alpha / len(KINDS)


def test_order_and_errors(spark):
    make = lambda alpha, **kinds: th.resolved(spark, [th.Tracker("t", "cusum")], **({"calibration": 50, "horizon": 30, "paths": 300, "seed": 5} | kinds), alpha=alpha)["t"]
    assert make(0.2) == make(0.2) <= make(0.1) <= make(0.02)
    with pytest.raises(ValueError, match="budget"):
        make(0.1, horizon=10**6, paths=100)
    with pytest.raises(ValueError, match="too few"):
        make(0.001)
    with pytest.raises(ValueError, match="calibration"):
        make(0.1, calibration=0)


def test_selection_of_negative_and_equal_values(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.normal(size=200), [0.0, -1e-300, 1e300] * 20))
    rows = spark.createDataFrame([(g, int(c)) for g in (0, 1) for c in th._codes(values * (1 - 2 * g))], "tracker int, code long")
    for place in (0, 17, 130, 259):
        assert [th._decoded(c) for c in th.selected(rows, 2, place)] == [np.sort(values)[place], np.sort(-values)[place]]


@pytest.mark.parametrize("horizon", [500, 250_000])
def test_a_full_budget_takes_seconds(horizon):
    """25 million steps of all three bets on one core, extrapolated from a tenth."""
    began, paths = time.process_time(), 2_500_000 // horizon
    for k in range(0, paths, 256):
        p = th.null_p_values(np.arange(k, min(paths, k + 256)), 200, horizon, 1)
        for bet in th.BETS:
            th.highest(th.growth(p, th.Tracker(bet, "shiryaev_roberts", bet, 0.4, GRID)), "shiryaev_roberts")
    assert time.process_time() - began < 12


def test_trackers_of_all_bets_on_a_stream(spark):
    rng = np.random.default_rng(4)
    rows = [(key, n, float(x)) for key in "ab" for n, x in enumerate(rng.uniform(0.0, 1.0, 150) ** (1 if key == "a" else 3))]
    frame = spark.createDataFrame(rows, "k string, n_ long, p double")
    trackers = [replace(t, threshold=1.5) for t in KINDS]
    got = {(r.k, r.n_): r for r in sequential.ensemble(frame, ["k"], "n_", "p", trackers).collect()}
    for key in "ab":
        p = [x for k, _, x in rows if k == key]
        crossed = np.array([[x >= np.log(1.5) for x in steps(p, t)] for t in trackers])
        fired = crossed & ~np.concatenate((np.zeros((len(trackers), 1), bool), crossed[:, :-1]), axis=1)
        for n in range(150):
            assert got[key, n].alarm == fired[:, n].any() and got[key, n].alarm_count == fired[:, : n + 1].sum() and got[key, n].tested_count == n + 1


def test_thresholds_by_key_are_those_of_an_ensemble_for_each(spark):
    """One ensemble over keys with thresholds of their own, as columns of the keys, is the ensembles of the keys one after another."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(c, n, float(p)) for c in "ab" for n, p in enumerate(rng.random(120) ** 1.5 + 1e-9)], "c string, n long, p double")
    limits = {"a": {"power": 3.0, "mix": 2.0, "jump": 1.1}, "b": {"power": 6.0, "mix": 1.5, "jump": 1.4}}
    tracker = lambda limit: [th.Tracker("power", threshold=limit("power")), th.Tracker("mix", "shiryaev_roberts", "mixture", grid=(0.2, 0.8), threshold=limit("mix")), th.Tracker("jump", "martingale", "jumper", jump=0.05, threshold=limit("jump"))]
    column = lambda x: F.when(F.col("c") == "a", limits["a"][x]).otherwise(limits["b"][x])
    got = sequential.ensemble(rows, ["c"], "n", "p", tracker(column)).orderBy("c", "n").collect()
    want = [r for c in "ab" for r in sequential.ensemble(rows.where(F.col("c") == c), ["c"], "n", "p", tracker(limits[c].get)).orderBy("n").collect()]
    assert got == want and sum(r.alarm for r in got) > 2
