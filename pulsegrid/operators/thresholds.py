"""Automatic alarm thresholds: what the statistics of null p-values reach within a horizon, by simulation.

Paths are dealt out by their numbers, and each has a generator of its own, so a threshold depends on neither tasks nor blocks. A block of paths is a matrix of p-values that all trackers share; bets and
statistics are accumulated along it. The order statistic that becomes the threshold is selected in rounds of counts, by leading bits, so the maxima aren't sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.shared import cut

BUDGET = 25_000_000
BETS = ("power", "mixture", "jumper")
STATISTICS = ("martingale", "restarted_martingale", "cusum", "shiryaev_roberts")
LOG_MAX = float(np.log(np.finfo(np.float64).max))
#: Cells of a block's matrices, and paths of a block at most.
CELLS, PATHS = 1 << 20, 256
#: Rounds of the selection look at one more group of bits each.
_SHIFTS = (53, 42, 31, 20, 9, 0)


@dataclass(frozen=True)
class Tracker:
    """A bet, the statistic of its growth, and the threshold that raises its alarm; a threshold of None is taken from simulated paths."""

    id: str
    statistic: str = "cusum"
    bet: str = "power"
    epsilon: float = 0.5
    grid: tuple[float, ...] = ()
    jump: float = 0.01
    threshold: float | None = None

    def __post_init__(self) -> None:
        if self.bet not in BETS or self.statistic not in STATISTICS:
            raise ValueError(f"no tracker of {self.bet} bets and {self.statistic}")
        if self.bet == "mixture" and not self.grid:
            raise ValueError("a mixture has a grid of epsilons")


def null_p_values(paths: np.ndarray, calibration: int, horizon: int, seed: int) -> np.ndarray:
    """(paths, horizon): ranks of uniform scores among a path's own calibration scores."""
    out = np.empty((len(paths), horizon))
    for row, path in enumerate(paths.tolist()):
        rng = np.random.default_rng([seed, path])
        ranks = np.sort(rng.random(calibration))
        out[row] = (calibration - np.searchsorted(ranks, rng.random(horizon), "left") + 1.0) / (calibration + 1.0)
    return out


def growth(p: np.ndarray, tracker: Tracker) -> np.ndarray:
    """The logarithm of what each bet multiplies the capital by, along each row."""
    if tracker.bet == "power":
        return np.log(tracker.epsilon) + (tracker.epsilon - 1.0) * np.log(p)
    if tracker.bet == "mixture":
        total, log_p = np.full_like(p, -np.inf), np.log(p)
        for e in tracker.grid:
            np.logaddexp(total, np.cumsum(np.log(e) + (e - 1.0) * log_p, axis=1), out=total)
        return np.diff(total - np.log(len(tracker.grid)), axis=1, prepend=0.0)
    from pulsegrid.operators.sequential import Jumper

    rows, steps = p.shape
    if steps > 3 * rows * steps**0.5:  # few long paths: each in blocks
        fold, n = Jumper("p", tracker.jump), np.arange(1, steps + 1)
        return np.stack([fold.run(fold.fresh, n, {"p": pa.array(row)})[0][1] for row in p])
    accounts, out = np.full((rows, 3), 1.0 / 3.0), np.empty_like(p)
    bets = 1.0 + np.array([-1.0, 0.0, 1.0]) * (p.T[:, :, None] - 0.5)
    for t in range(steps):
        accounts = ((1.0 - tracker.jump) * accounts + tracker.jump / 3.0) * bets[t]
        total = accounts.sum(axis=1, keepdims=True)
        accounts /= total
        out[:, t] = total[:, 0]
    return np.log(out)


def highest(log_e: np.ndarray, statistic: str) -> np.ndarray:
    """The largest logarithm that the statistic of each row's growth reaches."""
    capital = np.cumsum(log_e, axis=1)
    if statistic == "martingale":
        return capital.max(axis=1)
    before = np.concatenate((np.zeros((len(capital), 1)), capital[:, :-1]), axis=1)
    if statistic == "cusum":
        return (capital - np.minimum.accumulate(before, axis=1)).max(axis=1)
    if statistic == "shiryaev_roberts":
        return (capital + np.logaddexp.accumulate(-before, axis=1)).max(axis=1)
    n = np.arange(1.0, capital.shape[1] + 1)
    return np.logaddexp(capital + np.logaddexp.accumulate(-before - np.log(n * (n + 1.0)), axis=1), -np.log(n + 1.0)).max(axis=1)


def _codes(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = values.view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(2**63 - 1))


def _decoded(code: int) -> float:
    return float(np.array([code if code >= 0 else code ^ (2**63 - 1)], np.int64).view(np.float64)[0])


def _maxima(trackers: list[Tracker], calibration: int, horizon: int, seed: int):
    size = max(1, min(PATHS, CELLS // max(1, horizon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_numpy()
            for k in range(0, len(paths), size):
                p = null_p_values(paths[k : k + size], calibration, horizon, seed)
                found = [highest(growth(p, t), t.statistic) for t in trackers]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(trackers)), len(p)).astype(np.int32)), pa.array(_codes(np.concatenate(found)))], names=["tracker", "code"])

    return run


def selected(rows: DataFrame, groups: int, place: int) -> list[int]:
    """Of each group of rows (tracker from 0 on, code) the code at a place, from 0, in order: rounds of counts by leading bits."""
    found, rest = [0] * groups, [place] * groups
    for k, shift in enumerate(_SHIFTS):
        own = rows
        if k:
            wanted = F.create_map(*[F.lit(x).cast(t) for g in range(groups) for x, t in ((g, "int"), (found[g], "long"))])
            own = rows.where(F.shiftright("code", _SHIFTS[k - 1]) == wanted[F.col("tracker")])
        counts: dict[int, list] = {g: [] for g in range(groups)}
        for row in own.groupBy("tracker", F.shiftright("code", shift).alias("lead")).agg(F.count("*").alias("n")).collect():
            counts[row.tracker].append((row.lead, row.n))
        for g, leads in counts.items():
            for lead, n in sorted(leads):
                if rest[g] < n:
                    found[g] = lead
                    break
                rest[g] -= n
    return found


def resolved(spark: SparkSession, trackers: list[Tracker], *, calibration: int, horizon: int, paths: int, alpha: float, seed: int = 0) -> dict[str, float]:
    """The threshold of each tracker: its own, or one that null p-values reach within the horizon with a chance of at most alpha divided by the number of trackers without one.

    The same paths serve all trackers. horizon times paths is at most BUDGET; the place of the order statistic has to lie within the paths.
    """
    open_ones = [t for t in trackers if t.threshold is None]
    out = {t.id: float(t.threshold) for t in trackers if t.threshold is not None}
    if not open_ones:
        return out
    if horizon * paths > BUDGET:
        raise ValueError("horizon times paths exceeds the simulation budget")
    if calibration < 1:
        raise ValueError("there are no calibration scores")
    place = ceil((paths + 1) * (1 - alpha / len(open_ones))) - 1
    if place >= paths:
        raise ValueError("too few paths for this false alarm probability")
    maxima = cut(spark.range(paths).mapInArrow(_maxima(open_ones, calibration, horizon, seed), "tracker int, code long"))
    for tracker, code in zip(open_ones, selected(maxima, len(open_ones), place), strict=True):
        log_cut = _decoded(code)
        if not np.isfinite(log_cut) or log_cut >= LOG_MAX:
            raise ValueError("the threshold is beyond the range of doubles")
        out[tracker.id] = float(np.nextafter(np.exp(log_cut), np.inf))
    return out
