"""Sequential testing on conformal p-values: bets, martingales, alarm statistics, ensembles.

Products over a stream are sums of logarithms in the order of position. `keys` are the columns that tell streams apart.
"""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import scan
from pulsegrid.operators.thresholds import STATISTICS, Tracker
from pulsegrid.shared import cut

INFINITY = float("inf")
#: Logarithm of the largest double.
LOG_MAX = log(1.7976931348623157e308)
_LOGS = ("log_martingale", "log_cusum", "log_shiryaev_roberts", "log_restarted_martingale")


#: Keys whose numbers of calibration scores are sent to every task; of more they are joined by a shuffle.
BROADCAST_KEYS = 200_000


def p_values(scores: DataFrame, calibration: DataFrame, keys: list[str], score: str) -> DataFrame:
    """scores with p_value = (calibration scores at or above + 1) / (all + 1).

    Counts come from one ordered pass over both sides, not from pairs: a score's place among the calibration scores of its key, by a scan, so that one key's scores are read by many tasks.
    """
    both = scores.withColumn("_cal", F.lit(0)).unionByName(calibration.select(*keys, F.col(score), F.lit(1).alias("_cal")), allowMissingColumns=True)
    ranked = scan.scanned(both, keys, [F.col(score).desc(), F.col("_cal").desc()], scan.Running("_cal", "_above")).where("_cal = 0")
    totals = cut(calibration.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count("*").alias("_n")))
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_KEYS else totals
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]) if keys else F.lit(True)
    counted = ranked.join(totals, on, "left")
    return counted.withColumn("p_value", (F.col("_above") + 1.0) / (F.coalesce("_n", F.lit(0)) + 1.0)).drop("_cal", "_above", "_n", *[f"_of_{k}" for k in keys])


def checked_p(p: Column) -> Column:
    """p, or an error where it is null, not a number, or outside 0 to 1."""
    return F.when(F.coalesce(~F.isnan(p) & (p >= 0.0) & (p <= 1.0), F.lit(False)), p).otherwise(F.raise_error(F.lit("a p-value lies between 0 and 1")).cast("double"))


def power_log_e(p: Column, epsilon: float) -> Column:
    """Logarithm of the bet epsilon * p ** (epsilon - 1)."""
    return F.when(p == 0.0, INFINITY if epsilon < 1 else 0.0).otherwise(log(epsilon) + (epsilon - 1.0) * F.ln(p))


def epsilon_grid(epsilons: list[float] | None = None, n_grid: int = 10, min_epsilon: float = 0.1) -> list[float]:
    return list(epsilons) if epsilons else [float(x) for x in np.linspace(min_epsilon, 1.0, n_grid)]


class Statistics(scan.Fold):
    """n and the logarithms of the statistics after each bet. A state is (S, min(0, earlier S), log of the sum of exp(-S before a bet), the same weighed by 1 / (k (k + 1)))."""

    inputs, outputs, placed = ["_log_e"], "n long, " + ", ".join(f"{c} double" for c in _LOGS), True
    fresh, neutral = (0.0, 0.0, -INFINITY, -INFINITY), (0.0, INFINITY, -INFINITY, -INFINITY)

    def run(self, state, n, columns):
        s0, low0, sr0, rm0 = state
        log_e = scan.numbers(columns["_log_e"])
        none = np.isnan(log_e)
        s = np.cumsum(np.append(s0, np.where(none, 0.0, log_e)))
        lows = np.minimum.accumulate(np.append(low0, s[1:]))
        begun, places = np.where(none, -np.inf, -s[:-1]), n.astype(np.float64)
        sr = np.logaddexp.accumulate(np.append(sr0, begun))[1:]
        rm = np.logaddexp.accumulate(np.append(rm0, begun - np.log(places * (places + 1.0))))[1:]
        out = [n, s[1:], s[1:] - lows[:-1], s[1:] + sr, np.logaddexp(s[1:] + rm, -np.log(places + 1.0))]
        return out, (float(s[-1]), float(lows[-1]), float(sr[-1]), float(rm[-1]))

    def join(self, state, summary):
        s, low, sr, rm = state
        after, own_low, own_sr, own_rm = summary
        return (s + after, min(low, s + own_low), float(np.logaddexp(sr, own_sr - s)), float(np.logaddexp(rm, own_rm - s)))


def _with_statistics(parts: DataFrame, keys: list[str]) -> DataFrame:
    return scan.scan(parts, keys, Statistics()).drop("_log_e").withColumns({c.removeprefix("log_"): F.exp(c) for c in _LOGS})


def statistics(rows: DataFrame, keys: list[str], order: str, log_e: str = "log_e") -> DataFrame:
    """rows with n, log_martingale, martingale, cusum, shiryaev_roberts and restarted_martingale after each bet, the latter three also as log_cusum and so on.

    With S the running sum of log e: the martingale is exp(S); the CUSUM exp(S - min(0, earlier S)); Shiryaev-Roberts the sum of exp(S_n - S_(k-1)); the restarted
    martingale weighs the restart at k by 1 / (k (k + 1)) and leaves 1 / (n + 1) at one. Sums of exponentials are kept as logarithms, since exp(-S) overflows on long
    streams. The four are one scan: four numbers are handed on from part to part of a key.
    """
    return _with_statistics(scan.ordered(rows.withColumn("_log_e", F.col(log_e).cast("double")), keys, [order]), keys).drop(scan.PART)


def power(rows: DataFrame, keys: list[str], order: str, p: str, epsilon: float) -> DataFrame:
    return statistics(rows.withColumn("log_e", power_log_e(F.col(p), epsilon)), keys, order)


class Mixture(scan.Fold):
    """log_martingale, the logarithm of the mean of power martingales, and log_e, its growth. A state holds the logarithm of each."""

    outputs = "log_martingale double, log_e double"

    def __init__(self, p: str, grid: list[float]):
        self.inputs, self.grid = [p], np.array(grid, float)
        self.fresh = self.neutral = np.zeros(len(grid))

    def run(self, state, n, columns):
        p = scan.numbers(columns[self.inputs[0]])[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            bets = np.where(p == 0.0, np.where(self.grid < 1.0, np.inf, 0.0), np.log(self.grid) + (self.grid - 1.0) * np.log(p))
            sums = np.cumsum(np.vstack([state, np.where(np.isnan(p), 0.0, bets)]), axis=0)
            top = sums.max(axis=1)
            logs = np.where(np.isinf(top), top, top + np.log(np.exp(sums - top[:, None]).mean(axis=1)))
            return [logs[1:], np.diff(logs)], sums[-1]

    def join(self, state, summary):
        return state + summary


def mixture(rows: DataFrame, keys: list[str], order: str, p: str, grid: list[float]) -> DataFrame:
    """rows with the logarithm of the mean over the grid of the power martingales, and log_e, its growth at each row. A null p is no bet."""
    return scan.scanned(rows, keys, [order], Mixture(p, grid))


class Jumper(scan.Fold):
    """log_martingale, and log_e, its growth, of three accounts that bet 1 + e (p - 1/2) for e in -1, 0, 1 and mix by `jump` before each bet.

    A step is a linear map of the accounts, so a run of rows is a 3 x 3 matrix, kept with a logarithmic scale. A state holds the accounts, divided by their sum, and its logarithm.
    """

    outputs = "log_martingale double, log_e double"
    fresh, neutral = (np.full(3, 1.0 / 3.0), 0.0), (np.eye(3), 0.0)

    def __init__(self, p: str, jump: float):
        self.inputs, self.mix = [p], (1.0 - jump) * np.eye(3) + jump / 3.0

    def _blocks(self, columns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bets as (block, step, account), the steps of each block, and the blocks' maps with their logarithms; as many blocks as steps in one, about."""
        p = scan.numbers(columns[self.inputs[0]])
        bets = np.where(np.isnan(p), 1.0, 1.0 + np.array([[-1.0], [0.0], [1.0]]) * (p - 0.5)).T
        length = int(np.ceil(np.sqrt(len(p))))
        counts = np.full(-(-len(p) // length), length)
        counts[-1] = len(p) - length * (len(counts) - 1)
        padded = np.ones((len(counts) * length, 3))
        padded[: len(p)] = bets
        padded = padded.reshape(len(counts), length, 3)
        maps, logs = np.repeat(np.eye(3)[None], len(counts), axis=0), np.zeros(len(counts))
        for t in range(length):
            live = counts > t
            after = (maps[live] @ self.mix) * padded[live, t][:, None, :]
            total = after.sum(axis=(1, 2))
            maps[live], logs[live] = after / total[:, None, None], logs[live] + np.log(total)
        return padded, counts, maps, logs

    def run(self, state, n, columns):
        padded, counts, maps, logs = self._blocks(columns)
        before = state[1]
        accounts, log0 = np.empty((len(counts), 3)), np.empty(len(counts))
        for k in range(len(counts)):
            accounts[k], log0[k] = state
            state = self.join(state, (maps[k], logs[k]))
        out = np.empty(padded.shape[:2])
        for t in range(padded.shape[1]):
            accounts = (accounts @ self.mix) * padded[:, t]
            total = accounts.sum(axis=1)
            accounts, log0 = accounts / total[:, None], log0 + np.log(total)
            out[:, t] = log0
        out = out.ravel()[: len(n)]
        return [out, np.diff(out, prepend=before)], state

    def summarise(self, summary, n, columns):
        _, _, maps, logs = self._blocks(columns)
        for own, log_own in zip(maps, logs, strict=True):
            summary = self.join(summary, (own, log_own))
        return summary

    def join(self, state, summary):
        after = state[0] @ summary[0]
        return after / after.sum(), float(state[1] + summary[1] + np.log(after.sum()))


def jumper(rows: DataFrame, keys: list[str], order: str, p: str, jump: float = 0.01) -> DataFrame:
    """rows with log_martingale and log_e of the simple jumper (see Jumper). A null p is no bet."""
    return scan.scanned(rows, keys, [order], Jumper(p, jump))


def payload(log_value: Column) -> Column:
    """struct(value, is_infinite, log_value) for storage: no infinities and no not-a-numbers."""
    return F.struct(
        F.when((log_value <= LOG_MAX) & ~F.isnan(log_value), F.exp(log_value)).alias("value"), F.coalesce((log_value > LOG_MAX) & ~F.isnan(log_value), F.lit(False)).alias("is_infinite"),
        F.when((F.abs(log_value) < INFINITY) & ~F.isnan(log_value), log_value).alias("log_value"),
    )


def horizon_windows(rows: DataFrame, keys: list[str], order: str, horizon: int) -> DataFrame:
    """rows with window (from 0), window_position (from 1) and window_reset (a new window began here after an earlier one)."""
    marked = scan.scanned(rows.withColumn("_own", F.struct(*rows.columns)), keys, [order], scan.Place()).withColumn("window", F.floor((F.col("n") - 1) / horizon))
    marked = marked.select("_own.*", "window", ((F.col("n") - 1) % horizon + 1).cast("long").alias("window_position"))
    return marked.withColumn("window_reset", (F.col("window_position") == 1) & (F.col("window") > 0))


def _limit(tracker: Tracker) -> Column:
    return tracker.threshold.cast("double") if isinstance(tracker.threshold, Column) else F.lit(float(tracker.threshold))


def _bets(rows: DataFrame, keys: list[str], order: str, p: str, trackers: list[Tracker]) -> DataFrame:
    """(keys, order, tracker_id, statistic, threshold, log_e): the growth of each tracker's capital at each row. Power bets are exploded; mixtures and jumpers take a scan each."""
    powers, parts = [t for t in trackers if t.bet == "power"], []
    if powers:
        made = F.array(*[F.struct(F.lit(t.id).alias("tracker_id"), F.lit(t.statistic).alias("statistic"), _limit(t).alias("threshold"), F.lit(float(t.epsilon)).alias("_epsilon")) for t in powers])
        each = rows.select(*keys, order, p, F.explode(made).alias("_t")).select(*keys, order, p, "_t.*")
        bet = F.when(F.col(p) == 0.0, F.when(F.col("_epsilon") < 1.0, INFINITY).otherwise(0.0)).otherwise(F.ln("_epsilon") + (F.col("_epsilon") - 1.0) * F.ln(p))
        parts.append(each.withColumn("log_e", bet).drop(p, "_epsilon"))
    if len(powers) < len(trackers):
        dealt = scan.ordered(rows.select(*keys, order, F.col(p).cast("double").alias(p)), keys, [order])
        for t in trackers:
            if t.bet != "power":
                own = scan.scan(dealt, keys, Mixture(p, list(t.grid)) if t.bet == "mixture" else Jumper(p, t.jump))
                parts.append(own.select(*keys, order, F.lit(t.id).alias("tracker_id"), F.lit(t.statistic).alias("statistic"), _limit(t).alias("threshold"), "log_e"))
    return reduce(DataFrame.unionByName, parts)


def ensemble(rows: DataFrame, keys: list[str], order: str, p: str, trackers: list[Tracker | tuple[str, float, str, float]]) -> DataFrame:
    """(keys, order, alarm, alarm_count, tested_count) of up to 16 trackers with thresholds on one stream of p-values; a tuple (id, epsilon, statistic, threshold) is a power tracker.

    A threshold may also be a column made of the keys. A tracker fires where the statistic of its growth reaches its threshold after a row below it; any firing is the ensemble's alarm.
    """
    trackers = [t if isinstance(t, Tracker) else Tracker(t[0], t[2], epsilon=t[1], threshold=t[3]) for t in trackers]
    if not 1 <= len(trackers) <= 16 or any(t.threshold is None for t in trackers):
        raise ValueError("1 to 16 trackers with thresholds")
    own = [*keys, "tracker_id"]
    each = _bets(rows, keys, order, p, trackers).withColumn("_log_e", F.col("log_e").cast("double")).drop("log_e")
    stats = _with_statistics(scan.ordered(each, own, [order]), own)
    value = F.when(F.col("statistic") == "martingale", F.col("martingale")).when(F.col("statistic") == "cusum", F.col("cusum")).when(F.col("statistic") == "shiryaev_roberts", F.col("shiryaev_roberts")).otherwise(F.col("restarted_martingale"))
    fired = scan.scan(stats.withColumn("crossed", value >= F.col("threshold")), own, scan.Edges())
    return fired.groupBy(*keys, order).agg(F.bool_or("fired").alias("alarm"), F.sum("alarm_count").alias("alarm_count"), F.max("n").alias("tested_count"))


def fallback_scores(rows: DataFrame, keys: list[str], order: str, mean: str, size: int = 2000) -> DataFrame:
    """rows with the diagnostic score min(|x - running mean| / (1 + 1e-8), 1). The running mean has the row itself in it: the plain mean up to the
    100th row, then it moves by a hundredth of each difference. The first score is 0; the score raises no alarm.

    Beyond the 100th row the mean is a geometric sum, taken within blocks of `size` rows (2000 or more) plus the ends of the two blocks before; what lies further back weighs less than a double's last bit.
    """
    q = 0.99
    seen = Window.partitionBy(*keys).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(seen))
    numbered = numbered.withColumn("_head", F.avg(F.when(F.col("_n") <= 100, F.col(mean))).over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    late = numbered.withColumn("_k", F.greatest(F.col("_n") - 100, F.lit(0))).withColumn("_b", F.floor((F.col("_k") - 1) / size)).withColumn("_i", F.pmod(F.col("_k") - 1, F.lit(size)))
    term = F.when(F.col("_k") > 0, F.col(mean) * (1 - q) * F.pow(F.lit(q), -F.col("_i")))
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    late = late.withColumn("_sum", F.coalesce(F.sum(term).over(inside), F.lit(0.0)) * F.pow(F.lit(q), F.col("_i")))
    ends = late.where("_k > 0").groupBy(*keys, "_b").agg(F.max_by("_sum", "_i").alias("_end"))
    blocks = Window.partitionBy(*keys).orderBy("_b")
    before = ends.select(*keys, "_b", (F.coalesce(F.lag("_end").over(blocks), F.lit(0.0)) + F.coalesce(F.lag("_end", 2).over(blocks), F.lit(0.0)) * q**size).alias("_from"))
    joined = late.join(before, [*keys, "_b"], "left")
    running = F.when(F.col("_k") <= 0, F.col("_head")).otherwise(F.col("_head") * F.pow(F.lit(q), F.col("_k")) + F.coalesce("_from", F.lit(0.0)) * F.pow(F.lit(q), F.col("_i") + 1) + F.col("_sum"))
    out = joined.withColumn("score", F.least(F.abs(F.col(mean) - running) / (1.0 + 1e-8), F.lit(1.0)))
    return out.drop("_n", "_head", "_k", "_b", "_i", "_sum", "_from")
