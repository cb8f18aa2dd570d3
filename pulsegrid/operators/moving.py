"""Moving-statistic detectors as scans, and feature scalers as windows. A score never sees its own point: frames end at the row before."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from math import ceil, floor, fsum, isfinite, nan

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import scan

ONE_FEATURE = ("average", "average_absolute_deviation", "geometric_average", "harmonic_average", "interquartile_range", "kurtosis", "median", "quantile", "skewness", "variance")
TWO_FEATURES = ("correlation_coefficient", "covariance")


#: Statistics of the order of a window's values.
ORDER_STATISTICS = ("average_absolute_deviation", "interquartile_range", "median", "quantile")


class Sliding(scan.Tail):
    """`statistic` of the last `size` values before each row from a sorted window: each row puts one value in and takes one out, by binary search. Null unless the window is full and without nulls.

    NaN counts as larger than all numbers. For the deviation the window is parted at its mean, and the sums of both parts move with the values that change sides.
    """

    outputs = "statistic double"

    def __init__(self, column: str, size: int, kind: str, q: float):
        super().__init__(column, size)
        self.kind, self.places = kind, {"median": [0.5], "quantile": [q], "interquartile_range": [0.75, 0.25]}.get(kind, [])

    def run(self, state, n, columns):
        values, there = self.joined(state, columns)
        begun, size = len(state[0]), self.size
        odd_ones = there & np.isnan(values)
        plain = np.where(odd_ones, np.inf, values).tolist()
        lacking = np.concatenate(([0], np.cumsum(~there)))
        strange = np.concatenate(([0], np.cumsum(odd_ones)))
        known, out = there.tolist(), np.full(len(n), np.nan)
        none = np.ones(len(n), bool)
        window = sorted(x for x, ok in zip(plain[:begun], known[:begun], strict=True) if ok)
        deviation = Deviation(window) if self.kind == "average_absolute_deviation" else None
        for k in range(begun, len(plain)):
            if k >= size and lacking[k] == lacking[k - size]:
                odd = int(strange[k] - strange[k - size])
                out[k - begun] = (deviation.value() if not odd else np.nan) if deviation else self._ranked(window, odd)
                none[k - begun] = False
            if k >= size and known[k - size]:
                gone = bisect_left(window, plain[k - size])
                if deviation:
                    deviation.take(gone, plain[k - size])
                del window[gone]
            if known[k]:
                new = bisect_left(window, plain[k])
                window.insert(new, plain[k])
                if deviation:
                    deviation.put(new, plain[k])
        return [pa.array(out, mask=none)], self.last(values, there)

    def _ranked(self, window: list[float], odd: int) -> float:
        """Linear interpolation between the order statistics; of two places, their difference."""
        found = []
        for q in self.places:
            at = (len(window) - 1) * q
            low, high = floor(at), ceil(at)
            if high >= len(window) - odd:
                return nan
            found.append(window[low] + (window[high] - window[low]) * (at - low))
        return found[0] if len(found) == 1 else found[0] - found[1]


class Deviation:
    """The mean absolute deviation of a sorted window: below its mean lie `split` values with a sum of their own. Sums are taken anew once in so many changes as the window has values."""

    def __init__(self, window: list[float]):
        self.window, self.changes = window, 0
        self._anew()

    def _anew(self) -> None:
        self.total = fsum(self.window)
        self.split = bisect_left(self.window, self.total / max(1, len(self.window)))
        self.low, self.changes = fsum(self.window[: self.split]), 0

    def put(self, at: int, value: float) -> None:
        self.total += value
        if at < self.split:
            self.split, self.low = self.split + 1, self.low + value
        self.changes += 1

    def take(self, at: int, value: float) -> None:
        """Called before the value goes."""
        self.total -= value
        if at < self.split:
            self.split, self.low = self.split - 1, self.low - value
        self.changes += 1

    def value(self) -> float:
        size = len(self.window)
        if self.changes >= size or not isfinite(self.total):
            self._anew()
        mean = self.total / size
        while self.split < size and self.window[self.split] < mean:
            self.low += self.window[self.split]
            self.split += 1
        while self.split > 0 and self.window[self.split - 1] >= mean:
            self.split -= 1
            self.low -= self.window[self.split]
        return (2.0 * (mean * self.split - self.low) + self.total - mean * size) / size


#: Numbers in the frames that are looked at together.
CELLS = 1 << 18


class Frames(scan.Fold):
    """What `of` makes of some columns in the last `size` rows before each row and in the row itself; the last `size` rows are handed on. Null where fewer rows precede, or where one of them has no first column.

    of(w, there) has the values as (column, row, place in the frame), the row's own last, and whether they are known; it returns for each output its numbers and whether they are known.
    """

    def __init__(self, columns: list[str], size: int, outputs: list[str], of: Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]):
        self.inputs, self.size, self.names, self.of = list(dict.fromkeys(columns)), size, outputs, of
        self.columns, self.outputs = columns, ", ".join(f"`{c}` double" for c in outputs)
        self.fresh = self.neutral = (np.zeros((len(columns), 0)), np.zeros((len(columns), 0), bool))

    def _joined(self, state, columns):
        own = [columns[c] for c in self.columns]
        return np.hstack((state[0], [scan.numbers(c) for c in own])), np.hstack((state[1], [c.is_valid().to_numpy(zero_copy_only=False) for c in own]))

    def _last(self, values, there):
        first = max(0, values.shape[1] - self.size)
        return values[:, first:].copy(), there[:, first:].copy()

    def run(self, state, n, columns):
        values, there = self._joined(state, columns)
        begun, end, step = state[0].shape[1], values.shape[1], max(1, CELLS // (self.size * len(values)))
        out, known = np.full((len(self.names), len(n)), np.nan), np.zeros((len(self.names), len(n)), bool)
        first = max(begun, self.size)
        if first < end:
            w, ok = (np.lib.stride_tricks.sliding_window_view(x, self.size + 1, axis=1) for x in (values, there))
            lacking = np.concatenate(([0], np.cumsum(~there[0])))
            for k in range(first, end, step):
                rows = np.arange(k, min(k + step, end))
                full = lacking[rows] == lacking[rows - self.size]
                with np.errstate(all="ignore"):
                    made = self.of(w[:, rows[0] - self.size : rows[-1] + 1 - self.size], ok[:, rows[0] - self.size : rows[-1] + 1 - self.size])
                for j, (x, valid) in enumerate(made):
                    out[j, rows - begun], known[j, rows - begun] = x, valid & full
        return [pa.array(x, mask=~valid) for x, valid in zip(out, known, strict=True)], self._last(values, there)

    def summarise(self, summary, n, columns):
        return self._last(*self._joined(summary, columns))

    def join(self, state, summary):
        return self._last(*(np.hstack(x) for x in zip(state, summary, strict=True)))


def _statistic(kind: str) -> Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The statistic of full frames; that of no usable value is null, as are ratios of moments without spread."""

    def of(w, there):
        x = w[0, :, :-1]
        always = np.ones(len(x), bool)
        if kind == "average":
            return [(x.mean(1), always)]
        if kind in ("geometric_average", "harmonic_average"):
            used = (x > 0) | np.isnan(x) if kind == "geometric_average" else x != 0
            count = used.sum(1)
            y = np.where(used, x, 1.0)
            mean = np.where(used, np.log(y) if kind == "geometric_average" else 1.0 / y, 0.0).sum(1) / count
            return [(np.exp(mean) if kind == "geometric_average" else 1.0 / mean, count > 0)]
        c = x - x[:, :1]  # equal values leave zeros
        c -= c.mean(1, keepdims=True)
        square = c * c
        m2 = square.mean(1)
        if kind == "variance":
            return [(m2, always)]
        top = (square * c).mean(1) / m2**1.5 if kind == "skewness" else (square * square).mean(1) / (m2 * m2) - 3.0
        return [(top, m2 != 0)]

    if kind not in ("average", "geometric_average", "harmonic_average", "variance", "skewness", "kurtosis"):
        raise ValueError(f"no moving statistic {kind}")
    return of


def _moments(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs in each row of a and b that are known: how many, and the sums of their products about the means: a with b, a with a, b with b."""
    n, first = both.sum(1), both.argmax(1)[:, None]
    whole, out = bool(both.all()), []
    for x in (a, b):
        c = x - np.take_along_axis(x, first, 1)  # equal values leave zeros
        c = c if whole else np.where(both, c, 0.0)
        c = c - c.sum(1, keepdims=True) / n[:, None]
        out.append(c if whole else np.where(both, c, 0.0))
    x, y = out
    return n, (x * y).sum(1), (x * x).sum(1), (y * y).sum(1)


def _pair_change(kind: str, bias: bool) -> Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The correlation or covariance of full frames without and with the row itself."""

    def of(w, there):
        made = []
        for stop in (-1, None):
            n, xy, xx, yy = _moments(w[0, :, :stop], w[1, :, :stop], there[0, :, :stop] & there[1, :, :stop])
            if kind == "correlation_coefficient":
                spread = xx * yy
                made.append((xy / np.sqrt(spread), (n > 1) & (spread != 0)))
            else:
                less = 0 if bias else 1
                made.append((xy / (n - less), n > less))
        return made

    if kind not in TWO_FEATURES:
        raise ValueError(f"no moving statistic {kind} of two features")
    return of


def _distance(size: int) -> Callable[[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The distance of a row from the mean of its full frame, in units of the covariance, which is factored (Cholesky) column by column."""

    def of(w, there):
        past, known = w[:, :, :-1], there[:, :, :-1]
        gaps, valid, entries = [], there[:, :, -1].all(0), {}
        if known.all():
            c = past - past[:, :, :1]  # equal values leave zeros
            c -= c.mean(2, keepdims=True)
            entries = {(i, j): (c[i] * c[j]).mean(1) for i in range(size) for j in range(i + 1)}
            gaps = list(w[:, :, -1] - past.mean(2))
        else:
            for i in range(size):
                n = known[i].sum(1)
                gaps.append(w[i, :, -1] - np.where(known[i], past[i], 0.0).sum(1) / n)
                for j in range(i + 1):
                    both, xy, _, _ = _moments(past[i], past[j], known[i] & known[j])
                    entries[i, j], valid = xy / both, valid & (both > 0)
        lower, solved, square = {}, [], np.zeros(len(valid))

        def less(value: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            for a, b in pairs:
                value = value - a * b
            return value

        for j in range(size):
            pivot = less(entries[j, j], [(lower[j, k],) * 2 for k in range(j)])
            valid = valid & ~(pivot <= 1e-12 * entries[j, j])
            lower[j, j] = np.sqrt(pivot)
            for i in range(j + 1, size):
                lower[i, j] = less(entries[i, j], [(lower[i, k], lower[j, k]) for k in range(j)]) / lower[j, j]
            solved.append(less(gaps[j], [(lower[j, k], solved[k]) for k in range(j)]) / lower[j, j])
            square = square + solved[j] * solved[j]
        return [(np.sqrt(square), valid)]

    return of


def moving_scores(rows: DataFrame, keys: list[str], order: str, value: str, kind: str, window: int = 100, q: float = 0.5) -> DataFrame:
    """rows with `statistic` of the last `window` values before each row and `score`, the distance of the row's value from it; both null until the window is full.

    A scan hands the last `window` values on from part to part of a key; order statistics slide over a sorted window, the others are taken of each frame."""
    fold = Sliding(value, window, kind, q) if kind in ORDER_STATISTICS else Frames([value], window, ["statistic"], _statistic(kind))
    return scan.scanned(rows, keys, [order], fold).withColumn("score", F.abs(F.col(value) - F.col("statistic")))


def moving_pair_scores(rows: DataFrame, keys: list[str], order: str, x: str, y: str, kind: str, window: int = 100, bias: bool = True) -> DataFrame:
    """The same for two features: the change that the row makes to the correlation or covariance of the window."""
    made = scan.scanned(rows, keys, [order], Frames([x, y], window, ["statistic", "_with"], _pair_change(kind, bias)))
    return made.withColumn("score", F.abs(F.col("_with") - F.col("statistic"))).drop("_with")


def mahalanobis_scores(rows: DataFrame, keys: list[str], order: str, features: list[str], window: int = 100) -> DataFrame:
    """rows with `score`, the distance of a row's features from the mean of the window before it, in units of its covariance; null where that is singular."""
    return scan.scanned(rows, keys, [order], Frames(features, window, ["score"], _distance(len(features))))


def standard_scaled(rows: DataFrame, keys: list[str], order: str, value: str, with_std: bool = True) -> DataFrame:
    """rows with `scaled` by the mean and deviation of all earlier rows; 0 where there is no spread."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    centred = F.col(value) - F.avg(value).over(past)
    spread = F.stddev_pop(value).over(past)
    return rows.withColumn("scaled", F.coalesce(F.when(spread > 0, centred / spread).otherwise(0.0), F.lit(0.0)) if with_std else F.coalesce(centred, F.lit(0.0)))


def min_max_scaled(rows: DataFrame, keys: list[str], order: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """rows with `scaled` to the range by the extremes of all earlier rows; the low end where there is no range."""
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    least, most = F.min(value).over(past), F.max(value).over(past)
    return rows.withColumn("scaled", F.coalesce(F.when(most > least, (F.col(value) - least) / (most - least) * (high - low) + low).otherwise(low), F.lit(low)))


def projected(rows: DataFrame, features: list[str], matrix: list[list[float]]) -> DataFrame:
    """rows with `projected`, the product of a fixed matrix (a row for each component) with the features."""
    parts = []
    for component in matrix:
        total = F.lit(0.0)
        for weight, name in zip(component, features, strict=True):
            total = total + F.lit(float(weight)) * F.col(name)
        parts.append(total)
    return rows.withColumn("projected", F.array(*parts))


def random_matrix(n_features: int, n_components: int, seed: int) -> list[list[float]]:
    """Gaussian entries of variance 1 / n_components."""
    import numpy as np

    return (np.random.default_rng(seed).standard_normal((n_components, n_features)) / np.sqrt(n_components)).tolist()
