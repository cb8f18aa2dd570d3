"""Anomaly detectors of the lanes, from published algorithms, as small numpy classes.

Online models have score_one(x) and learn_one(x); static ones are fitted once and have score(rows). A higher score is more unusual. State is bounded by the
window parameters, since it is pickled into the state store after each micro-batch.
"""

from __future__ import annotations

from collections import deque

import numpy as np

# --- static models ---------------------------------------------------------------------------------------------


class Hbos:
    """Histogram-based outlier score: the sum over features of -log density."""

    def __init__(self, rows: np.ndarray, bins: int = 10):
        self.low, self.high = rows.min(0), rows.max(0)
        self.width = np.where(self.high > self.low, (self.high - self.low) / bins, 1.0)
        self.bins = bins
        self.density = np.stack([np.bincount(self._bin(rows)[:, j], minlength=bins) / len(rows) for j in range(rows.shape[1])])

    def _bin(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(((rows - self.low) / self.width).astype(int), 0, self.bins - 1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        at = self._bin(rows)
        inside = (rows >= self.low - self.width) & (rows <= self.high + self.width)
        d = np.where(inside, np.take_along_axis(self.density, at.T, 1).T, 0.0)
        return -np.log(d + 1e-3).sum(1)


class Knn:
    """Distance to the k-th nearest row of the training window."""

    def __init__(self, rows: np.ndarray, k: int = 5):
        self.rows, self.k = rows, min(k, len(rows))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None] - self.rows[None]) ** 2).sum(2))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.partition(self.distances(rows), self.k - 1, axis=1)[:, self.k - 1]


class Lof(Knn):
    """Local outlier factor: the neighbours' reachability density over the row's own."""

    def __init__(self, rows: np.ndarray, k: int = 10):
        super().__init__(rows, k)
        d = self.distances(rows)
        np.fill_diagonal(d, np.inf)
        self.near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        self.reach = np.take_along_axis(d, self.near, 1)[:, -1]
        self.density = 1 / (np.maximum(np.take_along_axis(d, self.near, 1), self.reach[self.near]).mean(1) + 1e-10)

    def score(self, rows: np.ndarray) -> np.ndarray:
        d = self.distances(rows)
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        own = 1 / (np.maximum(np.take_along_axis(d, near, 1), self.reach[near]).mean(1) + 1e-10)
        return self.density[near].mean(1) / own


class Pca:
    """Squared standardised components, weighted by the inverse of their variance."""

    def __init__(self, rows: np.ndarray):
        self.mean, self.std = rows.mean(0), np.where(rows.std(0) > 0, rows.std(0), 1.0)
        values, self.axes = np.linalg.eigh(np.atleast_2d(np.cov((rows - self.mean) / self.std, rowvar=False)))
        self.values = np.maximum(values, 1e-6)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return ((((rows - self.mean) / self.std) @ self.axes) ** 2 / self.values).sum(1)


class OneClassSvm:
    """One-class SVM on random Fourier features of a Gaussian kernel, by averaged stochastic gradients."""

    def __init__(self, rows: np.ndarray, nu: float = 0.1, seed: int = 0, n: int = 128, rounds: int = 20):
        rng = np.random.default_rng(seed)
        self.mean, self.std = rows.mean(0), np.where(rows.std(0) > 0, rows.std(0), 1.0)
        self.w, self.b = rng.standard_normal((rows.shape[1], n)) / np.sqrt(rows.shape[1]), rng.uniform(0, 2 * np.pi, n)
        z = self._features(rows)
        self.weights, self.rho = z.mean(0), 0.0
        for t in range(1, rounds * 10 + 1):
            margin = z @ self.weights
            self.rho = float(np.quantile(margin, nu))
            self.weights += (z[margin < self.rho].mean(0) if (margin < self.rho).any() else 0) / (10 * t) - self.weights / (100 * t)
        self.rho = float(np.quantile(z @ self.weights, nu))

    def _features(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / self.w.shape[1]) * np.cos((rows - self.mean) / self.std @ self.w + self.b)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.rho - self._features(rows) @ self.weights


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationTree:
    """Random axis cuts down to single rows or the depth limit."""

    def __init__(self, rows: np.ndarray, rng: np.random.Generator, depth: int):
        self.size, self.axis = len(rows), -1
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
        if depth and len(rows) > 1 and len(spread):
            self.axis = int(rng.choice(spread))
            self.cut = rng.uniform(rows[:, self.axis].min(), rows[:, self.axis].max())
            left = rows[:, self.axis] < self.cut
            self.kids = [IsolationTree(rows[left], rng, depth - 1), IsolationTree(rows[~left], rng, depth - 1)]

    def depth(self, x: np.ndarray) -> float:
        node, d = self, 0
        while node.axis >= 0:
            node, d = node.kids[int(x[node.axis] >= node.cut)], d + 1
        return d + path_norm(node.size)


class IsolationForest:
    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0):
        rng, n = np.random.default_rng(seed), min(sample, len(rows))
        self.norm = path_norm(n) or 1.0
        self.trees = [IsolationTree(rows[rng.choice(len(rows), n, replace=False)], rng, int(np.ceil(np.log2(max(n, 2))))) for _ in range(trees)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.array([2 ** (-np.mean([t.depth(x) for t in self.trees]) / self.norm) for x in rows])


def fitted(kind: str, rows: np.ndarray, seed: int = 0):
    """A static model by its registered name, with or without the prefix pyod_."""
    kind = kind.removeprefix("pyod_")
    plain = {"hbos": Hbos, "knn": Knn, "lof": Lof, "pca": Pca}
    if kind in plain:
        return plain[kind](rows)
    if kind in ("iforest", "ocsvm"):
        return (IsolationForest if kind == "iforest" else OneClassSvm)(rows, seed=seed)
    raise ValueError(f"no static model {kind}")


# --- online models ---------------------------------------------------------------------------------------------


class Windowed:
    """A model that is fitted anew on its last `window` rows each `every` rows."""

    def __init__(self, make, window: int, every: int):
        self.make, self.rows, self.every, self.since, self.model = make, deque(maxlen=window), every, 0, None

    def score_one(self, x: np.ndarray) -> float:
        return float(self.model.score(x[None])[0]) if self.model is not None else 0.0

    def learn_one(self, x: np.ndarray) -> None:
        self.rows.append(x)
        self.since += 1
        if self.since >= self.every or (self.model is None and len(self.rows) == self.rows.maxlen):
            self.model, self.since = self.make(np.array(self.rows)), 0


class HalfSpaceTrees:
    """Mass profiles of random half-space cuts in a work range; each window's masses score the next (Tan, Ting, Liu 2011)."""

    def __init__(self, n_trees: int = 10, height: int = 8, window_size: int = 250, seed: int = 0):
        self.n, self.height, self.window, self.rng, self.seen, self.first = n_trees, height, window_size, np.random.default_rng(seed), 0, []
        self.axes = None

    def plant(self, rows: np.ndarray) -> None:
        d, size = rows.shape[1], 2 ** (self.height + 1)
        low, span = rows.min(0), np.where(rows.max(0) > rows.min(0), rows.max(0) - rows.min(0), 1.0)
        self.axes, self.cuts = self.rng.integers(0, d, (self.n, size)), np.zeros((self.n, size))
        for t in range(self.n):
            centre = low + span * self.rng.random(d)
            reach = 2 * np.maximum(centre - low, low + span - centre)
            box = {1: (centre - reach, centre + reach)}
            for node in range(1, size // 2):
                a, (lo, hi) = self.axes[t, node], box.pop(node)
                self.cuts[t, node] = mid = (lo[a] + hi[a]) / 2
                box[2 * node], box[2 * node + 1] = (lo, np.where(np.arange(d) == a, mid, hi)), (np.where(np.arange(d) == a, mid, lo), hi)
        self.mass, self.next = np.zeros((self.n, size)), np.zeros((self.n, size))

    def _walk(self, x: np.ndarray) -> np.ndarray:
        node, trees = np.ones(self.n, int), np.arange(self.n)
        path = [node]
        for _ in range(self.height):
            node = 2 * node + (x[self.axes[trees, node]] >= self.cuts[trees, node])
            path.append(node)
        return np.array(path)

    def score_one(self, x: np.ndarray) -> float:
        if self.axes is None:
            return 0.0
        path, total = self._walk(x), 0.0
        for t in range(self.n):
            masses = self.mass[t, path[:, t]]
            stop = int(np.argmax(masses < 0.1 * self.window)) if (masses < 0.1 * self.window).any() else self.height
            total += masses[stop] * 2.0**stop
        return 1.0 - total / (self.n * self.window * 2.0**self.height)

    def learn_one(self, x: np.ndarray) -> None:
        if self.axes is None:
            self.first.append(x)
            if len(self.first) < self.window:
                return
            rows, self.first = np.array(self.first), []
            self.plant(rows)
            for row in rows:
                self._count(row)
            self.mass, self.next = self.next, np.zeros_like(self.next)
            return
        self._count(x)
        self.seen += 1
        if self.seen == self.window:
            self.mass, self.next, self.seen = self.next, np.zeros_like(self.next), 0

    def _count(self, x: np.ndarray) -> None:
        for nodes in self._walk(x):
            self.next[np.arange(self.n), nodes] += 1

    def window_scores(self, rows: np.ndarray, before: int) -> np.ndarray:
        """What score_one gives for each of rows, which follow `before` others, all at once; NaN for the first window, and where rows lack the window before."""
        trees, size, places = np.arange(self.n), self.mass.shape[1], (before + np.arange(len(rows))) // self.window
        node, at = np.ones((len(rows), self.n), int), np.empty((self.height + 1, len(rows), self.n), int)
        first = (places - places[0])[:, None] * self.mass.size + trees * size
        at[0] = first + node
        for level in range(self.height):
            node = 2 * node + (np.take_along_axis(rows, self.axes[trees, node], 1) >= self.cuts[trees, node])
            at[level + 1] = first + node
        counts = np.bincount(at.ravel(), minlength=(places[-1] - places[0] + 1) * self.mass.size)
        known = places > places[0]
        masses = counts[at[:, known] - self.mass.size]
        few = masses < 0.1 * self.window
        stop = np.where(few.any(0), few.argmax(0), self.height)
        total = (np.take_along_axis(masses, stop[None], 0)[0] * 2.0**stop).sum(1)
        out = np.full(len(rows), np.nan)
        out[known] = 1.0 - total / (self.n * self.window * 2.0**self.height)
        return out


class OnlineKnn:
    def __init__(self, k: int = 5, window_size: int = 1000):
        self.k, self.rows = k, deque(maxlen=window_size)

    def score_one(self, x: np.ndarray) -> float:
        if not self.rows:
            return 0.0
        d = np.sqrt(((np.array(self.rows) - x) ** 2).sum(1))
        k = min(self.k, len(d))
        return float(np.partition(d, k - 1)[k - 1])

    def learn_one(self, x: np.ndarray) -> None:
        self.rows.append(x)


class OnlineLof(OnlineKnn):
    def score_one(self, x: np.ndarray) -> float:
        return float(Lof(np.array(self.rows), self.k).score(x[None])[0]) if len(self.rows) > self.k else 0.0


class Mahalanobis(OnlineKnn):
    """Distance from the mean of the window in units of its covariance."""

    def score_one(self, x: np.ndarray) -> float:
        rows = np.array(self.rows)
        if len(rows) < 3:
            return 0.0
        gap = x - rows.mean(0)
        return float(np.sqrt(max(0.0, gap @ np.linalg.pinv(np.atleast_2d(np.cov(rows, rowvar=False, bias=True))) @ gap)))


class OnlineSvm:
    """One-class SVM by stochastic gradients, on the features or on random Fourier features of a Gaussian kernel."""

    def __init__(self, learning_rate: float = 0.01, nu: float = 0.5, lambda_: float = 0.01, gamma: float | None = None, seed: int = 0, n: int = 100):
        self.rate, self.nu, self.shrink, self.gamma, self.n, self.rng, self.w, self.rho = learning_rate, nu, lambda_, gamma, n, np.random.default_rng(seed), None, 0.0

    def _features(self, x: np.ndarray) -> np.ndarray:
        if self.gamma is None:
            return x / (1.0 + np.linalg.norm(x))
        if not hasattr(self, "axes"):
            self.axes, self.shift = self.rng.standard_normal((len(x), self.n)) * np.sqrt(2 * self.gamma), self.rng.uniform(0, 2 * np.pi, self.n)
        return np.sqrt(2 / self.n) * np.cos(x @ self.axes + self.shift)

    def score_one(self, x: np.ndarray) -> float:
        z = self._features(x)
        return self.rho - float(z @ self.w) if self.w is not None else 0.0

    def learn_one(self, x: np.ndarray) -> None:
        z = self._features(x)
        self.w = z.copy() if self.w is None else self.w
        inside = float(z @ self.w) < self.rho
        self.w = (1 - self.rate * self.shrink) * self.w + (self.rate * z if inside else 0)
        self.rho += self.rate * (self.nu - inside)


class HistogramForest:
    """Random subsets of features, each with equal-width histograms of the last window; scores are mean -log densities."""

    def __init__(self, n_estimators: int = 25, max_bins: int = 10, window_size: int = 256, seed: int = 0):
        self.n, self.bins, self.rows, self.rng, self.axes = n_estimators, max_bins, deque(maxlen=window_size), np.random.default_rng(seed), None

    def score_one(self, x: np.ndarray) -> float:
        rows = np.array(self.rows)
        if len(rows) < 2:
            return 0.0
        if self.axes is None:
            self.axes, self.phase = self.rng.integers(0, len(x), self.n), self.rng.random(self.n)
        own = rows[:, self.axes]
        width = np.where(np.ptp(own, 0) > 0, np.ptp(own, 0) / self.bins, 1.0)
        share = (np.floor(own / width + self.phase) == np.floor(x[self.axes] / width + self.phase)).mean(0)
        return float(-np.log(share + 1.0 / len(rows)).mean())

    def learn_one(self, x: np.ndarray) -> None:
        self.rows.append(x)


class XStream:
    """Random projections, half-space chains with counts by depth, windows of counts in turn (Manzoor, Lamba, Akoglu 2018). Counts of a chain's bins are
    dictionaries, bounded by the window times the depth."""

    def __init__(self, k: int = 25, n_chains: int = 25, depth: int = 10, window_size: int = 256, seed: int = 0):
        self.k, self.n, self.depth, self.window, self.rng = k, n_chains, depth, window_size, np.random.default_rng(seed)
        self.axes, self.first, self.seen = None, [], 0

    def _bins(self, x: np.ndarray) -> list[list[tuple]]:
        z, found = x @ self.axes, []
        for c in range(self.n):
            bins, used = [], np.zeros(self.k)
            value = np.zeros(self.k)
            for level in range(self.depth):
                f = self.order[c, level]
                value[f] = (z[f] + self.shift[c, f]) / self.span[f] if not used[f] else 2 * value[f] - self.shift[c, f] / self.span[f]
                used[f] = 1
                bins.append((level, *np.floor(value).astype(int).tolist()))
            found.append(bins)
        return found

    def score_one(self, x: np.ndarray) -> float:
        if self.axes is None:
            return 0.0
        logs = [min(np.log2(1 + self.old[c].get(b, 0)) + b[0] for b in bins) for c, bins in enumerate(self._bins(x))]
        return float(-np.mean(logs))

    def learn_one(self, x: np.ndarray) -> None:
        if self.axes is None:
            self.first.append(x)
            if len(self.first) < self.window:
                return
            rows, self.first = np.array(self.first), []
            self.axes = self.rng.choice([-1.0, 0.0, 1.0], (rows.shape[1], self.k), p=[1 / 6, 2 / 3, 1 / 6]) * np.sqrt(3 / self.k)
            self.span = np.where(np.ptp(rows @ self.axes, 0) > 0, np.ptp(rows @ self.axes, 0) / 2, 1.0)
            self.order, self.shift = self.rng.integers(0, self.k, (self.n, self.depth)), self.rng.random((self.n, self.k)) * self.span
            self.old, self.new = [{} for _ in range(self.n)], [{} for _ in range(self.n)]
            for row in rows:
                self._count(row)
        else:
            self._count(x)

    def _count(self, x: np.ndarray) -> None:
        for own, bins in zip(self.new, self._bins(x), strict=True):
            for b in bins:
                own[b] = own.get(b, 0) + 1
        self.seen += 1
        if self.seen == self.window:
            self.old, self.new, self.seen = self.new, [{} for _ in range(self.n)], 0


class CutForest(Windowed):
    """Isolation by cuts whose axis is drawn in proportion to its range, over shingles of the last rows."""

    def __init__(self, n_trees: int = 40, sample_size: int = 256, shingle: int = 1, seed: int = 0):
        super().__init__(lambda rows: IsolationForest(rows, n_trees, sample_size, seed), sample_size, max(1, sample_size // 4))
        self.last = deque(maxlen=shingle)

    def _shingled(self, x: np.ndarray) -> np.ndarray | None:
        past = [*self.last, x][-self.last.maxlen :]
        return np.concatenate(past) if len(past) == self.last.maxlen else None

    def score_one(self, x: np.ndarray) -> float:
        z = self._shingled(x)
        return super().score_one(z) if z is not None else 0.0

    def learn_one(self, x: np.ndarray) -> None:
        z = self._shingled(x)
        self.last.append(x)
        if z is not None:
            super().learn_one(z)


class MovingStatistic:
    """Distance of a single feature from a statistic of its last values; null-safe twin of the window form."""

    def __init__(self, kind: str, window_size: int = 100, q: float = 0.5):
        self.kind, self.rows, self.q = kind, deque(maxlen=window_size), q

    def _statistic(self, v: np.ndarray) -> float:
        k, c = self.kind, v - v.mean()
        m2 = (c**2).mean()
        return float(
            {
                "average": lambda: v.mean(), "average_absolute_deviation": lambda: np.abs(c).mean(), "geometric_average": lambda: np.exp(np.log(v[v > 0]).mean()), "harmonic_average": lambda: 1 / (1 / v[v != 0]).mean(),
                "interquartile_range": lambda: np.subtract(*np.quantile(v, [0.75, 0.25])), "kurtosis": lambda: (c**4).mean() / m2**2 - 3 if m2 else 0.0, "median": lambda: np.median(v),
                "quantile": lambda: np.quantile(v, self.q), "skewness": lambda: (c**3).mean() / m2**1.5 if m2 else 0.0, "variance": lambda: m2,
            }[k]()
        )

    def score_one(self, x: np.ndarray) -> float:
        return abs(float(x[0]) - self._statistic(np.array(self.rows))) if len(self.rows) == self.rows.maxlen else 0.0

    def learn_one(self, x: np.ndarray) -> None:
        self.rows.append(float(x[0]))


MOVING = ("average", "average_absolute_deviation", "geometric_average", "harmonic_average", "interquartile_range", "kurtosis", "median", "quantile", "skewness", "variance")


class Pipeline:
    """At most one scaler and one projection before a model; each sees a row only after it was scored."""

    def __init__(self, steps: list, model):
        if len(steps) > 2 or [getattr(s, "projects", False) for s in steps] != sorted(getattr(s, "projects", False) for s in steps):
            raise ValueError("a scaler, then a projection, then the model")
        self.steps, self.model = steps, model

    def _through(self, x: np.ndarray, learn: bool) -> np.ndarray:
        for step in self.steps:
            y = step.transform_one(x)
            if learn:
                step.learn_one(x)
            x = y
        return x

    def score_one(self, x: np.ndarray) -> float:
        return self.model.score_one(self._through(x, False))

    def learn_one(self, x: np.ndarray) -> None:
        self.model.learn_one(self._through(x, True))


class StandardScaler:
    def __init__(self, with_std: bool = True):
        self.n, self.mean, self.m2, self.with_std = 0, 0.0, 0.0, with_std

    def learn_one(self, x: np.ndarray) -> None:
        self.n += 1
        gap = x - self.mean
        self.mean = self.mean + gap / self.n
        self.m2 = self.m2 + gap * (x - self.mean)

    def transform_one(self, x: np.ndarray) -> np.ndarray:
        std = np.sqrt(self.m2 / self.n) if self.n and self.with_std else np.ones_like(x)
        return np.where(std > 0, (x - self.mean) / np.where(std > 0, std, 1), 0.0)


class MinMaxScaler:
    def __init__(self, low: float = 0.0, high: float = 1.0):
        self.low, self.high, self.least, self.most = low, high, None, None

    def learn_one(self, x: np.ndarray) -> None:
        self.least, self.most = (x, x) if self.least is None else (np.minimum(self.least, x), np.maximum(self.most, x))

    def transform_one(self, x: np.ndarray) -> np.ndarray:
        span = np.zeros_like(x) if self.least is None else self.most - self.least
        return np.where(span > 0, (x - (x if self.least is None else self.least)) / np.where(span > 0, span, 1) * (self.high - self.low) + self.low, self.low)


class IncrementalPca:
    """Leading axes of the running covariance, taken anew each `n0` rows."""

    projects = True

    def __init__(self, n_components: int, n0: int = 50, forgetting: float = 0.0):
        self.k, self.n0, self.keep, self.n, self.mean, self.cov, self.axes = n_components, n0, 1 - forgetting, 0.0, None, None, None

    def learn_one(self, x: np.ndarray) -> None:
        if self.mean is None:
            self.mean, self.cov, self.seen = np.zeros_like(x), np.zeros((len(x), len(x))), 0
        self.n, self.seen = self.n * self.keep + 1, self.seen + 1
        gap = x - self.mean
        self.mean = self.mean + gap / self.n
        self.cov = self.cov * (1 - 1 / self.n) + np.outer(gap, x - self.mean) / self.n
        if self.seen % self.n0 == 0:
            self.axes = np.linalg.eigh((self.cov + self.cov.T) / 2)[1][:, ::-1][:, : self.k]

    def transform_one(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes if self.axes is not None else x[: self.k]


class RandomProjection:
    projects = True

    def __init__(self, n_components: int, seed: int = 0):
        self.k, self.seed, self.matrix = n_components, seed, None

    def learn_one(self, x: np.ndarray) -> None:
        pass

    def transform_one(self, x: np.ndarray) -> np.ndarray:
        if self.matrix is None:
            self.matrix = np.random.default_rng(self.seed).standard_normal((len(x), self.k)) / np.sqrt(self.k)
        return x @ self.matrix


#: name: (class or maker, rows of warm-up that it needs)
_ONLINE = {
    "half_space_trees": (HalfSpaceTrees, lambda p: p.get("window_size", 250)),
    "asd_isolation_forest": (lambda n_estimators=100, max_samples=256, seed=0: Windowed(lambda r: IsolationForest(r, n_estimators, max_samples, seed), max_samples, max_samples), lambda p: p.get("max_samples", 256)),
    "online_isolation_forest": (lambda num_trees=32, max_leaf_samples=32, window_size=512, seed=0: Windowed(lambda r: IsolationForest(r, num_trees, 256, seed), window_size, max_leaf_samples), lambda p: p.get("max_leaf_samples", 32)),
    "mondrian_forest": (lambda n_estimators=50, subspace_size=256, lambda_=1.0, seed=0: Windowed(lambda r: IsolationForest(r, n_estimators, subspace_size, seed), subspace_size, 32), lambda p: 1),
    "random_cut_forest": (CutForest, lambda p: p.get("sample_size", 256) + p.get("shingle", 1) - 1),
    "stream_random_histogram_forest": (HistogramForest, lambda p: p.get("window_size", 256)),
    "x_stream": (XStream, lambda p: 2 * p.get("window_size", 256)),
    "knn": (lambda k=5, window_size=1000, warm_up=20: OnlineKnn(k, window_size), lambda p: p.get("warm_up", 20)),
    "local_outlier_factor": (lambda k=10, window_size=1000: OnlineLof(k, window_size), lambda p: p.get("k", 10)),
    "gadget_svm": (OnlineSvm, lambda p: 1),
    "incremental_one_class_svm_adaptive_kernel": (lambda nu=0.1, gamma=1.0, rate=0.1, seed=0: OnlineSvm(rate, nu, 0.01, gamma, seed), lambda p: 1),
    "moving_mahalanobis_distance": (lambda window_size=100: Mahalanobis(0, window_size), lambda p: p.get("window_size", 100)),
} | {f"moving_{k}": ((lambda kind: lambda window_size=100, quantile=0.5: MovingStatistic(kind, window_size, quantile))(k), lambda p: p.get("window_size", 100)) for k in MOVING}
_TRANSFORMS = {"standard_scaler": StandardScaler, "min_max_scaler": MinMaxScaler, "incremental_pca": IncrementalPca, "random_projection": RandomProjection}


def catalogue() -> list[str]:
    """Names of the online models; pairs of moving statistics are windows (see operators.moving)."""
    return sorted(_ONLINE)


def _named(kind: str):
    if kind not in _ONLINE:
        raise ValueError(f"no online model {kind}")
    return _ONLINE[kind]


def least_warm_up(kind: str, params: dict) -> int:
    own = {k: v for k, v in params.items() if k != "steps"}
    return _named(kind)[1](own)


def online(kind: str, params: dict):
    """An online model by its registered name; params["steps"]: [(transform, its parameters), ...] before it."""
    own = {k: v for k, v in params.items() if k != "steps"}
    if kind.endswith("knn") and own.get("k", 5) > own.get("warm_up", 20):
        raise ValueError("k neighbours need as many rows of warm-up")
    steps = [_TRANSFORMS[name](**p) for name, p in params.get("steps", [])]
    model = _named(kind)[0](**own)
    return Pipeline(steps, model) if steps else model
