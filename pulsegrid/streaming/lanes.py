"""Detection lanes over aligned vectors: a static conformal lane and an adaptive score-then-learn lane.

In batch, lanes whose state after a row follows from the first rows of a key and from a bounded number of rows before it are scans, so that many tasks read a key's rows: the static lane, whose model is
fitted once, and half-space trees, whose masses are those of the window before. Other models step through the rows of a key in one task, as streams do.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import scan, sequential
from pulsegrid.shared import cut
from pulsegrid.streaming import models
from pulsegrid.streaming.ordered import fold, fold_stream

RESULT = "service_id string, seq long, phase string, strategy string, model_type string, p_value double, anomaly_score double, threshold double, is_anomaly boolean, statistic_value double, alarm_count long, tested_count long"


def _result(row: dict, phase: str, strategy: str, model: str, **more: Any) -> dict:
    return {"service_id": row["service_id"], "seq": row["seq"], "phase": phase, "strategy": strategy, "model_type": model, "p_value": None, "anomaly_score": None, "threshold": None, "is_anomaly": False, "statistic_value": None, "alarm_count": 0, "tested_count": 0} | more


@dataclass
class Static:
    keys: list[str] | None = None
    train: list = field(default_factory=list)
    calibration: list = field(default_factory=list)
    model: Any = None
    scores: Any = None
    tested: int = 0
    alarms: int = 0
    active: bool = False
    weights: float = -np.inf
    log_m: float = 0.0
    failed: bool = False


def static_step(model_type: str, train: int, calibrate: int, epsilon: float, threshold: float, seed: int, state: Static, row: dict) -> list[dict]:
    """Collect, calibrate, fit, then test each vector: a split-conformal p-value, a power bet, the restarted martingale, and an alarm where it rises to the threshold."""
    done = partial(_result, row, strategy="static_baseline", model=model_type)
    features = dict(row["features"])
    if state.failed:
        return [done("failed")]
    if state.keys is None:
        state.keys = sorted(features)
    if sorted(features) != state.keys:
        return [done("schema_mismatch")]
    x = np.array([features[k] for k in state.keys], float)
    if len(state.train) < train:
        state.train.append(x)
        return [done("collecting" if len(state.train) < train else "calibrating")]
    if len(state.calibration) < calibrate:
        state.calibration.append(x)
        if len(state.calibration) < calibrate:
            return [done("calibrating")]
        try:
            state.model = models.fitted(model_type, np.array(state.train), seed)
            state.scores = np.sort(state.model.score(np.array(state.calibration)))
        except (ValueError, np.linalg.LinAlgError):
            state.failed = True
            return [done("failed")]
        return [done("training_started")]
    score = float(state.model.score(x[None])[0])
    p = (len(state.scores) - np.searchsorted(state.scores, score, "left") + 1) / (len(state.scores) + 1)
    state.tested += 1
    n = state.tested
    state.weights = np.logaddexp(state.weights, -state.log_m - np.log(n * (n + 1.0)))
    state.log_m += np.log(epsilon) + (epsilon - 1) * np.log(p)
    value = float(np.exp(np.logaddexp(state.log_m + state.weights, -np.log(n + 1.0))))
    crossed = value >= threshold
    fired = crossed and not state.active
    state.active, state.alarms = crossed, state.alarms + fired
    return [done("ready", p_value=float(p), anomaly_score=score, threshold=threshold, is_anomaly=bool(fired), statistic_value=value, alarm_count=state.alarms, tested_count=n)]


@dataclass
class Adaptive:
    model: Any
    keys: list[str] | None = None
    seen: int = 0
    scores: list = field(default_factory=list)
    threshold: float | None = None
    alarms: int = 0
    failed: bool = False


def adaptive_step(model_type: str, warm_up: int, calibrate: int, q: float, state: Adaptive, row: dict) -> list[dict]:
    """Learn; then score and learn, gathering scores; then score, compare (strictly above the frozen quantile), learn. A score never sees its own vector.
    Another set of features ends the lane for good."""
    done = partial(_result, row, strategy="adaptive_stream", model=model_type)
    features = dict(row["features"])
    if state.keys is None:
        state.keys = sorted(features)
    if state.failed or sorted(features) != state.keys:
        state.failed = True
        return [done("failed")]
    x = np.array([features[k] for k in state.keys], float)
    state.seen += 1
    if state.seen <= warm_up:
        state.model.learn_one(x)
        return [done("warmup")]
    score = float(state.model.score_one(x))
    state.model.learn_one(x)
    if not np.isfinite(score):
        state.failed = True
        return [done("failed")]
    if state.threshold is None:
        state.scores.append(score)
        if len(state.scores) == calibrate:
            ranked = np.sort(state.scores)
            state.threshold = float(ranked[int(np.ceil(q * (calibrate - 1)))])
            state.scores = []
        return [done("calibrating", anomaly_score=score)]
    alarm = score > state.threshold
    state.alarms += alarm
    return [done("operational", anomaly_score=score, threshold=state.threshold, is_anomaly=bool(alarm), alarm_count=state.alarms, tested_count=state.seen - warm_up - calibrate)]


class Schema(scan.Fold):
    """_same: whether a row's features have the names of those of its key's first row; _broken: whether a row up to this one has others. A state holds the first names and the latter."""

    inputs, outputs, fresh, neutral = ["_names"], "_same boolean, _broken boolean", None, None

    def run(self, state, n, columns):
        names = columns["_names"]
        if names.null_count:
            raise ValueError("a vector without features")
        first, broken = state or (names[0].as_py(), False)
        same = pc.equal(names, first).to_numpy(zero_copy_only=False)
        lost = np.logical_or.accumulate(np.append(broken, ~same))[1:]
        return [pa.array(same), pa.array(lost)], (first, bool(lost[-1]))

    def join(self, state, summary):
        if state is None or summary is None:
            return summary if state is None else state
        return state[0], state[1] or summary[1] or state[0] != summary[0]


class Beginning(scan.Fold):
    """A fold that knows the first `need` vectors of a key and its last `back` ones. A state is (vectors so far, the first ones, the last ones, what was made of the first ones); only rows with _same count."""

    inputs = ["_x", "_same"]
    fresh = neutral = (0, None, None, None)

    def __init__(self, need: int, back: int):
        self.need, self.back = need, back

    def vectors(self, columns: scan.Arrays) -> np.ndarray:
        own = columns["_x"].filter(columns["_same"])
        return scan.numbers(own.flatten()).reshape(len(own), -1) if len(own) else np.zeros((0, 0))

    def after(self, state: tuple, count: int, first: np.ndarray | None, last: np.ndarray | None) -> tuple:
        """The state with `count` more vectors, which begin and end with these."""
        if not count:
            return state
        seen, head, tail, made = state
        if seen < self.need:
            head = (first if head is None else np.concatenate((head, first)))[: self.need].copy()
        tail = (last if tail is None else np.concatenate((tail, last)))[-self.back :].copy() if self.back else None
        return seen + count, head, tail, made

    def summarise(self, summary, n, columns):
        x = self.vectors(columns)
        return self.after(summary, len(x), x, x)

    def join(self, state, summary):
        return self.after(state, *summary[:3])


class Fixed(Beginning):
    """The static lane up to its p-values: `_count` vectors so far, the model's score, the p-value and the bet's growth behind the calibration, and whether the model couldn't be fitted (_lost)."""

    outputs = "_count long, anomaly_score double, p_value double, _log_e double, _lost boolean"

    def __init__(self, model_type: str, train: int, calibrate: int, epsilon: float, seed: int):
        super().__init__(train + calibrate, 0)
        self.model_type, self.train, self.epsilon, self.seed = model_type, train, epsilon, seed

    def _scores(self, model: Any, x: np.ndarray) -> np.ndarray:
        size = max(1, (1 << 20) // (self.train * x.shape[1]))
        return np.concatenate([model.score(x[k : k + size]) for k in range(0, len(x), size)])

    def _fitted(self, head: np.ndarray) -> tuple:
        """The model and its sorted calibration scores; none if it can't be fitted."""
        try:
            model = models.fitted(self.model_type, head[: self.train], self.seed)
            return model, np.sort(model.score(head[self.train :]))
        except (ValueError, np.linalg.LinAlgError):
            return None, None

    def run(self, state, n, columns):
        same, x = columns["_same"].to_numpy(zero_copy_only=False), self.vectors(columns)
        before = state[0]
        state = self.after(state, len(x), x, x)
        counts = before + np.cumsum(same)
        score, p = np.full(len(n), np.nan), np.full(len(n), np.nan)
        made, ready = state[3], same & (counts > self.need)
        if made is None and state[0] >= self.need:
            made = self._fitted(state[1])
        if made and made[0] is not None and ready.any():
            model, ranked = made
            score[ready] = self._scores(model, x[max(0, self.need - before) :])
            p[ready] = (len(ranked) - np.searchsorted(ranked, score[ready], "left") + 1) / (len(ranked) + 1)
        lost = (counts >= self.need) & (made is not None and made[0] is None)
        none = ~ready | lost
        log_e = np.log(self.epsilon) + (self.epsilon - 1) * np.log(p)
        return [pa.array(counts), *(pa.array(c, mask=none) for c in (score, p, log_e)), pa.array(lost)], (*state[:3], made)


class HalfSpaces(Beginning):
    """The adaptive lane of half-space trees up to its alarms: `_count` vectors so far, the score behind the warm-up, and the threshold behind the calibration.

    Trees are planted on the first window, and the masses that score a window's vectors are counts of the window before, so the first vectors of a key and its last two windows are all that is handed on.
    """

    outputs = "_count long, anomaly_score double, threshold double"

    def __init__(self, warm_up: int, calibrate: int, q: float, params: dict):
        self.params, self.window = params, models.online("half_space_trees", params).window
        super().__init__(warm_up + calibrate, 2 * self.window)
        self.warm_up, self.place = warm_up, int(np.ceil(q * (calibrate - 1)))

    def _planted(self, head: np.ndarray) -> models.HalfSpaceTrees:
        model = models.online("half_space_trees", self.params)
        model.plant(head[: self.window])
        return model

    def _scores(self, model: models.HalfSpaceTrees, tail: np.ndarray | None, x: np.ndarray, before: int) -> np.ndarray:
        """Scores of x, the vectors behind the first `before` ones, of which tail are the last."""
        out, size = [], max(self.window, min(8192, (1 << 21) // model.mass.size * self.window))
        for k in range(0, len(x), size):
            own = x[k : k + size]
            rows = own if tail is None else np.concatenate((tail, own))
            out.append(model.window_scores(rows, before + k + len(own) - len(rows))[len(rows) - len(own) :])
            tail = rows[-self.back :]
        return np.concatenate(out)

    def run(self, state, n, columns):
        x = self.vectors(columns)
        before, _, tail, made = state
        state = self.after(state, len(x), x, x)
        counts = before + np.arange(1, len(x) + 1)
        score, model, limit = np.full(len(x), np.nan), *(made or (None, None))
        if state[0] > self.warm_up:
            model = model or self._planted(state[1])
            score = self._scores(model, tail, x, before)
            if limit is None and state[0] >= self.need:
                limit = float(np.sort(self._scores(model, None, state[1], 0)[self.warm_up :])[self.place])
        limits = np.full(len(x), np.nan if limit is None else limit)
        return [pa.array(counts), pa.array(score, mask=counts <= self.warm_up), pa.array(limits, mask=counts <= self.need)], (*state[:3], (model, limit))


_KEY = ["service_id"]


def _dealt(vectors: DataFrame) -> DataFrame:
    """Parts of vectors, in order, with their numbers by name of feature (_x) and what Schema tells."""
    names = F.sort_array(F.map_keys("features"))
    rows = vectors.select("service_id", "seq", F.to_json(names).alias("_names"), F.transform(names, lambda k: F.element_at("features", k).cast("double")).alias("_x"))
    return scan.scan(scan.ordered(rows, _KEY, ["seq"]), _KEY, Schema()).drop("_names")


def _results(rows: DataFrame, strategy: str, model_type: str) -> DataFrame:
    """rows in the form of RESULT; columns that they lack are as of a vector that isn't tested."""
    plain = {"strategy": F.lit(strategy), "model_type": F.lit(model_type), "is_anomaly": F.lit(False), "alarm_count": F.lit(0), "tested_count": F.lit(0)}
    fields = [f.strip().split(" ") for f in RESULT.split(",")]
    return rows.select(*[(F.col(c) if c in rows.columns else plain.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in fields])


def _static_scan(vectors: DataFrame, model_type: str, train: int, calibrate: int, epsilon: float, threshold: float, seed: int) -> DataFrame:
    scored = scan.scan(_dealt(vectors), _KEY, Fixed(model_type, train, calibrate, epsilon, seed)).drop("_x", "_broken")
    count = F.col("_count")
    phase = F.when(F.col("_lost"), "failed").when(~F.col("_same"), "schema_mismatch").when(count < train, "collecting").when(count < train + calibrate, "calibrating").when(count == train + calibrate, "training_started").otherwise("ready")
    scored = cut(scored.withColumn("phase", phase))
    tested = scan.scan(scored.where("phase = 'ready'"), _KEY, sequential.Statistics()).withColumn("statistic_value", F.exp("log_restarted_martingale"))
    tested = scan.scan(tested.withColumn("crossed", F.col("statistic_value") >= threshold), _KEY, scan.Edges())
    tested = tested.withColumn("threshold", F.lit(float(threshold))).withColumn("tested_count", F.col("n")).withColumn("is_anomaly", F.col("fired"))
    return _results(tested, "static_baseline", model_type).unionByName(_results(scored.where("phase <> 'ready'"), "static_baseline", model_type))


def _half_space_scan(vectors: DataFrame, warm_up: int, calibrate: int, q: float, params: dict) -> DataFrame:
    parts, need, model = _dealt(vectors), warm_up + calibrate, "half_space_trees"
    scored = scan.scan(parts.where("not _broken"), _KEY, HalfSpaces(warm_up, calibrate, q, params)).drop("_x", "_same", "_broken")
    alarm = F.coalesce(F.col("anomaly_score") > F.col("threshold"), F.lit(False))
    phase = F.when(F.col("_count") <= warm_up, "warmup").when(F.col("_count") <= need, "calibrating").otherwise("operational")
    scored = cut(scored.withColumns({"is_anomaly": alarm, "_fired": alarm.cast("long"), "phase": phase, "tested_count": F.greatest(F.col("_count") - need, F.lit(0))}))
    found = scan.scan(scored, _KEY, scan.Running("_fired", "alarm_count"))
    failed = parts.where("_broken").withColumn("phase", F.lit("failed"))
    return _results(found, "adaptive_stream", model).unionByName(_results(failed, "adaptive_stream", model))


def static_lane(vectors: DataFrame, model_type: str = "hbos", train: int = 1200, calibrate: int = 360, epsilon: float = 0.5, threshold: float = 100.0, seed: int = 0, stream: bool = False) -> DataFrame:
    """vectors: service_id, seq, features (map of numbers)."""
    if not stream and train > 0 and calibrate > 0:
        return _static_scan(vectors, model_type, train, calibrate, epsilon, threshold, seed)
    step = partial(static_step, model_type, train, calibrate, epsilon, threshold, seed)
    return (fold_stream if stream else fold)(vectors.select("service_id", "seq", "features"), ["service_id"], ["seq"], lambda _: Static(), step, RESULT)


def adaptive_lane(vectors: DataFrame, model_type: str = "online_isolation_forest", warm_up: int = 1200, calibrate: int = 360, q: float = 0.995, params: dict | None = None, stream: bool = False) -> DataFrame:
    least = models.least_warm_up(model_type, params or {})
    if warm_up < least:
        raise ValueError(f"{model_type} needs a warm-up of {least} or more")
    if not stream and model_type == "half_space_trees" and calibrate > 0 and not (params or {}).get("steps"):
        return _half_space_scan(vectors, warm_up, calibrate, q, params or {})
    step = partial(adaptive_step, model_type, warm_up, calibrate, q)
    return (fold_stream if stream else fold)(vectors.select("service_id", "seq", "features"), ["service_id"], ["seq"], lambda _: Adaptive(models.online(model_type, params or {})), step, RESULT)
