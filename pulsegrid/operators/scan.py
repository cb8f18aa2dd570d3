"""A parallel scan over the ordered rows of keys: what a row gets depends on all rows of its key before it, and one key's rows are read by many tasks.

Rows are dealt by ranges of (keys, order) into parts, so a key with all rows spans all parts, and a part is one task's. Each part folds the rows of its last key into a summary of fixed size; the
summaries, one a part, are chained on the driver; then each part runs through its rows from the state that the parts before it hand on. Summaries have to be associative: the
state after two runs of rows is that of the first joined with the summary of the second.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.shared import cut

PART = "_part"
Arrays = dict[str, pa.Array]


class Fold:
    """What a scan computes. `run` takes a run of rows of one key: n, their places from 1 on, and the columns in `inputs`."""

    inputs: list[str] = []
    outputs: str = ""
    fresh: Any = None
    neutral: Any = None
    #: whether summaries depend on the rows' places
    placed = False

    def run(self, state: Any, n: np.ndarray, columns: Arrays) -> tuple[list, Any]:
        """The outputs of the rows and the state after them."""
        raise NotImplementedError

    def summarise(self, summary: Any, n: np.ndarray, columns: Arrays) -> Any:
        """The summary with these rows after what it has."""
        return self.run(summary, n, columns)[1]

    def join(self, state: Any, summary: Any) -> Any:
        raise NotImplementedError


class Place(Fold):
    """n: the place of a row in its key."""

    outputs = "n long"
    fresh = neutral = 0

    def run(self, state, n, columns):
        return [pa.array(n)], state + len(n)

    def join(self, state, summary):
        return state + summary


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles, nulls as NaN."""
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def _hashed(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]


def ordered(rows: DataFrame, keys: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """rows with _part, dealt by range of keys and order into so many parts, sorted within parts, and written to the shared folder. Rows with the same place are ordered by a hash of their columns."""
    by = [*map(F.col, keys), *[F.col(o) if isinstance(o, str) else o for o in order], F.xxhash64(*_hashed(rows))]
    return cut(rows.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()))


def _changes(batch: pa.RecordBatch, names: list[str]) -> list[int]:
    """The places, but the first, at which one of the columns differs from the row before."""
    changed = np.zeros(batch.num_rows - 1, bool)
    for name in names:
        column = batch.column(name)
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(before, after), False), pc.xor(pc.is_null(before), pc.is_null(after)))
        changed |= differ.to_numpy(zero_copy_only=False)
    return (np.flatnonzero(changed) + 1).tolist()


def runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int, int, tuple]]:
    """(start, stop, part, key) of the batch's runs of rows of one part and key."""
    if batch.num_rows:
        edges = [0, *_changes(batch, [PART, *keys]), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield i, j, batch.column(PART)[i].as_py(), tuple(batch.column(k)[i].as_py() for k in keys)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The groups of sorted rows with equal values of some columns, each as one batch."""
    held: list[pa.RecordBatch] = []
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in names):
            yield joined()
            held = []
        edges = [0, *_changes(batch, names), batch.num_rows]
        for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            held.append(batch.slice(i, j - i))
            if k + 2 < len(edges):
                yield joined()
                held = []
    if held:
        yield joined()


def _summaries(fold: Fold, keys: list[str], places: dict[int, tuple]):
    """Of each part: its last key, whether it has no other, and the summary of that key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, at = [], None
        for batch in batches:
            own = list(runs(batch, keys))
            for k, (i, j, part, key) in enumerate(own):
                if at is None or at[0] != part:
                    done += [at] if at else []
                    held, before = places.get(part, (None, 0))
                    at = [part, key, True, fold.neutral, before if held == key else 0]
                elif at[1] != key:
                    at = [part, key, False, fold.neutral, 0]
                if k + 1 == len(own) or own[k + 1][2] != part:  # a key that ends inside its part hands nothing on
                    at[3] = fold.summarise(at[3], at[4] + np.arange(1, j - i + 1), {c: batch.column(c).slice(i, j - i) for c in fold.inputs})
                at[4] += j - i
        for part, key, alone, summary, _ in [*done, at] if at else []:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([alone]), pa.array([pickle.dumps((key, summary))], pa.binary())], names=["part", "alone", "held"])

    return run


def _handed_on(parts: DataFrame, keys: list[str], fold: Fold, places: dict[int, tuple]) -> dict[int, tuple]:
    """For each part the key and state that the parts before it end with."""
    out, key, state = {}, None, fold.fresh
    for row in sorted(parts.mapInArrow(_summaries(fold, keys, places), "part int, alone boolean, held binary").collect(), key=lambda r: r.part):
        out[row.part] = (key, state)
        last, summary = pickle.loads(bytes(row.held))
        state, key = fold.join(state if row.alone and last == key else fold.fresh, summary), last
    return out


def _applied(fold: Fold, keys: list[str], kept: list[str], names: list[str], places: dict[int, tuple], states: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            parts = []
            for i, j, part, key in runs(batch, keys):
                if at is None or at[:2] != [part, key]:
                    first = at is None or at[0] != part
                    (n_key, n), (s_key, state) = (places.get(part, (None, 0)), states.get(part, (None, None))) if first else ((None, 0), (None, None))
                    at = [part, key, n if n_key == key else 0, state if s_key == key else fold.fresh]
                made, at[3] = fold.run(at[3], at[2] + np.arange(1, j - i + 1), {c: batch.column(c).slice(i, j - i) for c in fold.inputs})
                at[2] += j - i
                parts.append(made)
            if parts:
                outputs = [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in column]) for column in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *outputs], names=[*kept, *names])

    return run


def scan(parts: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """parts (from `ordered`) with the outputs of the fold, in the same parts and order; a column of the same name is replaced. Null keys are keys. No rows give no rows."""
    made = StructType.fromDDL(fold.outputs)
    places = _handed_on(parts, keys, Place(), {}) if fold.placed or isinstance(fold, Place) else {}
    states = places if isinstance(fold, Place) else _handed_on(parts, keys, fold, places)
    old = [f for f in parts.schema.fields if f.name not in made.names]
    return parts.mapInArrow(_applied(fold, keys, [f.name for f in old], made.names, places, states), StructType([*old, *made.fields]))


def scanned(rows: DataFrame, keys: list[str], order: list[Column | str], fold: Fold) -> DataFrame:
    """rows with the outputs of the fold over the rows of their key, in order."""
    return scan(ordered(rows, keys, order), keys, fold).drop(PART)


class Running(Fold):
    """The sum of the whole numbers of a column up to each row; a null counts as 0."""

    def __init__(self, column: str, output: str):
        self.inputs, self.outputs, self.fresh, self.neutral = [column], f"{output} long", 0, 0

    def run(self, state, n, columns):
        sums = state + np.cumsum(columns[self.inputs[0]].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        return [pa.array(sums)], int(sums[-1])

    def join(self, state, summary):
        return state + summary


class Zone(Fold):
    """zone: how many zones began up to a row, where one begins behind a gap of more than `most` in a column of whole numbers. A state is (the last number, count); a summary (first, last, count behind the first row)."""

    outputs, fresh, neutral = "zone long", (None, 0), (None, None, 0)

    def __init__(self, column: str, most: int):
        self.inputs, self.most = [column], most

    def _numbers(self, columns: Arrays) -> np.ndarray:
        return columns[self.inputs[0]].to_numpy(zero_copy_only=False)

    def _begun(self, last: int | None, at: np.ndarray) -> np.ndarray:
        return np.concatenate(([last is None or at[0] - last > self.most], np.diff(at) > self.most))

    def run(self, state, n, columns):
        at = self._numbers(columns)
        count = state[1] + np.cumsum(self._begun(state[0], at))
        return [pa.array(count)], (int(at[-1]), int(count[-1]))

    def summarise(self, summary, n, columns):
        first, last, count = summary
        at = self._numbers(columns)
        begun = self._begun(last, at)
        if first is None:
            begun[0] = False
        return int(at[0]) if first is None else first, int(at[-1]), count + int(begun.sum())

    def join(self, state, summary):
        first, last, count = summary
        if first is None:
            return state
        return last, state[1] + count + int(state[0] is None or first - state[0] > self.most)


class Edges(Fold):
    """fired: crossed now, but not at the row before; alarm_count: fired so far. A state is (last, count); a summary (first, last, count without the first row)."""

    outputs, fresh, neutral = "fired boolean, alarm_count long", (False, 0), (None, False, 0)

    def __init__(self, column: str = "crossed"):
        self.inputs = [column]

    def _flags(self, columns: Arrays) -> np.ndarray:
        return columns[self.inputs[0]].fill_null(False).to_numpy(zero_copy_only=False)

    def run(self, state, n, columns):
        crossed = self._flags(columns)
        fired = crossed & ~np.concatenate(([state[0]], crossed[:-1]))
        count = state[1] + np.cumsum(fired)
        return [pa.array(fired), pa.array(count)], (bool(crossed[-1]), int(count[-1]))

    def summarise(self, summary, n, columns):
        first, last, count = summary
        crossed = self._flags(columns)
        begun = first is not None
        more = int((crossed[1:] & ~crossed[:-1]).sum()) + int(begun and crossed[0] and not last)
        return (first if begun else bool(crossed[0]), bool(crossed[-1]), count + more)

    def join(self, state, summary):
        first, last, count = summary
        return (last, state[1] + count + int(bool(first) and not state[0]))


class Tail(Fold):
    """A fold over a window: its state are the last `size` values of a column, nulls among them, as doubles (nulls as NaN) and flags of what is no null."""

    def __init__(self, column: str, size: int):
        self.inputs, self.size = [column], size
        self.fresh = self.neutral = (np.zeros(0), np.zeros(0, bool))

    def joined(self, state: tuple, columns: Arrays) -> tuple[np.ndarray, np.ndarray]:
        column = columns[self.inputs[0]]
        return np.concatenate((state[0], numbers(column))), np.concatenate((state[1], column.is_valid().to_numpy(zero_copy_only=False)))

    def last(self, values: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = max(0, len(values) - self.size)
        return values[first:].copy(), there[first:].copy()

    def summarise(self, summary, n, columns):
        return self.last(*self.joined(summary, columns))

    def join(self, state, summary):
        return self.last(*(np.concatenate(x) for x in zip(state, summary, strict=True)))


class MovingAverage(Tail):
    """The mean of the values of the last `size` rows, this one among them; null if none has a value."""

    outputs = "moving_average double"

    def __init__(self, column: str, size: int):
        super().__init__(column, size - 1)

    def run(self, state, n, columns):
        values, there = self.joined(state, columns)
        sums, counts = (np.concatenate(([0], np.cumsum(x))) for x in (np.where(there, values, 0.0), there))
        stops = np.arange(len(state[0]), len(values)) + 1
        starts = np.maximum(stops - self.size - 1, 0)
        count = counts[stops] - counts[starts]
        mean = (sums[stops] - sums[starts]) / np.maximum(count, 1)
        return [pa.array(mean, mask=count == 0)], self.last(values, there)


class Carried(Fold):
    """The last row of those that are marked, at or before each row: its values of some columns; nulls where there is none yet."""

    def __init__(self, mark: str, columns: dict[str, str], schema: StructType):
        """columns: from a column's name to that of the output."""
        self.mark, self.columns = mark, list(columns)
        self.inputs = [mark, *columns]
        self.outputs = ", ".join(f"`{new}` {schema[old].dataType.simpleString()}" for old, new in columns.items())
        self.fresh = self.neutral = None

    def _last(self, state, columns):
        marked = np.flatnonzero(columns[self.mark].fill_null(False).to_numpy(zero_copy_only=False))
        return {c: columns[c].take(pa.array([int(marked[-1])])) for c in self.columns} if len(marked) else state

    def run(self, state, n, columns):
        marked = columns[self.mark].fill_null(False).to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
        if state is None:
            places = pa.array(at, mask=at < 0)
            return [columns[c].take(places) for c in self.columns], self._last(state, columns)
        places = pa.array(at + 1)
        return [pa.concat_arrays([state[c].cast(columns[c].type), columns[c]]).take(places) for c in self.columns], self._last(state, columns)

    def summarise(self, summary, n, columns):
        return self._last(summary, columns)

    def join(self, state, summary):
        return state if summary is None else summary


class BucketLeast(Fold):
    """Of the marked rows at or before each row in the row's bucket the one with the least position: the value of a column there; null where there is none.

    Buckets follow one another in the order of the rows. A state is (bucket, position, value) of the last row's bucket.
    """

    placed = False

    def __init__(self, mark: str, bucket: str, position: str, column: str, output: str, schema: StructType):
        self.names, self.column = (mark, bucket, position), column
        self.inputs = [mark, bucket, position, column]
        self.outputs = f"`{output}` {schema[column].dataType.simpleString()}"
        self.fresh = self.neutral = None

    def run(self, state, n, columns):
        mark, bucket, position = (columns[c] for c in self.names)
        value = columns[self.column]
        marked, buckets = mark.fill_null(False).to_numpy(zero_copy_only=False), bucket.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        places = position.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        if state is not None:
            marked, buckets = np.concatenate(([state[2] is not None], marked)), np.concatenate(([state[0]], buckets))
            places = np.concatenate(([state[1]], places))
            held = value.slice(0, 1) if state[2] is None else state[2].cast(value.type)
            value = pa.concat_arrays([held, value])
        size = len(marked)
        order = np.lexsort((places, ~marked))  # marked rows by position, then the others
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        rank[~marked] = size
        # the running least starts anew in each bucket: later buckets have smaller numbers
        shift = np.cumsum(np.concatenate(([0], buckets[1:] != buckets[:-1]))) * (size + 1)
        least = np.minimum.accumulate(rank - shift) + shift
        none = least >= size
        best = order[np.where(none, 0, least)]
        out = value.take(pa.array(best, mask=none)).slice(size - len(n))
        last = int(best[-1])
        return [out], (int(buckets[-1]), int(places[last]) if not none[-1] else np.iinfo(np.int64).max, None if none[-1] else value.take(pa.array([last])))

    def join(self, state, summary):
        if state is None or summary is None:
            return summary if state is None else state
        if state[0] != summary[0] or state[2] is None:
            return summary
        return state if summary[2] is None or state[1] <= summary[1] else summary


class Together(Fold):
    """Several folds in one pass."""

    def __init__(self, *folds: Fold):
        self.folds = folds
        self.inputs = list(dict.fromkeys(c for f in folds for c in f.inputs))
        self.outputs = ", ".join(f.outputs for f in folds)
        self.fresh, self.neutral = [f.fresh for f in folds], [f.neutral for f in folds]
        self.placed = any(f.placed for f in folds)

    def run(self, state, n, columns):
        made = [f.run(s, n, columns) for f, s in zip(self.folds, state, strict=True)]
        return [x for out, _ in made for x in out], [after for _, after in made]

    def summarise(self, summary, n, columns):
        return [f.summarise(s, n, columns) for f, s in zip(self.folds, summary, strict=True)]

    def join(self, state, summary):
        return [f.join(a, b) for f, a, b in zip(self.folds, state, summary, strict=True)]


class Highest(Fold):
    """The largest number of a column up to each row; nulls are passed over."""

    def __init__(self, column: str, output: str):
        self.inputs, self.outputs, self.fresh, self.neutral = [column], f"{output} double", -np.inf, -np.inf

    def run(self, state, n, columns):
        values = numbers(columns[self.inputs[0]])
        most = np.maximum.accumulate(np.concatenate(([state], np.where(np.isnan(values), -np.inf, values))))[1:]
        return [pa.array(most, mask=np.isneginf(most))], float(most[-1])

    def join(self, state, summary):
        return max(state, summary)
