"""Recursions over ordered rows of a key, the same step for batch and stream.

A step is `step(state, row) -> list of output dicts`; `start(key)` makes a fresh state. In batch, keys are dealt to partitions and read in order, so a task holds one
state and one batch of rows, however many rows a key has. In a stream, the state lives in the state store between micro-batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

Step = Callable[[Any, dict], list[dict]]


def _clean(row: dict) -> dict:
    return {k: None if v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in row.items()}


def fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], Any], step: Step, schema: str) -> DataFrame:
    """What step returns for the rows of each key, in order."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                row = _clean(row)
                key = tuple(row[k] for k in keys)
                if state is None or key != last:
                    last, state = key, start(key)
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], Any], step: Step, schema: str, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """The stream form of fold: rows of a micro-batch are taken in order; the pickled state is kept for `ttl_ms` after a key's last row."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        state = pickle.loads(bytes(kept.get[0])) if kept.exists else start(key)
        batch = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [r for row in batch.to_dict("records") for r in step(state, _clean(row))]
        kept.update((pickle.dumps(state),))
        if ttl_ms:
            kept.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "data binary", "append", timeout)
