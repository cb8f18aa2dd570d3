"""Keys, pages and merges: first-wins inserts, last-wins merges, keyset pages, top rows per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the read API: (default, largest).
LIMITS = {"chargers": (100, 1000), "types": (100, 1000), "telemetry": (1000, 10000), "evidence": (2000, 10000), "anomalies": (500, 1000)}


def checked_limit(kind: str, limit: int | None) -> int:
    default, largest = LIMITS[kind]
    limit = default if limit is None else limit
    if not 1 <= limit <= largest:
        raise ValueError(f"a limit of {kind} is from 1 to {largest}")
    return limit


def first_wins(rows: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Of each key the row that arrived first. A map-side aggregate, so copies of a hot key don't meet in one sort."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("_row"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in rows.columns])


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in rows.columns])


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """What an insert with "on conflict do nothing" adds to target."""
    return first_wins(rows, keys, arrival).join(target.select(*keys), list(keys), "left_anti")


def keyset_after(columns: Sequence[str], values: Sequence[object]) -> Column:
    """Rows after a cursor in ascending order of the columns; a null in a column compares as unknown. The first comparison is alone so that it can be pushed to the scan."""
    steps = []
    for k, (name, value) in enumerate(zip(columns, values, strict=True)):
        steps.append(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(columns[:k], values[:k], strict=True)], F.col(name) > F.lit(value)))
    return (F.col(columns[0]) >= F.lit(values[0])) & reduce(lambda a, b: a | b, steps)


def page(rows: DataFrame, cursor: Sequence[str], limit: int) -> dict:
    """An envelope of one page for an API: its items, whether it is full, and the cursor of its last item. rows are ordered and limited by the caller."""
    items = [r.asDict(recursive=True) for r in rows.limit(limit).collect()]
    return {"items": items, "has_more": len(items) == limit, "next_cursor": {c: items[-1][c] for c in cursor} if items else None}


def top_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key. Spark prunes below the shuffle to n rows a key and task."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def merge_series(current: DataFrame, incoming: DataFrame, keys: Sequence[str], per: Sequence[str], order: Sequence[Column], position: str, n: int) -> DataFrame:
    """Rows of both, the incoming (and the later of one side) winning, the first n of each group in `order`."""
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    return top_per_key(last_wins(both, keys, ["_side", position]).drop("_side"), per, order, n)


def merge_rows(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """target updated by rows with the same key; columns that an update has as null stay; new keys are added."""
    both = target.alias("t").join(updates.alias("u"), F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
    return both.select(*[F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")).alias(c) if c in updates.columns else F.col(f"t.{c}").alias(c) for c in target.columns])


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows without those whose key is in gone: deletes by key and cascades."""
    return rows.join(gone.select(*keys), list(keys), "left_anti")
