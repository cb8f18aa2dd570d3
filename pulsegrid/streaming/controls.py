"""Guards of a message stream: rate limit and circuit breaker."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import chains, scan
from pulsegrid.shared import cut
from pulsegrid.streaming.ordered import fold, fold_stream

LIMITED = "key string, seq long, accepted boolean"
BROKEN = "key string, seq long, open boolean, errors long"


@dataclass
class Accepted:
    times: deque = field(default_factory=deque)


def rate_step(limit: int, window: float, state: Accepted, row: dict) -> list[dict]:
    """Only accepted messages count towards the limit."""
    while state.times and row["at"] - state.times[0] >= window:
        state.times.popleft()
    accepted = len(state.times) < limit
    if accepted:
        state.times.append(row["at"])
    return [{"key": row["key"], "seq": row["seq"], "accepted": accepted}]


@dataclass
class Breaker:
    errors: int = 0
    opened: float | None = None
    clock: float = -math.inf


def breaker_step(share: float, timeout: float, state: Breaker, row: dict) -> list[dict]:
    """Opens once the kept errors, 100 at most, exceed the share of 100; errors are never forgotten, so after the timeout the next error opens it again. A clock that runs back stands still."""
    state.clock = max(state.clock, row["at"])
    if state.opened is not None and state.clock >= state.opened + timeout:
        state.opened = None
    is_open = state.opened is not None
    if not is_open and row["error"]:
        state.errors = min(state.errors + 1, 100)
        if state.errors / 100 > share:
            state.opened = state.clock
    return [{"key": row["key"], "seq": row["seq"], "open": is_open, "errors": state.errors}]


def rate_limit(rows: DataFrame, limit: int = 1000, window: float = 60.0, stream: bool = False) -> DataFrame:
    """rows: key, seq, at (seconds)."""
    return (fold_stream if stream else fold)(rows.select("key", "seq", "at"), ["key"], ["seq"], lambda _: Accepted(), partial(rate_step, limit, window), LIMITED)


def circuit_breaker(rows: DataFrame, share: float = 0.1, timeout: float = 300.0, stream: bool = False) -> DataFrame:
    """rows: key, seq (tells a key's rows apart), at (seconds), error (boolean).

    In batch the openings are a chain: the error that first exceeds the share, then always the first error at or after the timeout's end. They are marked by pointer doubling, and a scan tells each
    row the last opening before it; no key's rows are one task's.
    """
    if timeout <= 0:
        raise ValueError("the timeout is above 0")
    if stream:
        return fold_stream(rows.select("key", "seq", "at", "error"), ["key"], ["seq"], lambda _: Breaker(), partial(breaker_step, share, timeout), BROKEN)
    least = next((k for k in range(1, 101) if k / 100 > share), None)
    plain = rows.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), F.coalesce("error", F.lit(False)).alias("error"))
    parts = scan.ordered(plain.withColumn("_one", F.col("error").cast("long")), ["key"], ["seq"])
    clocked = cut(scan.scan(parts, ["key"], scan.Together(scan.Highest("at", "_clock"), scan.Running("_one", "_nth"))).drop(scan.PART))
    wrong = clocked.where("error")
    links = chains.following(wrong, ["key"], "seq", F.col("_clock"), F.col("_clock") + timeout, beyond=False)
    opened = chains.chained(links, ["key"], wrong.where(F.col("_nth") == F.lit(least)).select("key", F.col("seq").alias("node")))
    opened = opened.select(F.struct("key", F.col("node").alias("seq")).alias("_opened"))
    marked = clocked.join(opened, F.struct("key", "seq") == F.col("_opened"), "left").withColumn("_opens", F.col("_opened").isNotNull()).drop("_opened")
    parts = scan.ordered(marked, ["key"], ["seq"])
    known = scan.scan(parts, ["key"], scan.Carried("_opens", {"_clock": "_since"}, parts.schema))
    known = known.withColumn("open", F.coalesce(~F.col("_opens") & (F.col("_clock") < F.col("_since") + timeout), F.lit(False))).withColumn("_kept", (F.col("error") & ~F.col("open")).cast("long"))
    return scan.scan(known, ["key"], scan.Running("_kept", "_sum")).select("key", "seq", "open", F.least(F.col("_sum"), F.lit(100)).cast("long").alias("errors"))
