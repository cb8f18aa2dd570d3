"""Sinks of streams: idempotent tables, delivery to several destinations with retries, dead letters and their replay, metrics.

A sink takes a batch and its name. Sinks that store tables commit all of a batch at once in a `commits.Store`, so a batch that is run again changes nothing. A delivery cuts a batch that a destination refuses into parts named
after it, until the rows that it refuses are alone.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pulsegrid.functions.payloads import accepted, parse_telemetry, rejected
from pulsegrid.operators.evidence import anomaly_rows, identities, valid_evidence
from pulsegrid.operators.relational import first_wins
from pulsegrid.schemas import KEYS
from pulsegrid.streaming.commits import Store

Sink = Callable[[DataFrame, object], None]
LETTERS = "destination string, error string, attempts int, batch string, row string"
METRICS = "destination string, status string, ok boolean, error string, attempts int, rows_failed long, seconds double, batch string, at timestamp"


def telemetry_sink(store: Store, source: str = "mqtt") -> Sink:
    """Parses raw messages, keeps the first of each key inside the batch and against what is stored, and sets rejects aside. Tables: telemetry; rejects; chargers, with a row of
    (charger_id, mqtt_last_message) for each charger of the batch, also of readings that are there already. All of a batch is one commit."""

    def run(messages: DataFrame, name: object) -> None:
        batch = store.begin(name)
        if batch is None:
            return
        parsed = parse_telemetry(messages).persist()
        try:
            rows = accepted(parsed).select("charger_id", "timestamp", "type", "value", F.lit(source).alias("data_source"), F.col("received_at").alias("created"), "seq")
            new = store.unknown(first_wins(rows, KEYS["telemetry"], "seq"), "telemetry", KEYS["telemetry"]).drop("seq").persist()
            try:
                batch.add("telemetry", new, KEYS["telemetry"])
            finally:
                new.unpersist()
            batch.write("chargers", rows.groupBy("charger_id").agg(F.max("created").alias("mqtt_last_message")))
            batch.write("rejects", rejected(parsed).select("topic", "payload", "received_at", "parse_error", "is_error"))
            batch.commit()
        finally:
            parsed.unpersist()

    return run


def last_touched(store: Store) -> DataFrame:
    """(charger_id, mqtt_last_message) of each charger that a telemetry sink has seen, as updates for `relational.merge_rows`."""
    return store.read("chargers", "charger_id string, mqtt_last_message timestamp").groupBy("charger_id").agg(F.max("mqtt_last_message").alias("mqtt_last_message"))


def latest_status(metrics: DataFrame, by: str = "destination", at: str = "at") -> DataFrame:
    """The latest row of appended metrics of each destination or service."""
    return metrics.groupBy(by).agg(F.max_by(F.struct(*[c for c in metrics.columns if c != by]), at).alias("_last")).select(by, "_last.*")


def evidence_sink(store: Store) -> Sink:
    """Valid evidence that isn't stored yet, the anomalies of its alarms and their identities (tables evidence, anomalies, identity), in one commit; a stream that is read again adds nothing."""

    def run(rows: DataFrame, name: object) -> None:
        batch = store.begin(name)
        if batch is None:
            return
        keys = KEYS["monitoring_evidence"]
        valid = store.unknown(first_wins(valid_evidence(rows), keys, "created"), "evidence", keys).persist()
        try:
            found = anomaly_rows(valid)
            batch.add("evidence", valid, keys)
            batch.write("anomalies", found)
            batch.write("identity", identities(found))
            batch.commit()
        finally:
            valid.unpersist()

    return run


@dataclass
class Delivery:
    """How destinations are tried: `attempts` times, after pauses of `delay` seconds that grow by `factor` up to `longest`, each spread by `jitter` of itself either way; `timeout` seconds in all.

    chunk: rows that are delivered at once, about; a batch of more is dealt by hash into parts. most_bad: parts of a batch that may be refused before what is left to try is set aside whole, as when a
    destination is down."""

    attempts: int = 4
    delay: float = 1.0
    factor: float = 2.0
    longest: float = 60.0
    jitter: float = 0.2
    timeout: float | None = 300.0
    chunk: int | None = None
    most_bad: int = 16
    seed: int = 0

    def pauses(self, destination: str) -> list[float]:
        """The pauses between the attempts."""
        rng = np.random.default_rng([self.seed, *destination.encode()])
        plain = [min(self.longest, self.delay * self.factor**k) for k in range(self.attempts - 1)]
        return [float(p * (1 + self.jitter * (2 * rng.random() - 1))) for p in plain]


@dataclass
class Outcome:
    destination: str
    attempts: int = 0
    error: str | None = None
    #: (rows, error, part) that were given up
    refused: list = field(default_factory=list)
    seconds: float = 0.0


def _part(rows: DataFrame, depth: int, lead: int) -> DataFrame:
    """The rows whose hash has these leading bits."""
    names = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    return rows if not depth else rows.where(F.shiftrightunsigned(F.xxhash64(*names), 64 - depth) == lead)


class _Way:
    """The delivery of a batch to one destination."""

    def __init__(self, name: str, sink: Sink, rules: Delivery, stop: threading.Event):
        self.sink, self.rules, self.stop, self.out = sink, rules, stop, Outcome(name)

    def _tried(self, rows: DataFrame, part: str, pauses: list[float]) -> Exception | None:
        error: Exception | None = None
        for pause in [0.0, *pauses]:
            if self.stop.wait(pause) if pause else self.stop.is_set():
                return error or TimeoutError("out of time")
            self.out.attempts += 1
            try:
                self.sink(rows, part)
                return None
            except Exception as found:  # noqa: BLE001
                error = found
        return error

    def run(self, rows: DataFrame, batch: object) -> None:
        began, size = time.monotonic(), rows.count() if self.rules.chunk else 0
        depth = max(0, int(np.ceil(np.log2(size / self.rules.chunk)))) if self.rules.chunk and size > self.rules.chunk else 0
        waiting = [(depth, lead, True) for lead in range(1 << depth)]
        while waiting and not self.stop.is_set():
            depth, lead, whole = waiting.pop(0)
            part = _part(rows, depth, lead)
            name = f"{batch}" if not depth else f"{batch}.{depth}-{lead}"
            error = self._tried(part, name, self.rules.pauses(self.out.destination) if whole else [])
            if error is None:
                continue
            self.out.error = str(error)[:500]
            if self.stop.is_set() or depth >= 40 or part.limit(2).count() < 2 or len(self.out.refused) + sum(not w for *_, w in waiting) >= 2 * self.rules.most_bad:
                self.out.refused.append((part, self.out.error, name))
            else:  # the halves are tried once each: the pauses have been waited for
                waiting[:0] = [(depth + 1, 2 * lead, False), (depth + 1, 2 * lead + 1, False)]
        for depth, lead, _ in waiting:
            self.out.refused.append((_part(rows, depth, lead), "out of time", f"{batch}.{depth}-{lead}" if depth else f"{batch}"))
        self.out.seconds = time.monotonic() - began


def fan_out(sinks: dict[str, Sink], rules: Delivery | None = None, log: Store | None = None) -> Sink:
    """All sinks for each batch, side by side, each with its own attempts. One that fails or takes too long doesn't keep the others from theirs.

    With a `log`, rows that a destination refuses go there as dead letters (JSON, with destination, error and attempts) and so do the metrics of each delivery, in one commit; `replay` sends the letters
    again. Without one the batch fails as a whole, so that Spark runs it again.
    """
    rules = rules or Delivery()

    def run(rows: DataFrame, batch: object) -> None:
        spark, ways = rows.sparkSession, [_Way(name, sink, rules, threading.Event()) for name, sink in sinks.items()]
        group = f"delivery-{batch}-{time.monotonic_ns()}"

        def deliver(way: _Way) -> None:
            spark.sparkContext.setJobGroup(f"{group}-{way.out.destination}", way.out.destination, True)
            way.run(rows, batch)

        pool = ThreadPoolExecutor(max(1, len(ways)))
        tasks = {pool.submit(deliver, way): way for way in ways}
        _, late = wait(tasks, timeout=rules.timeout)
        outcomes = []
        for task, way in tasks.items():
            if task in late:
                way.stop.set()
                spark.sparkContext.cancelJobGroup(f"{group}-{way.out.destination}")
                outcomes.append(("timeout", Outcome(way.out.destination, way.out.attempts, "out of time", [(rows, "out of time", f"{batch}")], rules.timeout)))
            else:
                if task.exception():
                    way.out.error = str(task.exception())[:500]
                    way.out.refused = [(rows, way.out.error, f"{batch}")]
                outcomes.append(("partial" if way.out.refused and any(part != f"{batch}" for *_, part in way.out.refused) else "failed" if way.out.refused else "delivered", way.out))
        pool.shutdown(wait=False)
        failed = [out for _, out in outcomes if out.refused]
        if log is None:
            if failed:
                raise RuntimeError(f"{failed[0].destination}: {failed[0].error}")
            return
        _logged(spark, log, batch, outcomes)

    return run


def _logged(spark: SparkSession, log: Store, batch: object, outcomes: list[tuple[str, Outcome]]) -> None:
    entry = log.begin(f"delivery-{batch}")
    if entry is None:
        return
    shown = []
    for status, out in outcomes:
        n = 0
        for part, error, name in out.refused:
            letters = part.select(F.lit(out.destination).alias("destination"), F.lit(error).alias("error"), F.lit(out.attempts).alias("attempts"), F.lit(name).alias("batch"), F.to_json(F.struct("*")).alias("row"))
            entry.write(f"letters-{out.destination}", letters)
            n += part.count()
        shown.append((out.destination, status, not out.refused, out.error if out.refused else None, out.attempts, n, float(out.seconds or 0.0), str(batch)))
    metrics = spark.createDataFrame(shown, METRICS.rpartition(",")[0]).withColumn("at", F.current_timestamp())
    entry.write("metrics", metrics.coalesce(1))
    entry.commit()


def dead_letters(log: Store, destination: str) -> DataFrame:
    """The letters of a destination that haven't been replayed."""
    return log.read(f"letters-{destination}", LETTERS)


def replay(log: Store, destination: str, sink: Sink, schema: str, rules: Delivery | None = None) -> int:
    """Sends the dead letters of a destination again, as rows of the schema; letters that are taken leave the log, the others stay, in one commit. How many stay."""
    folders = log.folders(f"letters-{destination}")
    if not folders:
        return 0
    letters = log.read(f"letters-{destination}", LETTERS, folders)
    rows = letters.select(F.from_json("row", schema).alias("_row")).select("_row.*")
    name = f"replay-{destination}-{folders[-1].rpartition('/')[2]}-{len(folders)}"
    way = _Way(destination, sink, rules or Delivery(), threading.Event())
    way.run(rows, name)
    entry = log.begin(f"{name}-{time.time_ns()}")
    left = 0
    for part, error, at in way.out.refused:
        left += part.count()
        entry.write(f"letters-{destination}", part.select(F.lit(destination).alias("destination"), F.lit(error).alias("error"), F.lit(way.out.attempts).alias("attempts"), F.lit(at).alias("batch"), F.to_json(F.struct("*")).alias("row")))
    entry.removed = folders
    entry.commit()
    return left


def start(stream: DataFrame, sink: Sink, checkpoint: str, trigger: str | None = "5 seconds") -> DataStreamWriter:
    """A writer that flushes to the sink at each trigger; trigger None takes what there is and ends."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)


def without_repeats(stream: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """First of each key, within the delay, over a stream."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
