"""Commits that fail at every point, replayed batches, deliveries to failing destinations, and dead letters until they are gone."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import tables as t
from pulsegrid.schemas import TELEMETRY
from pulsegrid.streaming import commits, sinks

MESSAGE = "seq long, topic string, payload string, received_at timestamp"


def messages(spark, first, n):
    rows = spark.range(first, first + n)
    return rows.select(
        F.col("id").alias("seq"), F.concat(F.lit("device/evCharger/c"), (F.col("id") % 3).cast("string"), F.lit("/x")).alias("topic"),
        F.concat(F.lit('{"value": '), F.when(F.col("id") % 10 == 9, F.lit('"no"')).otherwise(F.col("id").cast("string")), F.lit(', "timestamp": '), (1704110400 + F.col("id") % 25).cast("string"), F.lit("}")).alias("payload"),
        F.lit("2024-01-01 13:00:00").cast("timestamp").alias("received_at"),
    )


def stored(store):
    return sorted(store.read("telemetry", TELEMETRY).select("charger_id", "timestamp", "type", "value").collect())


def test_batches_again_change_nothing(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"), 8)
    assert store.read("telemetry", TELEMETRY).count() == 0 and sinks.last_touched(store).count() == 0
    sink = sinks.telemetry_sink(store)
    for name, first in ((0, 0), (0, 0), (1, 20), (0, 0), (2, 0)):
        sink(messages(spark, first, 30), name)
    rows = stored(store)
    keys = [r[:3] for r in rows]
    assert len(keys) == len(set(keys)) and store.names() == {"0", "1", "2"}
    assert {r.value for r in rows if r.value < 30} >= {float(k) for k in range(25) if k % 10 != 9}  # the first of each key stays
    assert store.read("rejects", "topic string, parse_error string").count() == 3 + 3 + 3
    assert sorted(r.charger_id for r in sinks.last_touched(store).collect()) == ["c0", "c1", "c2"]


@pytest.mark.parametrize("point", range(5))
def test_a_failure_anywhere_shows_no_half_batch(spark, tmp_path, monkeypatch, point):
    """The writes of a batch and its commit: each fails once. Readers see the batches before; the batch run again gives what a run without failures gives."""
    whole, hurt = commits.Store(spark, str(tmp_path / "whole"), 4), commits.Store(spark, str(tmp_path / "hurt"), 4)
    for store in (whole, hurt):
        sinks.telemetry_sink(store)(messages(spark, 0, 12), 0)
    before, calls = stored(hurt), iter(range(100))
    write, commit = commits.Batch.write, commits.Batch.commit

    def failing(act):
        def run(self, *args):
            if self.store is hurt and next(calls) == point:
                raise OSError("lost")
            return act(self, *args)

        return run

    monkeypatch.setattr(commits.Batch, "write", failing(write))
    monkeypatch.setattr(commits.Batch, "commit", failing(commit))
    with pytest.raises(OSError, match="lost"):
        sinks.telemetry_sink(hurt)(messages(spark, 10, 30), 1)
    assert stored(hurt) == before and hurt.names() == {"0"} and sinks.last_touched(hurt).count() == 3
    sinks.telemetry_sink(hurt)(messages(spark, 10, 30), 1)
    sinks.telemetry_sink(whole)(messages(spark, 10, 30), 1)
    assert stored(hurt) == stored(whole) != before
    assert hurt.vacuum() == point and hurt.vacuum() == 0 and stored(hurt) == stored(whole)


def test_a_manifest_is_never_replaced(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"))
    first, second = store.begin("a"), store.begin("a")
    for batch in (first, second):
        batch.write("t", spark.range(3))
    first.commit()
    with pytest.raises(Exception, match="exist"):
        second.commit()
    assert store.read("t", "id long").count() == 3 and store.begin("a") is None


def test_known_keys_come_from_their_buckets(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"), 16)
    batch = store.begin(0)
    batch.add("t", spark.range(500).select("id", F.lit(1).alias("x")), ["id"])
    batch.commit()
    new = store.unknown(spark.createDataFrame([(3, 9), (777, 9)], "id long, x int"), "t", ["id"])
    assert [r.id for r in new.collect()] == [777]
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan.replace("\n", " ") or "_bucket" in plan.partition("PartitionFilters")[2][:80]


def test_compaction(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path / "s"), 4)
    sink = sinks.telemetry_sink(store)
    for name in range(3):
        sink(messages(spark, 9 * name, 12), name)
    rows = stored(store)
    store.compact()
    assert stored(store) == rows and len(store.folders("telemetry")) == 1 and {"0", "1", "2"} <= store.names()
    assert store.vacuum() == 4 * 3 and stored(store) == rows
    sink(messages(spark, 0, 12), 1)  # a folded batch again
    sink(messages(spark, 0, 40), 3)
    store.compact()
    again = commits.Store(spark, str(tmp_path / "t"), 4)
    for name, first, n in ((0, 0, 12), (1, 9, 12), (2, 18, 12), (3, 0, 40)):
        sinks.telemetry_sink(again)(messages(spark, first, n), name)
    assert stored(store) == stored(again)


def test_evidence_is_one_commit(spark, tmp_path):
    rows = t.evidence(spark, "/root/testdata/sf0.001").where("sequence_number >= 1").limit(40).cache()
    store = commits.Store(spark, str(tmp_path / "s"), 4)
    sink = sinks.evidence_sink(store)
    counts = lambda: [spark.read.parquet(*[f"{store.root}/{f}" for f in store.folders(n)]).count() for n in ("evidence", "anomalies", "identity")]
    sink(rows, 0)
    first = counts()
    sink(rows, 1)
    sink(rows, 1)
    assert first[0] == 40 and counts() == first


QUICK = sinks.Delivery(attempts=3, delay=0.01, jitter=0.5, timeout=60)


def refusing(bad, got, names=None):
    """A destination that refuses each batch with one of the bad rows."""

    def sink(rows, name):
        own = [r.seq for r in rows.collect()]
        if set(own) & set(bad):
            raise ValueError("bad row")
        got.extend(own)
        if names is not None:
            names.append(name)

    return sink


def test_one_bad_row_of_a_thousand_is_alone(spark, tmp_path):
    log, good, fine, names = commits.Store(spark, str(tmp_path / "log")), [], [], []
    sinks.fan_out({"picky": refusing({421}, good, names), "fine": refusing(set(), fine)}, QUICK, log)(messages(spark, 0, 1000).cache(), 7)
    assert sorted(good) == [k for k in range(1000) if k != 421] and sorted(fine) == list(range(1000)) and len(names) == len(set(names))
    letters = sinks.dead_letters(log, "picky").collect()
    assert len(letters) == 1 and '"seq":421' in letters[0].row and letters[0].error == "bad row" and sinks.dead_letters(log, "fine").count() == 0
    metrics = {r.destination: r for r in sinks.latest_status(log.read("metrics", sinks.METRICS)).collect()}
    assert (metrics["picky"].status, metrics["picky"].ok, metrics["picky"].rows_failed) == ("partial", False, 1) and metrics["fine"].status == "delivered" and metrics["fine"].attempts == 1
    again = []
    assert sinks.replay(log, "picky", refusing({421}, again), MESSAGE, QUICK) == 1 and sinks.dead_letters(log, "picky").count() == 1
    assert sinks.replay(log, "picky", refusing(set(), again), MESSAGE, QUICK) == 0 and again == [421]
    assert sinks.dead_letters(log, "picky").count() == 0 and sinks.replay(log, "picky", refusing(set(), again), MESSAGE, QUICK) == 0


def test_a_destination_that_recovers(spark, tmp_path):
    calls = []

    def flaky(rows, name):
        calls.append(name)
        if len(calls) < 3:
            raise OSError("down")

    log = commits.Store(spark, str(tmp_path / "log"))
    sinks.fan_out({"flaky": flaky}, QUICK, log)(messages(spark, 0, 5), 1)
    assert calls == ["1"] * 3 and sinks.dead_letters(log, "flaky").count() == 0
    assert sinks.latest_status(log.read("metrics", sinks.METRICS)).first().attempts == 3


def test_a_destination_that_is_down(spark, tmp_path):
    """All rows are kept, after a bounded number of calls; without a log the batch fails."""
    calls = []

    def down(rows, name):
        calls.append(name)
        raise OSError("down")

    log, rows = commits.Store(spark, str(tmp_path / "log")), messages(spark, 0, 300).cache()
    sinks.fan_out({"down": down}, sinks.Delivery(attempts=2, delay=0.01, most_bad=4), log)(rows, 1)
    letters = sinks.dead_letters(log, "down")
    assert letters.count() == 300 and letters.select("row").distinct().count() == 300 and len(calls) < 40
    with pytest.raises(RuntimeError, match="down"):
        sinks.fan_out({"down": down}, sinks.Delivery(attempts=1))(rows, 2)
    got = []
    assert sinks.replay(log, "down", refusing(set(), got), MESSAGE, QUICK) == 0 and sorted(got) == list(range(300))


def test_side_by_side_and_out_of_time(spark, tmp_path):
    held, began = threading.Event(), time.monotonic()
    meet = threading.Barrier(2, timeout=20)
    log = commits.Store(spark, str(tmp_path / "log"))
    rules = sinks.Delivery(attempts=1, timeout=3.0)
    sinks.fan_out({"slow": lambda rows, name: held.wait(40), "a": lambda rows, name: meet.wait(), "b": lambda rows, name: meet.wait()}, rules, log)(messages(spark, 0, 4), 1)
    assert time.monotonic() - began < 25
    status = {r.destination: r.status for r in log.read("metrics", sinks.METRICS).collect()}
    assert status == {"slow": "timeout", "a": "delivered", "b": "delivered"} and sinks.dead_letters(log, "slow").count() == 4
    held.set()


def test_pauses():
    rules = sinks.Delivery(attempts=6, delay=1.0, factor=3.0, longest=20.0, jitter=0.1, seed=2)
    pauses = rules.pauses("a")
    assert pauses == rules.pauses("a") != rules.pauses("b") and all(0.9 * p <= x <= 1.1 * p for x, p in zip(pauses, (1, 3, 9, 20, 20), strict=True))


def test_chunks(spark):
    names, got = [], []
    sinks.fan_out({"x": refusing(set(), got, names)}, sinks.Delivery(chunk=30))(messages(spark, 0, 100).cache(), "b")
    assert sorted(got) == list(range(100)) and names == [f"b.2-{k}" for k in range(4)]


def test_stream_into_a_store(spark, tmp_path):
    """A stream through a delivery into a store, and the same files again under another checkpoint: nothing is added."""
    messages(spark, 0, 40).repartition(4).write.json(str(tmp_path / "in"))
    store, log = commits.Store(spark, str(tmp_path / "s"), 4), commits.Store(spark, str(tmp_path / "log"))
    for run in range(2):
        stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        named = lambda rows, name, run=run: sinks.telemetry_sink(store)(rows, f"{run}-{name}")
        sinks.start(stream, sinks.fan_out({"table": named}, QUICK, log if run else None), str(tmp_path / f"cp{run}"), None).start().awaitTermination()
        rows = stored(store)
        if not run:
            first = rows
    keys = [r[:3] for r in rows]
    assert rows == first and len(keys) == len(set(keys)) == len({(k % 3, k % 25) for k in range(40) if k % 10 != 9})
