"""Topics, payloads and texts on scripted cases."""

from __future__ import annotations

from datetime import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import payloads, scalars, topics
from pulsegrid.sources import messages, synthetic

RECEIVED = datetime(2024, 3, 1, 8, 0, 0)


def parsed(spark, cases):
    rows = spark.createDataFrame([(k, topic, payload, RECEIVED) for k, (topic, payload) in enumerate(cases)], "seq long, topic string, payload string, received_at timestamp")
    return payloads.parse_telemetry(rows).orderBy("seq").collect()


def stamped(offset_minutes):
    """Texts of one instant: with a zone, as seconds, and without a zone if it is UTC."""
    from datetime import timedelta, timezone

    at = datetime(2031, 7, 9, 21, 45, 30, tzinfo=timezone.utc)
    local = at.astimezone(timezone(timedelta(minutes=offset_minutes)))
    return at, [f'"{local.isoformat()}"', str(int(at.timestamp())), f'"{int(at.timestamp())}"', f'"{at.replace(tzinfo=None).isoformat()}"', f'"{at.replace(tzinfo=None).isoformat()}Z"']


@pytest.mark.parametrize("offset", [0, 330, -570, 845])
def test_timestamps(spark, offset):
    topic = "device/evCharger/unit7/temp"
    at, good = stamped(offset)
    bad = ['"yesterday"', '"2031-13-01T00:00:00"', '"2031-07-09T21:45:30+24:30"', "null", "false", '"3e77"', '"21:45"', '" "', "[1]", '{"a": 1}']
    got = parsed(spark, [(topic, f'{{"value": 5, "timestamp": {s}}}') for s in [*good, *bad]] + [(topic, '{"value": 6}')])
    assert {str(r.timestamp) for r in got[: len(good)]} == {str(at.replace(tzinfo=None))}
    assert {r.parse_error for r in got[len(good) : -1]} == {"Invalid timestamp format"}
    assert got[-1].timestamp == RECEIVED and got[-1].parse_error is None


def test_values(spark):
    """What Python reads as a finite float is a value; names of infinities, booleans and nested things are none."""
    topic = "device/evCharger/unit7/temp/inner"
    texts = ["12", "-0.5", "7e2", ".25", "4.", " 8 ", "1_0", "+3", "six", "nan", "-inf", "0x10", "2f", "1__0", "", "--1", "1e999"]

    def read(text):
        try:
            return float(text) if abs(float(text)) < float("inf") else None
        except ValueError:
            return None

    got = parsed(spark, [(topic, f'{{"value": "{text}"}}') for text in texts])
    assert [r.value for r in got] == [read(text) for text in texts] and got[0].type == "temp/inner"
    assert [r.parse_error for r in got] == [None if read(text) is not None else "Invalid telemetry value" for text in texts]
    plain = parsed(spark, [(topic, f'{{"value": {v}}}') for v in ("41", "4.5e1", "null", "false", '{"x": 1}', "[2]")])
    assert [r.value for r in plain] == [41.0, 45.0, None, None, None, None]
    odd = parsed(spark, [("device/evCharger/unit7", '{"value": 1}'), (topic, "{broken"), (None, None)])
    assert [r.parse_error for r in odd] == ["Unsupported topic", "Invalid telemetry value", "Unsupported topic"]


def test_detector_profile(spark):
    body = '{"a": true, "b": "2.5", "c": "x", "Timestamp": 3, "d": 1e12, "e": null, "value": 7}'
    rows = spark.createDataFrame([(body,), ("[1]",), ("{" + ",".join(f'"k{i}": {i}' for i in range(101)) + "}",)], "p string")
    got = [r.f for r in rows.select(payloads.features(F.col("p")).alias("f")).collect()]
    assert got == [{"a": 1.0, "b": 2.5, "value": 7.0}, None, None]
    times = spark.createDataFrame([('{"timestamp": null}',), ('{"timestamp": 1704110400}',), ("{}",)], "p string").select(payloads.sample_time(F.col("p"), F.lit(RECEIVED)).alias("t")).collect()
    assert [str(r.t) for r in times] == [str(RECEIVED), "2024-01-01 12:00:00", str(RECEIVED)]


def test_topics(spark):
    rows = spark.createDataFrame([("device/evCharger/A/L1/phase",), ("device/evCharger/A/",), ("device/evCharger/A/x//y",), ("device/evCharger/+/x",), ("device/evCharger/A/#",), ("other/A/x",)], "t string")
    got = [r[0] for r in rows.select(topics.parse_topic(F.col("t"))).collect()]
    assert got[0] == ("A", "L1/phase") and got[1:] == [None] * 5
    with pytest.raises(ValueError, match="groups"):
        topics.parse_topic(F.col("t"), "^x/(?P<charger_id>.+)$")
    assert topics.required_sensors(["device/evCharger/A/L1/p", "device/evCharger/A/L2/p"]) == ["L1/p", "L2/p"]
    with pytest.raises(ValueError, match="same sensor key"):
        topics.required_sensors(["device/evCharger/A/L1/p", "device/evCharger/A/L2/p"], "leaf")
    assert topics.required_sensors(["device/evCharger/A/#", "device/evCharger/A/x"], lenient=True) == ["x"]


def generated_filters():
    """All filters of up to three levels over two names."""
    levels = ["m", "n", "+"]
    return ["/".join(x) for n in (1, 2, 3) for x in product(levels, repeat=n)] + ["#"] + ["/".join((*x, "#")) for n in (1, 2) for x in product(levels, repeat=n)]


def test_overlaps(spark):
    """Two filters overlap if some topic of up to four levels matches both, by a matcher of its own."""

    def matches(pattern, topic):
        want, have = pattern.split("/"), topic.split("/")
        if want[-1] == "#":
            want = want[:-1]
            have = have[: len(want)] if len(have) >= len(want) else [None]
        return len(want) == len(have) and all(w in ("+", h) for w, h in zip(want, have))

    topics_ = ["/".join(x) for n in (1, 2, 3, 4) for x in product("mn", repeat=n)]
    filters = generated_filters()
    seen = {f: {topic for topic in topics_ if matches(f, topic)} for f in filters}
    pairs = [(a, b) for a in filters for b in filters]
    want = [bool(seen[a] & seen[b]) for a, b in pairs]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
    assert [r[0] for r in rows.orderBy("k").select(topics.filters_overlap(F.col("a"), F.col("b"))).collect()] == want
    assert [topics.overlap(a, b) for a, b in pairs] == want
    from pulsegrid.operators.matching import overlapping

    one = spark.createDataFrame([(f,) for f in filters], "a string")
    assert sorted((r.a, r.b) for r in overlapping(one, one.withColumnRenamed("a", "b"), "a", "b").collect()) == sorted(p for p, x in zip(pairs, want) if x)


@pytest.mark.parametrize("pattern", ["", "a//b", "a/#/b", "a+/b", "#", "a\0b", "a/b#"])
def test_bad_filters(pattern):
    with pytest.raises(ValueError, match="filter|level|alone"):
        topics.validate_filter(pattern)


DEVICE = {
    " device/evCharger/A/# ": True, "device/#": True, "device/evCharger/+/x": True, "device/evCharger/+/#": True, "device/evCharger/A/x/y": True, "device/other/A/x": False, "device/evCharger/A": False, "device/evCharger/#": False,
    "device/+": False, "#": False, "device/evCharger//x": False, "device/evCharger/A/#/x": False, "": False,
}


def test_device_filters(spark):
    for pattern, sound in DEVICE.items():
        if sound:
            assert topics.validate_device_filter(pattern) == pattern.strip()
        else:
            with pytest.raises(ValueError, match="filter|level|alone"):
                topics.validate_device_filter(pattern)
    rows = spark.createDataFrame([(p,) for p in [*DEVICE, None]], "p string")
    assert [r[0] for r in rows.select(topics.device_filter(F.col("p"))).collect()] == [*DEVICE.values(), False]
    assert topics.validate_charger_filter("device/evCharger/A/#") == "device/evCharger/A/#"
    for bad in ("device/evCharger/+/x", "device/#"):
        with pytest.raises(ValueError, match="one charger"):
            topics.validate_charger_filter(bad)
    with pytest.raises(ValueError, match="wildcards"):
        topics.validate_charger_filter("device/evCharger/A/+", concrete=True)


#: Payloads and their fields, as a strict reader that keeps the last of repeated names takes them; None where it refuses the text.
STRICT = {
    '{"value":1} trailing': None, "{'value':1}": None, '{"value":1,"value":2}': {"value": 2.0}, '{"value":1}}': None, '{"value":1}{"value":2}': None, '{"value":1,}': None, "{value:1}": None, '{"value":01}': None, '{"value":1}, "q":0}': None,
    ' {"value": 3} ': {"value": 3.0}, '{"value":1 /*c*/}': None, '{"a":1,"value":4,"a":2,"value":5}': {"a": 2.0, "value": 5.0}, '{"value": "6"}': {"value": 6.0}, "{broken": None, "": None,
}


def test_strict_payloads(spark):
    topic = "device/evCharger/unit7/temp"
    got = parsed(spark, [(topic, p) for p in STRICT])
    assert [r.value for r in got] == [f and f.get("value") for f in STRICT.values()]
    assert {r.parse_error for r in got if r.value is None} == {"Invalid telemetry value"}
    rows = spark.createDataFrame([(p,) for p in STRICT], "p string").select(payloads.features(F.col("p")).alias("f"), payloads.decode(F.col("p")).alias("d")).collect()
    assert [r.f for r in rows] == list(STRICT.values())
    assert [r.d.startswith('{"raw":') for r in rows] == [f is None for f in STRICT.values()]
    others = spark.createDataFrame([("[1, 2]",), ("5",), ("null",), ('"x"',), ("tru",)], "p string").select(payloads.decode(F.col("p"))).collect()
    assert [r[0][:7] for r in others] == ["[1, 2]", "5", "null", '"x"', '{"raw":']


def test_matching(spark):
    rows = spark.createDataFrame([("a/b",), ("a",), ("a/b/c",), ("ab",)], "t string")
    match = lambda p: [r[0] for r in rows.select(topics.topic_matches(F.col("t"), p)).collect()]
    assert match("a/#") == [True, True, True, False] and match("a/+") == [True, False, False, False] and match("#") == [True] * 4


def test_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.redact(F.lit("mail anna.b@mail.example.org at 10.0.0.7"))) == "mail a***b@m***e.org at 10.0.0.x"
    assert len(one(scalars.redact(F.lit("x" * 200)))) == 120
    assert one(scalars.display_name(F.lit("cpuTemp"))) == "Cpu Temp" and one(scalars.clean_string(F.lit("a%2Fb"))) == "ab" and one(scalars.clean_string(F.lit(""))) is None
    assert one(scalars.category(F.lit("x/CPU"))) == "cpu" and one(scalars.category(F.lit("none"))) == "other"
    assert one(scalars.compact_number(F.lit(0.0))) == "0"
    shown = {0.01234: "0.01234", 0.5: "0.5", 1.0: "1", 12.3456: "12.35", 98765.4: "98765", 100000.0: "100000", 1235.0: "1235", -2.25: "-2.25", 0.00045: "4.50e-4", 2500000.0: "2.50e+6", float("inf"): "Infinity"}
    rows = spark.createDataFrame([(v,) for v in shown], "v double")
    assert [r[0] for r in rows.select(scalars.compact_number(F.col("v"))).collect()] == list(shown.values())


def test_sources(spark, tmp_path):
    rows = synthetic.batch(spark, 20, chargers=2, seed=1)
    assert rows.count() == 120 and rows.select("seq").distinct().count() == 120
    rows.write.json(str(tmp_path / "m"))
    back = messages.files(spark, str(tmp_path / "m"), ["device/evCharger/charger-1/+"])
    assert back.count() == 60
    named = messages.renamed(back, {"device/evCharger/charger-1/sine": "elsewhere"})
    assert named.where("topic = 'elsewhere'").count() == 20
