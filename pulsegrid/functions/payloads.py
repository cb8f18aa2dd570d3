"""Message payloads: timestamps, values and feature maps, with typed reasons for rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.topics import TOPIC_REGEX, parse_topic, sensor_key

_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?\s*(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)?)?$"
#: Seconds of the years 1 to 9999.
_FIRST, _LAST = -62135596800.0, 253402300799.0
#: Names that are not features, whatever their case.
METADATA = ("timestamp", "charger_id", "telemetry_type", "topic", "device_id", "id", "unit", "quality")
MAX_FEATURES, MAX_NAME, MAX_TEXT, MAX_VALUE = 100, 100, 1000, 1e10


def number(text: Column) -> Column:
    """A text as Python reads a float, without the names of infinities and not-a-number; null if it isn't one or isn't finite."""
    value = F.expr("try_cast(null as double)")
    value = F.when(text.rlike(_NUMBER), F.regexp_replace(F.trim(text), "_", "").try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def instant(text: Column) -> Column:
    """A timestamp from Unix seconds or an ISO text; a text without a zone is UTC; null for anything else."""
    seconds = number(text)
    epoch = F.when((seconds >= _FIRST) & (seconds <= _LAST), F.timestamp_micros(F.round(seconds * 1000000.0).cast("long")))
    return F.when(text.rlike(_NUMBER), epoch).otherwise(F.when(text.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2"))))


#: JSON as its standard has it: no single quotes, comments or bare names.
_STRICT = {"allowSingleQuotes": "false"}


def _whole(payload: Column, kind: str) -> Column:
    """struct(p, q): the payload read as a kind of value, and q, which is the payload's hash if the payload is one JSON value and nothing else. The payload is read inside of an object that
    ends with its hash, since a parser of JSON columns passes over what follows a value."""
    wrapped = F.concat(F.lit('{"p":'), payload, F.lit(',"q":'), F.xxhash64(payload).cast("string"), F.lit("}"))
    return F.from_json(wrapped, f"p {kind}, q long" if kind else "q long", _STRICT)


def fields(payload: Column) -> Column:
    """The payload's JSON object as map<string, variant>, of repeated names the last; null if it is none."""

    def named(whole: Column) -> Column:
        keys = F.map_keys(whole["p"])
        last = F.filter(F.map_entries(whole["p"]), lambda e, k: F.size(keys) - F.array_position(F.reverse(keys), e["key"]) == k)
        plain = F.when(F.size(F.array_distinct(keys)) == F.size(keys), whole["p"]).otherwise(F.map_from_entries(last))
        return F.when(whole["q"] == F.xxhash64(payload), plain)

    return F.get(F.transform(F.array(_whole(payload, "map<string,variant>")), named), F.lit(0))


def _kind(field: Column) -> Column:
    return F.coalesce(F.schema_of_variant(field), F.lit("VOID"))


def _text(field: Column) -> Column:
    return F.when(~_kind(field).isin("VOID", "BOOLEAN") & ~_kind(field).rlike("^(ARRAY|OBJECT)"), F.try_variant_get(field, "$", "string"))


def decode(payload: Column) -> Column:
    """The payload if it is JSON, else {"raw": text}."""
    return F.when(F.coalesce(_whole(payload, "")["q"] == F.xxhash64(payload), F.lit(False)), payload).otherwise(F.to_json(F.struct(payload.alias("raw"))))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, each evaluated once a row: a generator of one row keeps filters and projections above it from taking in their expressions."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_made")
    return rows.select(*[c for c in rows.columns if c not in columns], made).select("*", "_made.*").drop("_made")


def parse_telemetry(messages: DataFrame, regex: str = TOPIC_REGEX) -> DataFrame:
    """messages (topic, payload, received_at, ...) with charger_id, type, timestamp, value, parse_error.

    The ingestion profile: a payload that isn't JSON, whole and strict, has no fields; an absent timestamp is the time of receipt, but a present one has to be valid; booleans and non-finite numbers are no values.
    """
    rows = _once(messages, _topic=parse_topic(F.col("topic"), regex), _whole=_whole(F.col("payload"), "map<string,string>"))
    sound = F.when(F.col("_whole.q") == F.xxhash64("payload"), F.map_entries("_whole.p"))
    rows = _once(rows, _fields=F.filter(sound, lambda e: e["key"].isin("timestamp", "value"))).drop("_whole")
    own = lambda name: F.filter("_fields", lambda e: e["key"] == name)
    # numbers and texts are read alike; booleans, arrays and objects come as texts that are no numbers; of repeated names the last counts
    stamp, value = (F.try_element_at(own(name), F.lit(-1))["value"] for name in ("timestamp", "value"))
    absent = F.coalesce(F.size(own("timestamp")), F.lit(0)) <= 0
    rows = _once(rows, timestamp=F.when(absent, F.col("received_at")).otherwise(instant(stamp)), value=number(value))
    error = F.when(F.col("_topic").isNull(), "Unsupported topic").when(F.col("timestamp").isNull(), "Invalid timestamp format").when(F.col("value").isNull(), "Invalid telemetry value")
    return rows.withColumn("charger_id", F.col("_topic.charger_id")).withColumn("type", F.col("_topic.telemetry_type")).withColumn("parse_error", error).drop("_topic", "_fields")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("parse_error is null").drop("parse_error")


def rejected(parsed: DataFrame) -> DataFrame:
    """Rejects, with is_error false for topics that are merely of another kind."""
    return parsed.where("parse_error is not null").withColumn("is_error", F.col("parse_error") != "Unsupported topic")


def features(payload: Column) -> Column:
    """The detector profile: map<string, double> of a payload's usable numbers, null if it is no object or has too many entries.

    Booleans count as 0 and 1, texts of at most 1000 characters are read as numbers; metadata, long names and values of 1e10 or more are left out.
    """
    own = fields(payload)
    named = F.filter(F.map_entries(own), lambda e: (F.length(e["key"]) <= MAX_NAME) & ~F.lower(e["key"]).isin(*METADATA))
    # kind and text of an entry are taken once, before the rules look at them several times
    plain = F.transform(named, lambda e: F.struct(e["key"].alias("key"), _kind(e["value"]).alias("kind"), F.try_variant_get(e["value"], "$", "string").alias("text")))

    def read(e: Column) -> Column:
        usable = ~e["kind"].rlike("^(VOID|ARRAY|OBJECT)") & (F.length(e["text"]) <= MAX_TEXT)
        return F.when(e["kind"] == "BOOLEAN", (e["text"] == "true").cast("double")).when(usable, number(e["text"]))

    kept = F.filter(F.transform(plain, lambda e: F.struct(e["key"].alias("key"), read(e).alias("value"))), lambda e: F.abs(e["value"]) < MAX_VALUE)
    return F.when(own.isNotNull() & (F.size(own) <= MAX_FEATURES), F.map_from_entries(kept))


def reading(values: Column, key: Column) -> Column:
    """The number of a sensor's message: under its key, under "value", or the first entry."""
    return F.coalesce(F.try_element_at(values, key), F.try_element_at(values, F.lit("value")), F.get(F.map_values(values), F.lit(0)))


def cached_reading(values: Column, key: Column) -> Column:
    """The same for alignment: under its key, under "value", or the only entry; else null."""
    return F.coalesce(F.try_element_at(values, key), F.try_element_at(values, F.lit("value")), F.when(F.size(values) == 1, F.get(F.map_values(values), F.lit(0))))


def sample_time(payload: Column, received_at: Column) -> Column:
    """The detector's event time: a non-null valid timestamp of the payload, else the time of receipt."""
    return F.coalesce(instant(_text(F.try_element_at(fields(payload), F.lit("timestamp")))), received_at)


def parse_for_detection(messages: DataFrame, strategy: str = "full_hierarchy") -> DataFrame:
    """messages with charger_id, sensor, value, event_ts and received_at, for alignment; messages without a usable number are left out."""
    rows = messages.withColumn("_topic", parse_topic(F.col("topic"))).where("_topic is not null")
    rows = rows.withColumn("sensor", sensor_key(F.col("_topic.telemetry_type"), strategy)).withColumn("value", reading(features(F.col("payload")), F.col("sensor")))
    return rows.where("value is not null").select(F.col("_topic.charger_id").alias("charger_id"), "sensor", "value", sample_time(F.col("payload"), F.col("received_at")).alias("event_ts"), "received_at", "seq")
