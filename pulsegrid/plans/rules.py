"""Queries of rules for single rows and small states: decoding, readings, filters, redaction, numbers, pages, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import payloads, scalars, topics
from pulsegrid.operators import charts, claims, fleet, moving, relational, sequential, series
from pulsegrid.operators import evidence as ev
from pulsegrid.plans import tables as t
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import sql
from pulsegrid.sources import messages as sources
from pulsegrid.streaming import sinks


def _number():
    return F.col("event_id").cast("string")


def _events(spark, sf):
    return t.table(spark, sf, "events")


@query("""SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '{"raw":"plain ' || event_id || '"}' ELSE '{"n": ' || event_id || '}' END AS decoded FROM events""")
def payload_decode(spark, sf):
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("plain "), _number())).otherwise(F.concat(F.lit('{"n": '), _number(), F.lit("}")))
    return _events(spark, sf).select(F.col("event_id").alias("seq"), payloads.decode(body).alias("decoded"))


@query("""SELECT event_id AS seq, event_id::DOUBLE AS reading, CASE WHEN event_id % 4 <> 2 THEN event_id::DOUBLE END AS cached FROM events""")
def sensor_readings(spark, sf):
    """Payloads by turns with the sensor's own key, with "value", with two other keys, with one other key."""
    turn = F.col("event_id") % 4
    own = F.concat(F.lit('{"'), "event_type", F.lit('": '), _number(), F.lit(', "value": -1}'))
    body = F.when(turn == 0, own).when(turn == 1, F.concat(F.lit('{"a": 1, "value": '), _number(), F.lit("}"))).when(turn == 2, F.concat(F.lit('{"a": '), _number(), F.lit(', "b": 2}'))).otherwise(F.concat(F.lit('{"b": '), _number(), F.lit("}")))
    rows = _events(spark, sf).select(F.col("event_id").alias("seq"), "event_type", payloads.features(body).alias("f"))
    key, values = F.col("event_type"), F.col("f")
    return rows.select("seq", payloads.reading(values, key).alias("reading"), payloads.cached_reading(values, key).alias("cached"))


@query("""SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) ELSE ts END AS sample_time FROM events""")
def sample_times(spark, sf):
    """Payloads by turns with a time, with null for it, without one, with a text that is none."""
    turn = F.col("event_id") % 4
    stamp = F.concat(F.lit('{"timestamp": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}'))
    body = F.when(turn == 0, stamp).when(turn == 1, '{"timestamp": null}').when(turn == 2, '{"value": 1}').otherwise('{"timestamp": "soon"}')
    return _events(spark, sf).select(F.col("event_id").alias("seq"), payloads.sample_time(body, F.col("ts").cast("timestamp")).cast(t.NTZ).alias("sample_time"))


@query(sql("""SELECT arrival, strftime(CASE WHEN arrival % 2 = 0 THEN created ELSE "timestamp" END, '%Y-%m-%dT%H:%M:%S.%fZ') AS created FROM telemetry""", "telemetry"))
def created_fallback(spark, sf):
    created = F.when(F.col("arrival") % 2 == 0, F.col("created"))
    return t.telemetry(spark, sf).select("arrival", scalars.created_or(created, F.col("timestamp")).alias("created"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS charger_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS telemetry_type FROM events""")
def custom_topic_parse(spark, sf):
    """Topics of another shape, with the type before the charger."""
    topic = F.concat(F.when(F.col("event_id") % 5 == 0, "yard/").otherwise("fleet/"), "event_type", F.lit("/of/"), F.col("user_id").cast("string"))
    parsed = topics.parse_topic(topic, r"^fleet/(?P<telemetry_type>[^/]+)/of/(?P<charger_id>[^/]+)$")
    return _events(spark, sf).select(F.col("event_id").alias("seq"), parsed["charger_id"].alias("charger_id"), parsed["telemetry_type"].alias("telemetry_type"))


#: Filters by the last digit of a key: four well-formed ones, six that break a rule each.
FILTERS = ("a/b", "a/+/c", "a/#", " a/b ", "#", "a//b", "a/#/b", "a/b#", "a/+b", "")


@query("""SELECT c_custkey AS key, c_custkey % 10 < 4 AS sound FROM customer""")
def filter_rules(spark, sf):
    pattern = F.element_at(F.array(*map(F.lit, FILTERS)), (F.col("c_custkey") % 10 + 1).cast("int"))
    return t.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), topics.sound_filter(pattern).alias("sound"))


@query("""SELECT c_custkey AS key, c_custkey % 6 IN (0, 1, 3) AS sound FROM customer""")
def device_filter_rules(spark, sf):
    """Filters by turns: all devices, a wildcard for the charger, one charger without a type, one with a type, another namespace, an empty level."""
    charger = F.col("c_custkey").cast("string")
    forms = [F.lit("device/#"), F.concat(F.lit(" device/evCharger/+/t"), charger), F.concat(F.lit("device/evCharger/"), charger), F.concat(F.lit("device/evCharger/"), charger, F.lit("/#")), F.concat(F.lit("device/other/"), charger, F.lit("/x")), F.concat(F.lit("device/evCharger//"), charger)]
    pattern = F.element_at(F.array(*forms), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), topics.device_filter(pattern).alias("sound"))


@query("""SELECT event_id AS seq, event_type || ',x' AS names FROM events""")
def trimmed_names(spark, sf):
    values = F.array(F.concat(F.lit(" "), "event_type"), F.lit(" "), F.lit("x"), F.col("event_type"), F.lit(" x "))
    return _events(spark, sf).select(F.col("event_id").alias("seq"), F.array_join(topics.distinct_trimmed(values), ",").alias("names"))


@query("""SELECT c_custkey AS key, 'from c***' || right(c_custkey::VARCHAR, 1) || '@h***e.org at 10.0.' || (c_custkey % 250) || '.x, 2001:db8:1:' || lower(hex(c_custkey % 250 + 16)) || ':x' AS redacted,
CASE WHEN c_custkey % 50 > 20 THEN repeat('y', 117) || '...' ELSE repeat('y', 100 + c_custkey % 50) END AS cut FROM customer""")
def redacted_texts(spark, sf):
    key = F.col("c_custkey")
    text = F.concat(F.lit("from client"), key.cast("string"), F.lit("@host.example.org at 10.0."), (key % 250).cast("string"), F.lit(".77, 2001:db8:1:"), F.lower(F.hex(key % 250 + 16)), F.lit(":5:6:7:8"))
    return t.table(spark, sf, "customer").select(key.alias("key"), scalars.redact(text).alias("redacted"), scalars.redact(F.repeat(F.lit("y"), (100 + key % 50).cast("int"))).alias("cut"))


#: The text of k / 10 ** j from the digits of k: four significant ones, so nothing is rounded; below 0.001 and from a million on k ends in 0.
_DIGITS = """WITH k AS (SELECT event_id AS seq, CASE WHEN event_id % 10 IN (0, 9) THEN (event_id % 900 + 100) * 10 ELSE event_id % 9000 + 1000 END AS k, event_id % 10 - 2 AS j FROM events)
SELECT seq, CASE WHEN j = 7 THEN substr(k::VARCHAR, 1, 1) || '.' || substr(k::VARCHAR, 2, 2) || 'e-4' WHEN j <= 0 THEN k::VARCHAR || repeat('0', (-j)::INTEGER)
ELSE rtrim(rtrim((k // pow(10, j)::BIGINT) || '.' || lpad((k % pow(10, j)::BIGINT)::VARCHAR, j::INTEGER, '0'), '0'), '.') END AS shown FROM k"""


@query(_DIGITS)
def compact_numbers(spark, sf):
    n, j = F.col("event_id"), F.col("event_id") % 10 - 2
    k = F.when((n % 10).isin(0, 9), (n % 900 + 100) * 10).otherwise(n % 9000 + 1000).cast("double")
    value = F.when(j >= 0, k / F.pow(F.lit(10.0), j)).otherwise(k * F.pow(F.lit(10.0), -j))
    return _events(spark, sf).select(n.alias("seq"), scalars.compact_number(value).alias("shown"))


@query(sql("""SELECT arrival, len(kept) AS n_kept, len(list_filter(kept, lambda i: i % 2 = 0)) AS n_infinite, 't' || kept[1] AS first_id FROM (SELECT arrival, list_filter(range(least(arrival % 20 + 1, 16)), lambda i: i % 5 <> 1 AND i % 7 <> 3) AS kept FROM dense)""", "dense"))
def tracker_normal_forms(spark, sf):
    """1 to 20 trackers a row: some without a name, some without a finite threshold, every second with an infinite value."""
    size = (F.col("arrival") % 20).cast("int")
    infinite = F.lit(float("inf"))

    def tracker(i):
        named, value = F.when(i % 5 == 1, "").otherwise(F.concat(F.lit("t"), i.cast("string"))), F.when(i % 2 == 0, infinite).otherwise(i.cast("double"))
        return F.struct(named.alias("tracker_id"), F.lit("cusum").alias("alarm_statistic"), value.alias("statistic_value"), F.when(i % 7 == 3, infinite).otherwise(10.0).alias("threshold"))

    rows = t.telemetry(spark, sf, dense=True).select("arrival", ev.normal_trackers(F.transform(F.sequence(F.lit(0), size), tracker)).alias("n"))
    return rows.select("arrival", F.size("n").cast("long").alias("n_kept"), F.size(F.filter("n", lambda x: x["statistic_is_infinite"])).cast("long").alias("n_infinite"), F.get("n", F.lit(0))["tracker_id"].alias("first_id"))


@query(sql("""SELECT arrival, least(greatest(value / 200.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS p FROM dense""", "dense"))
def checked_p_values(spark, sf):
    p = F.least(F.greatest(F.col("value") / 200.0, F.lit(0.0)), F.lit(1.0))
    return t.telemetry(spark, sf, dense=True).select("arrival", sequential.checked_p(p).alias("p"))


@query(sql("""SELECT count(*) AS n_items, count(*) = 50 AS has_more, arg_max(created, n) AS cursor_created, arg_max("timestamp", n) AS cursor_timestamp FROM (SELECT *, row_number() OVER (ORDER BY created, "timestamp", arrival) AS n FROM telemetry WHERE charger_id = '3') WHERE n <= 50""", "telemetry"))
def page_envelope(spark, sf):
    rows = t.telemetry(spark, sf).where("charger_id = '3'").orderBy("created", "timestamp", "arrival")
    page = relational.page(rows, ["created", "timestamp"], 50)
    at = page["next_cursor"] or {"created": None, "timestamp": None}
    return spark.createDataFrame([(len(page["items"]), page["has_more"], at["created"], at["timestamp"])], f"n_items long, has_more boolean, cursor_created {t.NTZ}, cursor_timestamp {t.NTZ}")


@query(sql("""SELECT service_id, "timestamp", sequence_number, charger_id, array_to_string(sensor_set, ',') AS sensors, strategy, anomaly_score, threshold, alarm, created FROM evidence""", "evidence"))
def compact_evidence(spark, sf):
    rows = charts.compact(t.evidence(spark, sf))
    return rows.select("service_id", "timestamp", "sequence_number", "charger_id", F.array_join("sensor_set", ",").alias("sensors"), "strategy", "anomaly_score", "threshold", "alarm", "created")


_STAGES = ("stopped", "error", "operational", "collecting")


@query(sql("SELECT id FROM services WHERE number % 4 < 2 AND created_at < TIMESTAMP '2024-01-01 00:30:00'", "services"))
def expired_services(spark, sf):
    stage = F.element_at(F.array(*map(F.lit, _STAGES)), (F.col("number") % 4 + 1).cast("int"))
    rows = t.services(spark, sf).withColumn("operational_stage", stage).withColumn("operational_updated_at", F.col("created_at"))
    return fleet.expired(rows, F.lit("2024-01-02 00:30:00").cast(t.NTZ)).select("id")


@query(sql("SELECT count(*) FILTER (WHERE number % 3 = 0) AS running, count(*) FILTER (WHERE number % 3 = 1) AS missing, count(*) FILTER (WHERE number % 2 = 0) AS static FROM services", "services"))
def service_counts(spark, sf):
    number = F.col("number")
    rows = t.services(spark, sf).select(F.when(number % 3 == 0, "Running").when(number % 3 == 1, "NOT_FOUND").otherwise("exited").alias("workload"), F.when(number % 2 == 0, "static_baseline").otherwise("adaptive_stream").alias("strategy"))
    return fleet.service_counts(rows)


@query("""SELECT event_id AS seq, CASE WHEN user_id = 3 AND event_type = 'click' AND event_id % 11 <> 0 THEN 'site/a/click' ELSE 'device/evCharger/' || user_id || CASE WHEN event_id % 11 = 0 THEN '//' ELSE '/' END || event_type END AS topic FROM events""")
def renamed_topics(spark, sf):
    return sources.renamed(t.messages(spark, sf), {"device/evCharger/3/click": "site/a/click", "device/evCharger/none/click": "site/b/click"}).select("seq", "topic")


@query("""SELECT event_id AS seq FROM events WHERE user_id = 3 OR (event_type = 'click' AND event_id % 11 <> 0)""")
def subscribed_messages(spark, sf):
    return sources.subscribed(t.messages(spark, sf), ["device/evCharger/3/#", "device/evCharger/+/click"]).select("seq")


@query("""SELECT event_type AS destination, arg_max(user_id, event_id) AS queue, max(event_id) AS at FROM events GROUP BY 1""")
def latest_status(spark, sf):
    rows = _events(spark, sf).select(F.col("event_type").alias("destination"), F.col("user_id").alias("queue"), F.col("event_id").alias("at"))
    return sinks.latest_status(rows)


@query(sql(""", z AS (SELECT charger_id, "timestamp", sum(new) OVER (PARTITION BY charger_id ORDER BY "timestamp" RANGE UNBOUNDED PRECEDING) AS zone FROM (SELECT *, CASE WHEN epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY charger_id ORDER BY "timestamp")) <= 300000000 THEN 0 ELSE 1 END AS new FROM dense_anomalies))
SELECT charger_id, min("timestamp") AS zone_start, max("timestamp") AS zone_end, count(*) AS members FROM z GROUP BY charger_id, zone""", "dense_anomalies"))
def session_zones(spark, sf):
    """Zones as session windows, as a stream makes them."""
    return series.session_zones(t.anomalies(spark, sf, dense=True), ["charger_id"], "timestamp")


_WINDOW = "(PARTITION BY charger_id ORDER BY arrival ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
_NAMES = ("x", "y", "z")
_ENTRIES = ", ".join([f"covar_pop({a}, {b}) OVER {_WINDOW} AS {a}{b}" for k, a in enumerate(_NAMES) for b in _NAMES[k:]] + [f"{a} - avg({a}) OVER {_WINDOW} AS d{a}" for a in _NAMES])
#: By the cofactors of the 3 x 3 covariance.
_DISTANCE = f""", f AS (SELECT charger_id, arrival, value AS x, (arrival % 17)::DOUBLE AS y, value * 0.1::DOUBLE + (arrival % 5) AS z FROM dense), c AS (SELECT arrival, count(*) OVER {_WINDOW} AS n, {_ENTRIES} FROM f)
SELECT arrival, round(sqrt((dx * dx * (yy * zz - yz * yz) + dy * dy * (xx * zz - xz * xz) + dz * dz * (xx * yy - xy * xy) + 2 * (dx * dy * (xz * yz - xy * zz) + dx * dz * (xy * yz - xz * yy) + dy * dz * (xy * xz - xx * yz)))
/ (xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz))), 4) AS score FROM c WHERE n = 50"""


@query(sql(_DISTANCE, "dense"))
def moving_mahalanobis_three(spark, sf):
    rows = t.telemetry(spark, sf, dense=True).select("charger_id", "arrival", F.col("value").alias("x"), (F.col("arrival") % 17).cast("double").alias("y"), (F.col("value") * 0.1 + F.col("arrival") % 5).alias("z"))
    return moving.mahalanobis_scores(rows, ["charger_id"], "arrival", list(_NAMES), 50).where("score is not null").select("arrival", F.round("score", 4).alias("score"))


#: Requests of a charger one after another: what is granted so far, as (request, kind, model, service), in order.
_CLAIMS = """WITH RECURSIVE q AS (SELECT c_custkey AS id, c_custkey * 7 % 60 AS charger, ['click', 'view', 'error', '+', 'a/b'][c_custkey % 5 + 1] AS kind, c_nationkey AS service, c_custkey % 2 AS model, row_number() OVER (PARTITION BY c_custkey * 7 % 60 ORDER BY c_custkey) AS n FROM customer),
r AS (SELECT charger, n, id, 'create' AS verdict, id AS granted_id, [{'id': id, 'kind': kind, 'model': model, 'service': service}] AS held FROM q WHERE n = 1
UNION ALL SELECT charger, n, id, CASE WHEN way IS NULL THEN 'create' WHEN way.kind = kind AND way.model = model THEN 'reuse' WHEN way.service = service THEN 'replace' ELSE 'conflict' END, coalesce(way.id, id), CASE WHEN way IS NULL THEN list_append(held, {'id': id, 'kind': kind, 'model': model, 'service': service}) ELSE held END
FROM (SELECT q.*, r.held, list_filter(r.held, lambda h: h.kind = q.kind OR (h.kind <> 'a/b' AND q.kind <> 'a/b' AND (h.kind = '+' OR q.kind = '+')))[1] AS way FROM r JOIN q ON q.charger = r.charger AND q.n = r.n + 1) t)
SELECT id AS request_id, verdict, granted_id FROM r"""


@query(_CLAIMS)
def claim_arbitration(spark, sf):
    """Each customer asks for one kind of topics of a charger; equal kinds overlap, and one level's wildcard overlaps every kind of one level."""
    rows, key = t.table(spark, sf, "customer"), F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ("click", "view", "error", "+", "a/b"))), (key % 5 + 1).cast("int"))
    topic = F.concat(F.lit("device/evCharger/"), (key * 7 % 60).cast("string"), F.lit("/"), kind)
    return claims.arbitrate(rows.select(key.alias("request_id"), key.alias("at"), F.col("c_nationkey").cast("string").alias("service"), F.array(topic).alias("topics"), F.create_map(F.lit("model"), (key % 2).cast("string")).alias("settings")))
