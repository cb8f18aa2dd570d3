"""Queries of ingestion and of the read API."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import payloads, scalars, topics
from pulsegrid.operators import evidence as ev
from pulsegrid.operators import fleet, matching, relational
from pulsegrid.plans import tables as t
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import sql

KEY = ["charger_id", "timestamp", "type"]
ANOMALY_KEY = ["charger_id", "timestamp", "telemetry_type"]


@query("""SELECT event_id AS seq, CASE WHEN event_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) END AS charger_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS telemetry_type FROM events""")
def topic_parse(spark, sf):
    topic = topics.parse_topic(F.col("topic"))
    return t.messages(spark, sf).select("seq", topic["charger_id"].alias("charger_id"), topic["telemetry_type"].alias("telemetry_type"))


@query("""SELECT event_id AS seq, event_type || '/L' || (event_id % 3) AS full_key, event_type AS top_key, 'L' || (event_id % 3) AS leaf_key FROM events""")
def sensor_keys(spark, sf):
    kind = F.concat("event_type", F.lit("//L"), (F.col("event_id") % 3).cast("string"))
    return t.table(spark, sf, "events").select(F.col("event_id").alias("seq"), *[topics.sensor_key(kind, s).alias(n) for s, n in (("full_hierarchy", "full_key"), ("top_level", "top_key"), ("leaf", "leaf_key"))])


@query(sql("""SELECT seq, charger_id, type, "timestamp", value FROM parsed WHERE parse_error IS NULL""", "parsed"))
def payload_parse(spark, sf):
    rows = payloads.accepted(payloads.parse_telemetry(t.messages(spark, sf)))
    return rows.select("seq", "charger_id", "type", F.col("timestamp").cast(t.NTZ).alias("timestamp"), "value")


@query(sql("SELECT seq, parse_error, parse_error <> 'Unsupported topic' AS is_error FROM parsed WHERE parse_error IS NOT NULL", "parsed"))
def parse_rejects(spark, sf):
    return payloads.rejected(payloads.parse_telemetry(t.messages(spark, sf))).select("seq", "parse_error", "is_error")


@query("""SELECT event_id AS seq, 1.0::DOUBLE AS on_value, value AS value_value, CASE WHEN event_id % 2 = 0 THEN event_id::DOUBLE END AS text_value, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS n_features FROM events""")
def feature_sanitize(spark, sf):
    e = t.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x")
    payload = F.concat(F.lit('{"on": true, "value": '), F.col("value").cast("string"), F.lit(', "text": "'), text, F.lit('", "timestamp": 5, "huge": 1e12}'))
    made = e.select(F.col("event_id").alias("seq"), payloads.features(payload).alias("f"))
    get = lambda k: F.try_element_at("f", F.lit(k))
    return made.select("seq", get("on").alias("on_value"), get("value").alias("value_value"), get("text").alias("text_value"), F.size("f").cast("long").alias("n_features"))


@query(sql("""SELECT charger_id, type, hour, arg_min(value, arrival) AS value, min(arrival) AS arrival FROM (SELECT *, date_trunc('hour', "timestamp") AS hour FROM telemetry) GROUP BY ALL""", "telemetry"))
def telemetry_dedup(spark, sf):
    rows = t.telemetry(spark, sf).select("charger_id", "type", F.col("created").alias("hour"), "value", "arrival")
    return relational.first_wins(rows, ["charger_id", "type", "hour"], "arrival")


@query(sql("""SELECT n.charger_id, n."timestamp", n.type, arg_min(n.value, n.arrival) AS value FROM telemetry n WHERE NOT EXISTS (SELECT 1 FROM telemetry o WHERE o.arrival % 2 = 0 AND o.charger_id = n.charger_id AND o."timestamp" = n."timestamp" AND o.type = n.type) GROUP BY ALL""", "telemetry"))
def insert_absent(spark, sf):
    rows = t.telemetry(spark, sf)
    return relational.insert_if_absent(rows.where("arrival % 2 = 0"), rows, KEY, "arrival").select(*KEY, "value")


@query(sql("SELECT DISTINCT type FROM telemetry WHERE charger_id = '3' ORDER BY type LIMIT 100", "telemetry"))
def telemetry_types(spark, sf):
    return t.telemetry(spark, sf).where("charger_id = '3'").select("type").distinct().orderBy("type").limit(relational.checked_limit("types", 100))


@query(sql("""SELECT "timestamp", value, created FROM telemetry WHERE charger_id = '3' AND type = 'click' ORDER BY "timestamp" DESC, arrival DESC LIMIT 1000""", "telemetry"))
def telemetry_latest(spark, sf):
    rows = t.telemetry(spark, sf).where("charger_id = '3' and type = 'click'")
    return rows.orderBy(F.col("timestamp").desc(), F.col("arrival").desc()).limit(relational.checked_limit("telemetry", None)).select("timestamp", "value", "created")


@query(sql("""SELECT "timestamp", value FROM telemetry WHERE charger_id = '3' AND type = 'click' AND "timestamp" < TIMESTAMP '2024-01-15 00:00:00' ORDER BY "timestamp" DESC, arrival DESC LIMIT 50""", "telemetry"))
def telemetry_history_cursor(spark, sf):
    rows = t.telemetry(spark, sf).where("charger_id = '3' and type = 'click' and timestamp < timestamp_ntz'2024-01-15 00:00:00'")
    return rows.orderBy(F.col("timestamp").desc(), F.col("arrival").desc()).limit(50).select("timestamp", "value")


@query(sql("""SELECT charger_id, type, "timestamp", created FROM telemetry WHERE (created, "timestamp") > (TIMESTAMP '2024-01-20 05:00:00', TIMESTAMP '2024-01-20 05:30:00') ORDER BY created, "timestamp", arrival LIMIT 500""", "telemetry"))
def telemetry_live_cursor(spark, sf):
    at = [F.lit(x).cast(t.NTZ) for x in ("2024-01-20 05:00:00", "2024-01-20 05:30:00")]
    rows = t.telemetry(spark, sf).where(relational.keyset_after(["created", "timestamp"], at))
    return rows.orderBy("created", "timestamp", "arrival").limit(500).select("charger_id", "type", "timestamp", "created")


@query(sql("""SELECT service_id, sequence_number, "timestamp", created FROM evidence WHERE (created, "timestamp", service_id, sequence_number) > (TIMESTAMP '2024-01-10 05:00:00', TIMESTAMP '2024-01-10 05:30:00', 'svc-1', 0) ORDER BY created, "timestamp", service_id, sequence_number LIMIT 500""", "evidence"))
def evidence_cursor(spark, sf):
    columns = ["created", "timestamp", "service_id", "sequence_number"]
    at = [F.lit("2024-01-10 05:00:00").cast(t.NTZ), F.lit("2024-01-10 05:30:00").cast(t.NTZ), "svc-1", 0]
    rows = t.evidence(spark, sf).where(relational.keyset_after(columns, at))
    return rows.orderBy(*columns).limit(500).select("service_id", "sequence_number", "timestamp", "created")


@query(sql("""SELECT * FROM (SELECT service_id, sequence_number, "timestamp" FROM evidence WHERE charger_id = '1' ORDER BY "timestamp" DESC, sequence_number DESC LIMIT 200) ORDER BY "timestamp", sequence_number""", "evidence"))
def evidence_latest(spark, sf):
    rows = t.evidence(spark, sf).where("charger_id = '1'").orderBy(F.col("timestamp").desc(), F.col("sequence_number").desc()).limit(200)
    return rows.orderBy("timestamp", "sequence_number").select("service_id", "sequence_number", "timestamp")


@query(sql("""SELECT service_id, sequence_number, "timestamp" FROM evidence WHERE charger_id = '2' AND list_contains(sensor_set, 'click')""", "evidence"))
def evidence_for_sensor(spark, sf):
    return t.evidence(spark, sf).where(F.col("charger_id") == "2").where(F.array_contains("sensor_set", "click")).select("service_id", "sequence_number", "timestamp")


@query(sql("""SELECT i.anomaly_id, a.charger_id, a."timestamp", a.telemetry_type, a.anomaly_value FROM anomalies a JOIN identity i USING (charger_id, "timestamp", telemetry_type) ORDER BY a."timestamp" DESC, a.arrival DESC LIMIT 500""", "identity"))
def anomaly_identity_join(spark, sf):
    joined = t.anomalies(spark, sf).join(t.identity(spark, sf), ANOMALY_KEY)
    return joined.orderBy(F.col("timestamp").desc(), F.col("arrival").desc()).limit(500).select("anomaly_id", *ANOMALY_KEY, "anomaly_value")


@query(sql("""SELECT DISTINCT sha256(concat_ws('|', charger_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f'), telemetry_type)) AS anomaly_id, charger_id, "timestamp", telemetry_type FROM anomalies a WHERE NOT EXISTS (SELECT 1 FROM identity i WHERE i.charger_id = a.charger_id AND i."timestamp" = a."timestamp" AND i.telemetry_type = a.telemetry_type)""", "identity"))
def identity_backfill(spark, sf):
    return ev.missing_identities(t.anomalies(spark, sf), t.identity(spark, sf)).select("anomaly_id", *ANOMALY_KEY)


@query(sql("SELECT charger_id, charger_name FROM chargers WHERE charger_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey % 50 = 7)", "chargers"))
def favourite_chargers(spark, sf):
    marked = t.table(spark, sf, "orders").where("o_custkey % 50 = 7").select(F.col("o_custkey").cast("string").alias("charger_id"))
    return t.chargers(spark, sf).join(marked, "charger_id", "left_semi").select("charger_id", "charger_name")


@query(sql("SELECT count(*) AS all_chargers, count(*) FILTER (WHERE online) AS online, count(*) FILTER (WHERE NOT online) AS offline FROM chargers", "chargers"))
def charger_status_counts(spark, sf):
    return fleet.status_counts(t.chargers(spark, sf))


@query(sql("SELECT charger_id, charger_name FROM chargers WHERE (contains(lower(charger_id), '00001') OR contains(lower(charger_name), '00001')) AND online", "chargers"))
def charger_search(spark, sf):
    return fleet.search(t.chargers(spark, sf), "00001", online=True).select("charger_id", "charger_name")


@query(sql("SELECT charger_id, charger_name FROM chargers ORDER BY charger_id LIMIT 100 OFFSET 50", "chargers"))
def charger_page(spark, sf):
    return t.chargers(spark, sf).orderBy("charger_id").offset(50).limit(relational.checked_limit("chargers", 100)).select("charger_id", "charger_name")


@query(sql("""SELECT charger_id, arg_max("timestamp", arrival) AS last_message, count(*) AS message_count FROM telemetry GROUP BY 1""", "telemetry"))
def charger_last_seen(spark, sf):
    return fleet.last_arrivals(t.telemetry(spark, sf))


@query(sql("""SELECT coalesce(c.charger_id, s.charger_id) AS charger_id, c.charger_name, coalesce(s.last_message, TIMESTAMP '2000-01-01 00:00:00') AS last_message FROM chargers c FULL JOIN (SELECT charger_id, arg_max("timestamp", arrival) AS last_message FROM telemetry GROUP BY 1) s ON c.charger_id = s.charger_id""", "telemetry", "chargers"))
def charger_merge(spark, sf):
    target = t.chargers(spark, sf).select("charger_id", "charger_name").withColumn("last_message", F.lit(None).cast(t.NTZ))
    updates = fleet.last_arrivals(t.telemetry(spark, sf)).drop("message_count")
    return relational.merge_rows(target, updates, "charger_id").withColumn("last_message", F.coalesce("last_message", F.lit("2000-01-01 00:00:00").cast(t.NTZ)))


@query(sql("""SELECT count(*) AS n FROM anomalies WHERE "timestamp" > TIMESTAMP '2024-01-20 00:00:00'""", "anomalies"))
def anomaly_count_since(spark, sf):
    return t.anomalies(spark, sf).where("timestamp > timestamp_ntz'2024-01-20 00:00:00'").agg(F.count("*").alias("n"))


@query(sql("SELECT count(DISTINCT charger_id) AS chargers, count(*) FILTER (WHERE value_type = 'conformal_pvalue') AS probabilities FROM anomalies", "anomalies"))
def affected_chargers(spark, sf):
    return t.anomalies(spark, sf).agg(F.count_distinct("charger_id").alias("chargers"), F.count_if(F.col("value_type").isin("conformal_pvalue", "tail_pvalue")).alias("probabilities"))


@query(sql("""SELECT a.arrival, s.type FROM anomalies a JOIN (SELECT DISTINCT charger_id, type FROM telemetry) s ON a.charger_id = s.charger_id AND (a.telemetry_type = s.type OR (a.telemetry_type = '__multivariate__' AND (coalesce(len(a.sensor_set), 0) = 0 OR list_contains(a.sensor_set, s.type))))""", "anomalies"))
def anomaly_applicable(spark, sf):
    return matching.applicable(t.anomalies(spark, sf), t.telemetry(spark, sf)).select("arrival", "type")


@query(sql("""SELECT charger_id, telemetry_type, anomaly_type, "timestamp" FROM anomalies ORDER BY "timestamp" DESC, arrival DESC LIMIT 300""", "anomalies"))
def global_anomalies(spark, sf):
    rows = t.anomalies(spark, sf).orderBy(F.col("timestamp").desc(), F.col("arrival").desc()).limit(relational.checked_limit("anomalies", 300))
    return rows.select("charger_id", "telemetry_type", "anomaly_type", "timestamp")


@query(sql("SELECT arrival, coalesce(value_type, CASE WHEN anomaly_type LIKE 'ml_conformal_%' THEN 'conformal_pvalue' WHEN anomaly_type LIKE 'ml_tailprob_%' THEN 'tail_pvalue' ELSE 'zscore' END) AS value_type, array_to_string(CASE WHEN sensor_set IS NULL AND telemetry_type <> '__multivariate__' THEN [telemetry_type] ELSE sensor_set END, ',') AS sensors FROM anomalies", "anomalies"))
def value_type_backfill(spark, sf):
    return ev.backfilled(t.anomalies(spark, sf)).select("arrival", "value_type", F.array_join("sensor_set", ",").alias("sensors"))


@query(sql("""SELECT n.charger_id, n."timestamp", n.telemetry_type FROM anomalies n WHERE NOT EXISTS (SELECT 1 FROM anomalies o WHERE o.arrival % 3 <> 0 AND o.charger_id = n.charger_id AND o."timestamp" = n."timestamp" AND o.telemetry_type = n.telemetry_type)""", "anomalies"))
def anomaly_create(spark, sf):
    rows = t.anomalies(spark, sf)
    return ev.create(rows.where("arrival % 3 <> 0"), rows).select(*ANOMALY_KEY)


@query(sql("""SELECT anomaly_id FROM identity i WHERE NOT EXISTS (SELECT 1 FROM anomalies a WHERE a.arrival % 5 = 1 AND a.charger_id = i.charger_id AND a."timestamp" = i."timestamp" AND a.telemetry_type = i.telemetry_type)""", "identity"))
def cascade_delete(spark, sf):
    return relational.without(t.identity(spark, sf), t.anomalies(spark, sf).where("arrival % 5 = 1"), ANOMALY_KEY).select("anomaly_id")


@query(sql("""SELECT max((created, "timestamp"))[1] AS created, max((created, "timestamp"))[2] AS "timestamp" FROM telemetry""", "telemetry"))
def ingest_cursor(spark, sf):
    return fleet.cursor(t.telemetry(spark, sf), ["created", "timestamp"])


@query(sql("""SELECT CASE WHEN contains(type, 'err') THEN 'cpu' WHEN starts_with(type, 'view') THEN 'system' WHEN starts_with(type, 'click') THEN 'controller' ELSE 'other' END AS category, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS n FROM telemetry GROUP BY 1""", "telemetry"))
def category_groups(spark, sf):
    named = F.when(F.col("type") == "error", "thermal/err").when(F.col("type") == "view", "systemView").when(F.col("type") == "click", "controllerClick").otherwise(F.col("type"))
    rows = t.telemetry(spark, sf).select("type", scalars.category(named).alias("category"))
    return rows.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.count("*").alias("n"))


@query(sql("SELECT charger_id, sensor, count(*) AS n, max(sequence_number) AS last_sequence FROM (SELECT charger_id, sequence_number, unnest(sensor_set) AS sensor FROM evidence) GROUP BY 1, 2", "evidence"))
def sensor_evidence_groups(spark, sf):
    rows = t.evidence(spark, sf).select("charger_id", "sequence_number", F.explode("sensor_set").alias("sensor"))
    return rows.groupBy("charger_id", "sensor").agg(F.count("*").alias("n"), F.max("sequence_number").alias("last_sequence"))


_MERGE = """, both_ AS (SELECT *, 0 AS side FROM dense WHERE arrival % 3 <> 0 UNION ALL SELECT charger_id, "timestamp", type, value + 1000, data_source, created, arrival, 1 FROM dense WHERE arrival % 2 = 0),
one AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY charger_id, type, "timestamp" ORDER BY side DESC, arrival DESC) = 1)"""


@query(sql("", "dense").rstrip() + _MERGE + """ SELECT charger_id, type, "timestamp", value FROM one QUALIFY row_number() OVER (PARTITION BY charger_id, type ORDER BY "timestamp" DESC) <= 200""")
def merge_telemetry(spark, sf):
    rows = t.telemetry(spark, sf, dense=True)
    incoming = rows.where("arrival % 2 = 0").withColumn("value", F.col("value") + 1000)
    merged = relational.merge_series(rows.where("arrival % 3 <> 0"), incoming, ["charger_id", "type", "timestamp"], ["charger_id", "type"], [F.col("timestamp").desc()], "arrival", 200)
    return merged.select("charger_id", "type", "timestamp", "value")


@query(sql("""SELECT service_id, sequence_number, "timestamp", anomaly_score FROM evidence QUALIFY row_number() OVER (PARTITION BY charger_id ORDER BY "timestamp" DESC, sequence_number DESC) <= 500""", "evidence"))
def merge_evidence(spark, sf):
    rows = t.evidence(spark, sf).select("service_id", "sequence_number", "timestamp", "charger_id", "anomaly_score")
    order = [F.col("timestamp").desc(), F.col("sequence_number").desc()]
    merged = relational.merge_series(rows, rows.where("sequence_number % 2 = 0"), ["timestamp", "service_id", "sequence_number"], ["charger_id"], order, "sequence_number", 500)
    return merged.select("service_id", "sequence_number", "timestamp", "anomaly_score")


@query(sql("""SELECT w.charger_id, w.type, arg_min(s.id, struct_pack(a := NOT s.active, c := -epoch_us(s.created_at), i := s.id)) AS service_id FROM (SELECT DISTINCT charger_id, type FROM telemetry) w JOIN services s ON s.charger = w.charger_id AND (s.form <> 1 OR w.type = 'click') GROUP BY 1, 2""", "telemetry", "services"))
def sensor_claims(spark, sf):
    return matching.sensor_claims(t.telemetry(spark, sf), t.services(spark, sf))


@query(sql("""SELECT DISTINCT r.topic, s.id AS service_id, s.topic AS claimed FROM services r JOIN services s ON s.charger = r.charger AND s.active AND (r.form <> 1 OR s.form <> 1 OR r.topic = s.topic) WHERE NOT r.active""", "services"))
def topic_conflicts(spark, sf):
    rows = t.services(spark, sf).select("id", "active", F.get("mqtt_topic", F.lit(0)).alias("topic"))
    requested = rows.where("not active").select("topic").distinct()
    return matching.topic_conflicts(requested, rows.where("active").select(F.col("id").alias("service_id"), F.col("topic").alias("claimed")))


@query(sql("SELECT id, topic FROM services WHERE charger = '7'", "services"))
def charger_services(spark, sf):
    return matching.services_of(t.services(spark, sf), "7").select("id", F.get("mqtt_topic", F.lit(0)).alias("topic"))


@query("""SELECT event_id AS seq, user_id = 3 AS of_charger, event_type = 'click' AS of_type FROM events WHERE event_id % 11 <> 0""")
def topic_match(spark, sf):
    rows = t.messages(spark, sf).where("seq % 11 <> 0")
    return rows.select("seq", topics.topic_matches(F.col("topic"), "device/evCharger/3/#").alias("of_charger"), topics.topic_matches(F.col("topic"), "device/evCharger/+/click").alias("of_type"))


@query("""SELECT event_id AS seq, user_id::VARCHAR || ' B' AS cleaned, 'Charge' || event_type AS display, 'u***r@m***l.org from 10.1.2.x' AS redacted, substr(sha256(event_type), 1, 10) AS token FROM events""")
def text_functions(spark, sf):
    e = t.table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"), scalars.clean_string(F.concat(F.col("user_id").cast("string"), F.lit("%20B/"))).alias("cleaned"), scalars.display_name(F.concat(F.lit("charge"), "event_type")).alias("display"),
        scalars.redact(F.lit("user@mail.org from 10.1.2.3")).alias("redacted"), scalars.token_hash(F.col("event_type")).alias("token"),
    )


@query("""SELECT service_id, array_to_string(names, ',') AS names FROM (SELECT s_nationkey AS service_id, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1)""")
def ordered_names(spark, sf):
    """listagg in the order of a column."""
    rows = t.table(spark, sf, "supplier")
    return rows.groupBy(F.col("s_nationkey").alias("service_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]), ",").alias("names"))
