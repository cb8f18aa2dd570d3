"""Monitoring tables derived from the test data, as DataFrames and as SQL.

Readings are events of a user, anomalies their large values; the `dense` tables put all users on four chargers for the analyses that
need long series. Arrival order is event_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
NTZ = "timestamp_ntz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast(NTZ)


def telemetry(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    key = F.col("user_id") % 4 if dense else F.col("user_id")
    return table(spark, sf_dir, "events").select(
        key.cast("string").alias("charger_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("type"), "value", F.lit("mqtt").alias("data_source"),
        F.date_trunc("hour", "ts").cast(NTZ).alias("created"), F.col("event_id").alias("arrival"),
    )


TELEMETRY = """SELECT CAST({key} AS VARCHAR) AS charger_id, ts AS "timestamp", event_type AS type, value, 'mqtt' AS data_source, date_trunc('hour', ts) AS created, event_id AS arrival FROM events"""
SQL = {
    "telemetry": TELEMETRY.format(key="user_id"),
    "dense": TELEMETRY.format(key="user_id % 4"),
}


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages; every 11th has an empty level in its topic, every 13th a time that is none, every 17th a boolean for a value, every 19th no time, every 23rd Unix seconds;
    every 29th has a text after its payload, every 31st single quotes, every 37th an earlier value of the same name."""
    e = table(spark, sf_dir, "events")
    every = lambda n: F.col("event_id") % n == 0
    topic = F.concat(F.lit("device/evCharger/"), F.col("user_id").cast("string"), F.when(every(11), "//").otherwise("/"), "event_type")
    stamp = F.when(every(13), F.lit('"not-a-date"')).when(every(23), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")).otherwise(F.concat(F.lit('"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"')))
    value = F.when(every(17), F.lit("true")).otherwise(F.col("value").cast("string"))
    payload = F.when(every(19), F.concat(F.lit('{"value": '), value, F.lit("}"))).otherwise(F.concat(F.lit('{"value": '), value, F.lit(', "timestamp": '), stamp, F.lit("}")))
    payload = F.when(every(37), F.concat(F.lit('{"value": -7, '), F.substring(payload, 2, 1 << 20))).otherwise(payload)
    payload = F.when(every(29), F.concat(payload, F.lit(" and so on"))).when(every(31), F.replace(payload, F.lit('"'), F.lit("'"))).otherwise(payload)
    return e.select(topic.alias("topic"), payload.alias("payload"), F.lit(1).alias("qos"), F.lit(False).alias("retain"), F.col("ts").cast("timestamp").alias("received_at"), F.col("event_id").alias("seq"))


SQL["parsed"] = """SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS charger_id, event_type AS type, value, ts AS received_at,
CASE WHEN event_id % 19 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0 THEN ts WHEN event_id % 13 = 0 THEN NULL ELSE date_trunc('second', ts) END AS "timestamp",
CASE WHEN event_id % 11 = 0 THEN 'Unsupported topic' WHEN event_id % 29 = 0 OR event_id % 31 = 0 THEN 'Invalid telemetry value' WHEN event_id % 19 <> 0 AND event_id % 13 = 0 THEN 'Invalid timestamp format' WHEN event_id % 17 = 0 THEN 'Invalid telemetry value' END AS parse_error FROM events"""


def chargers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("charger_id"), F.col("c_name").alias("charger_name"), F.col("c_mktsegment").alias("state"), (F.col("c_acctbal") >= 0).alias("online"), F.col("c_nationkey").alias("nation"))


SQL["chargers"] = "SELECT CAST(c_custkey AS VARCHAR) AS charger_id, c_name AS charger_name, c_mktsegment AS state, c_acctbal >= 0 AS online, c_nationkey AS nation FROM customer"

KINDS = {"click": "ml_conformal_static_univariate", "error": "ml_adaptive_stream_univariate", "view": "ml_tailprob_univariate"}


def anomalies(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Events above 120: purchases are multivariate with a set, signups multivariate without one."""
    rows = telemetry(spark, sf_dir, dense).where("value > 120")
    kind = F.coalesce(*[F.when(F.col("type") == t, k) for t, k in KINDS.items()], F.lit("ml_conformal_static_multivariate"))
    return rows.select(
        "charger_id", "timestamp", F.when(F.col("type").isin("purchase", "signup"), "__multivariate__").otherwise(F.col("type")).alias("telemetry_type"), kind.alias("anomaly_type"), F.col("value").alias("anomaly_value"),
        F.when(F.col("arrival") % 2 == 0, "conformal_pvalue").alias("value_type"), F.when(F.col("type") == "purchase", F.array(F.lit("click"), F.lit("error"))).alias("sensor_set"), "arrival", "created",
    )


_ANOMALIES = """SELECT charger_id, "timestamp", CASE WHEN type IN ('purchase', 'signup') THEN '__multivariate__' ELSE type END AS telemetry_type,
CASE type WHEN 'click' THEN 'ml_conformal_static_univariate' WHEN 'error' THEN 'ml_adaptive_stream_univariate' WHEN 'view' THEN 'ml_tailprob_univariate' ELSE 'ml_conformal_static_multivariate' END AS anomaly_type,
value AS anomaly_value, CASE WHEN arrival % 2 = 0 THEN 'conformal_pvalue' END AS value_type, CASE WHEN type = 'purchase' THEN ['click', 'error'] END AS sensor_set, arrival, created FROM {source} WHERE value > 120"""
SQL["anomalies"] = _ANOMALIES.format(source="telemetry")
SQL["dense_anomalies"] = _ANOMALIES.format(source="dense")


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of two anomalies in three."""
    from pulsegrid.operators.evidence import identities

    return identities(anomalies(spark, sf_dir).where("arrival % 3 <> 0"))


SQL["identity"] = """SELECT DISTINCT sha256(concat_ws('|', charger_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f'), telemetry_type)) AS anomaly_id, charger_id, "timestamp", telemetry_type FROM anomalies WHERE arrival % 3 <> 0"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each dense event: one service for each charger, static where its number is even. p-values and scores are made from the values."""
    rows = telemetry(spark, sf_dir, dense=True)
    static = F.col("charger_id").isin("0", "2")
    return rows.select(
        F.concat(F.lit("svc-"), "charger_id").alias("service_id"), "timestamp", F.col("arrival").alias("sequence_number"), "charger_id", F.array("type").alias("sensor_set"), F.create_map("type", "timestamp").alias("input_timestamps"),
        F.when(static, "static_baseline").otherwise("adaptive_stream").alias("strategy"), F.when(static, 1.0 / (1.0 + F.col("value"))).alias("p_value"), F.col("value").alias("anomaly_score"),
        F.when(F.col("arrival") % 3 == 0, F.col("value") / 10.0).alias("restarted_martingale"), F.when(F.col("arrival") % 3 != 0, F.array(F.struct(F.lit("power").alias("tracker_id"), F.lit("cusum").alias("alarm_statistic"), (F.col("value") / 5.0 - 1.0).alias("statistic_value"), (F.col("arrival") % 7 + 10.0).alias("threshold")))).alias("tracker_results"),
        (F.col("arrival") % 5 + 100.0).alias("threshold"), (F.col("value") > 120).alias("alarm"), "created", F.lit("hbos").alias("model_type"),
    )


SQL["evidence"] = """SELECT 'svc-' || charger_id AS service_id, "timestamp", arrival AS sequence_number, charger_id, [type] AS sensor_set, type, CASE WHEN charger_id IN ('0', '2') THEN 'static_baseline' ELSE 'adaptive_stream' END AS strategy,
CASE WHEN charger_id IN ('0', '2') THEN 1.0::DOUBLE / (1.0::DOUBLE + value) END AS p_value, value AS anomaly_score, CASE WHEN arrival % 3 = 0 THEN value / 10.0::DOUBLE END AS restarted_martingale,
CASE WHEN arrival % 3 <> 0 THEN value / 5.0::DOUBLE - 1.0::DOUBLE END AS statistic_value, (arrival % 7 + 10)::DOUBLE AS tracker_threshold, (arrival % 5 + 100)::DOUBLE AS threshold, value > 120 AS alarm, created FROM dense"""


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service for each supplier: filters of one charger, by turns for all types, one type, or one level."""
    charger = (F.col("s_suppkey") * 7 % 60).cast("string")
    last = F.when(F.col("s_suppkey") % 3 == 0, "#").when(F.col("s_suppkey") % 3 == 1, "click").otherwise("+")
    stamp = F.timestamp_seconds(F.lit(1704067200) + F.col("s_suppkey") * 60).cast(NTZ)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.array(F.concat(F.lit("device/evCharger/"), charger, F.lit("/"), last)).alias("mqtt_topic"), (F.col("s_acctbal") > 0).alias("active"), stamp.alias("created_at"), F.col("s_suppkey").alias("number"))


SQL["services"] = """SELECT 's' || s_suppkey AS id, 'device/evCharger/' || (s_suppkey * 7 % 60) || '/' || CASE s_suppkey % 3 WHEN 0 THEN '#' WHEN 1 THEN 'click' ELSE '+' END AS topic, CAST(s_suppkey * 7 % 60 AS VARCHAR) AS charger, s_suppkey % 3 AS form, s_acctbal > 0 AS active, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(s_suppkey * 60) AS created_at, s_suppkey AS number FROM supplier"""
_NEEDS = {"anomalies": ["telemetry"], "dense_anomalies": ["dense"], "identity": ["telemetry", "anomalies"], "evidence": ["dense"]}


def sql(body: str, *names: str) -> str:
    """body after the tables it names."""
    order: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    return ("WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body) if order else body
