"""Queries of series, sequential tests, moving statistics, health and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.operators import charts, fleet, matching, moving, sequential, series
from pulsegrid.operators import evidence as ev
from pulsegrid.plans import tables as t
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import sql

STREAM = ["charger_id"]


def _anomalies(spark, sf):
    """Anomalies of dense series as (charger_id, anomaly_time, kind, position)."""
    return t.anomalies(spark, sf, dense=True).select("charger_id", F.col("timestamp").alias("anomaly_time"), F.col("anomaly_type").alias("kind"), F.col("arrival").alias("position"))


def _clicks(spark, sf):
    return t.telemetry(spark, sf, dense=True).where("type = 'click'").select("charger_id", "timestamp", "value", "arrival")


_PAIRS = """p AS (SELECT charger_id, "timestamp", value, arrival FROM dense WHERE type = 'click'), a AS (SELECT charger_id, "timestamp" AS anomaly_time, anomaly_type AS kind, arrival AS position FROM dense_anomalies)"""


@query(sql("", "dense_anomalies") + ", " + _PAIRS + """ SELECT p.arrival, p."timestamp", arg_min(kind, position) AS kind, min(position) AS position FROM p JOIN a ON p.charger_id = a.charger_id AND abs(epoch_us(p."timestamp") - epoch_us(anomaly_time)) <= 300000000 GROUP BY 1, 2""")
def anomaly_markers(spark, sf):
    found = matching.first_match(_clicks(spark, sf), _anomalies(spark, sf), STREAM, "timestamp", "anomaly_time", "position", 300.0)
    return found.select("arrival", "timestamp", "kind", "position")


@query(sql("", "dense_anomalies") + ", " + _PAIRS + """ SELECT arrival FROM p WHERE EXISTS (SELECT 1 FROM a WHERE p.charger_id = a.charger_id AND abs(epoch_us(p."timestamp") - epoch_us(anomaly_time)) <= 300000000)""")
def has_anomaly(spark, sf):
    return matching.has_match(_clicks(spark, sf), _anomalies(spark, sf), STREAM, "timestamp", "anomaly_time", 300.0).select("arrival")


@query(sql("", "dense_anomalies") + ", " + _PAIRS + """ SELECT a.position, arg_min(p.arrival, struct_pack(g := abs(epoch_us(p."timestamp") - epoch_us(anomaly_time)), i := p.arrival)) AS arrival FROM a JOIN p ON p.charger_id = a.charger_id AND abs(epoch_us(p."timestamp") - epoch_us(anomaly_time)) <= 600000000 GROUP BY 1""")
def nearest_point(spark, sf):
    return matching.nearest(_anomalies(spark, sf), _clicks(spark, sf), STREAM, "anomaly_time", "timestamp", "arrival", 600.0).select("position", "arrival")


@query(sql("""SELECT e.service_id, e.sequence_number, e.type FROM evidence e WHERE EXISTS (SELECT 1 FROM dense d WHERE d.value > 20 AND d.charger_id = e.charger_id AND d.type = e.type AND epoch_ms(d."timestamp") = epoch_ms(e."timestamp"))""", "evidence"))
def evidence_points(spark, sf):
    return matching.evidence_points(t.evidence(spark, sf), t.telemetry(spark, sf, dense=True).where("value > 20")).select("service_id", "sequence_number", "type")


@query(sql("""SELECT d.charger_id, d."timestamp", max(e.anomaly_score) AS score FROM dense d LEFT JOIN evidence e ON e.charger_id = d.charger_id AND e."timestamp" = d."timestamp" AND e.strategy = 'adaptive_stream' AND e.anomaly_score > 0.2 GROUP BY 1, 2""", "evidence"))
def telemetry_gaps(spark, sf):
    scores = t.evidence(spark, sf).where("strategy = 'adaptive_stream' and anomaly_score > 0.2").groupBy("charger_id", "timestamp").agg(F.max("anomaly_score").alias("score"))
    return matching.with_gaps(t.telemetry(spark, sf, dense=True), scores, ["charger_id", "timestamp"])


@query(sql("""SELECT charger_id, zone, min("timestamp") AS zone_start, max("timestamp") AS zone_end, count(*) AS members FROM (SELECT *, sum(new) OVER (PARTITION BY charger_id ORDER BY "timestamp" RANGE UNBOUNDED PRECEDING)::BIGINT AS zone FROM (SELECT *, CASE WHEN epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY charger_id ORDER BY "timestamp")) <= 300000000 THEN 0 ELSE 1 END AS new FROM dense)) GROUP BY 1, 2""", "dense"))
def anomaly_zones(spark, sf):
    return series.zones(t.telemetry(spark, sf, dense=True), STREAM, "timestamp", 300.0)


@query(sql("""SELECT min(x) AS low, max(x) AS high FROM (SELECT "timestamp" AS x FROM telemetry UNION ALL SELECT "timestamp" FROM evidence)""", "telemetry", "evidence"))
def series_extent(spark, sf):
    return series.extent((t.telemetry(spark, sf), "timestamp"), (t.evidence(spark, sf), "timestamp"))


@query(sql("""SELECT charger_id, max("timestamp") AS latest, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max("timestamp"))) / 1000000.0::DOUBLE AS age_seconds, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max("timestamp"))) BETWEEN 0 AND 86400000000 AS is_recent FROM telemetry GROUP BY 1""", "telemetry"))
def recent_flag(spark, sf):
    return series.recent(t.telemetry(spark, sf), STREAM, "timestamp", F.lit("2024-01-30 12:00:00").cast(t.NTZ), 86400.0)


@query(sql("""SELECT x.charger_id, x.arrival FROM telemetry x JOIN (SELECT charger_id, max("timestamp") AS latest FROM telemetry GROUP BY 1) m USING (charger_id) WHERE x."timestamp" >= m.latest - INTERVAL 48 HOURS""", "telemetry"))
def relative_range(spark, sf):
    return series.last_hours(t.telemetry(spark, sf), STREAM, "timestamp", 48).select("charger_id", "arrival")


@query(sql("""SELECT charger_id, arrival FROM telemetry WHERE "timestamp" >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 14 DAYS""", "telemetry"))
def retention(spark, sf):
    return series.retained(t.telemetry(spark, sf), "timestamp", t.now(), 14).select("charger_id", "arrival")


@query(sql("""SELECT charger_id, epoch_us("timestamp") // 1000 AS ms, arg_max(value, arrival) AS value FROM dense GROUP BY 1, 2""", "dense"))
def normalized_series(spark, sf):
    return series.normalized(t.telemetry(spark, sf, dense=True), STREAM, "timestamp", "value", "arrival")


@query(sql("SELECT charger_id, list(value ORDER BY value)[CAST(ceil(0.95::DOUBLE * (count(*) - 1)) AS INTEGER) + 1] AS threshold FROM dense GROUP BY 1", "dense"))
def quantile_higher(spark, sf):
    return series.quantile_higher(t.telemetry(spark, sf, dense=True), STREAM, "value", 0.95)


@query(sql("SELECT charger_id, arrival, n, CASE WHEN n <= 1200 THEN 'collecting' WHEN n <= 1560 THEN 'calibrating' ELSE 'operational' END AS phase FROM (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY arrival) AS n FROM dense)", "dense"))
def phase_labels(spark, sf):
    return series.phases(t.telemetry(spark, sf, dense=True), STREAM, "arrival", 1200, 360).select("charger_id", "arrival", F.col("n").cast("long").alias("n"), "phase")


@query(sql("""SELECT charger_id, arrival, crossed, fired, sum(CASE WHEN fired THEN 1 ELSE 0 END) OVER (PARTITION BY charger_id ORDER BY arrival)::BIGINT AS alarm_count FROM (SELECT *, crossed AND NOT coalesce(lag(crossed) OVER (PARTITION BY charger_id ORDER BY arrival), false) AS fired FROM (SELECT *, value >= 80 AS crossed FROM dense))""", "dense"))
def alarm_edges(spark, sf):
    return series.alarm_edges(t.telemetry(spark, sf, dense=True), STREAM, "arrival", F.col("value") >= 80).select("charger_id", "arrival", "crossed", "fired", "alarm_count")


@query(sql("""SELECT d.arrival FROM dense d JOIN (SELECT charger_id, max("timestamp") AS latest FROM evidence WHERE alarm GROUP BY 1) m USING (charger_id) WHERE d."timestamp" > m.latest""", "evidence"))
def pending_points(spark, sf):
    return series.pending_points(t.telemetry(spark, sf, dense=True), t.evidence(spark, sf).where("alarm"), STREAM, "timestamp").select("arrival")


@query(sql("SELECT arrival, avg(round(value * 100)::BIGINT) OVER (PARTITION BY charger_id ORDER BY arrival ROWS 999 PRECEDING) AS moving_average FROM dense", "dense"))
def processing_average(spark, sf):
    cents = t.telemetry(spark, sf, dense=True).withColumn("cents", F.round(F.col("value") * 100).cast("long"))  # whole numbers: the same sum in any order
    return series.moving_average(cents, STREAM, "arrival", "cents").select("arrival", "moving_average")


# --- sequential tests ---

_P = """cal AS (SELECT charger_id, value FROM dense WHERE arrival % 5 = 0), pv AS MATERIALIZED (SELECT d.charger_id, d.arrival, ((SELECT count(*) FROM cal c WHERE c.charger_id = d.charger_id AND c.value >= d.value) + 1.0::DOUBLE) / ((SELECT count(*) FROM cal c WHERE c.charger_id = d.charger_id) + 1.0::DOUBLE) AS p FROM dense d WHERE d.arrival % 5 <> 0),
o AS MATERIALIZED (SELECT *, ln(0.5::DOUBLE) - 0.5::DOUBLE * ln(p) AS log_e, row_number() OVER (PARTITION BY charger_id ORDER BY arrival) AS n FROM pv)"""


def _sum_log(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1.0::DOUBLE + exp(least({a}, {b}) - greatest({a}, {b}))))"


#: The statistics by their recursions, a row after another, in logarithms: M' = M e; C' = max(C, 1) e; R' = (R + 1) e; A' = (A + 1 / (n (n + 1))) e, and the restarted martingale is A' + 1 / (n + 1).
_ST = f""", st AS (SELECT charger_id, arrival, n, log_e AS m, log_e AS cu, log_e AS sr, log_e - ln(2.0::DOUBLE) AS a, {_sum_log("log_e - ln(2.0::DOUBLE)", "-ln(2.0::DOUBLE)")} AS rm FROM o WHERE n = 1
UNION ALL SELECT charger_id, arrival, n, m, cu, sr, a, {_sum_log("a", "-ln(n + 1.0::DOUBLE)")} FROM (SELECT o.charger_id, o.arrival, o.n, st.m + log_e AS m, greatest(st.cu, 0.0::DOUBLE) + log_e AS cu, {_sum_log("st.sr", "0.0::DOUBLE")} + log_e AS sr, {_sum_log("st.a", "-ln(o.n * (o.n + 1.0::DOUBLE))")} + log_e AS a
FROM st JOIN o ON o.charger_id = st.charger_id AND o.n = st.n + 1))"""
_STREAMS = sql("", "dense").replace("WITH", "WITH RECURSIVE", 1) + ", " + _P


def _p_values(spark, sf):
    rows = t.telemetry(spark, sf, dense=True).select("charger_id", "arrival", "value")
    return sequential.p_values(rows.where("arrival % 5 <> 0"), rows.where("arrival % 5 = 0"), STREAM, "value").select("charger_id", "arrival", F.col("p_value").alias("p"))


def _stats(spark, sf):
    return sequential.power(_p_values(spark, sf), STREAM, "arrival", "p", 0.5)


def _sig(column: str):
    """Logarithm to six places: statistics span many magnitudes, and sums of thousands of terms depend on their order beyond."""
    return F.round(f"log_{column}", 6).alias(column)


@query(sql("", "dense") + ", " + _P + " SELECT charger_id, arrival, p FROM pv")
def conformal_pvalues(spark, sf):
    return _p_values(spark, sf)


@query(_STREAMS + _ST + " SELECT charger_id, arrival, round(m, 6) AS log_martingale FROM st")
def power_martingale(spark, sf):
    return _stats(spark, sf).select("charger_id", "arrival", F.round("log_martingale", 6).alias("log_martingale"))


@query(_STREAMS + _ST + " SELECT charger_id, arrival, round(cu, 6) AS cusum FROM st")
def cusum(spark, sf):
    return _stats(spark, sf).select("charger_id", "arrival", _sig("cusum"))


@query(_STREAMS + _ST + " SELECT charger_id, arrival, round(sr, 6) AS shiryaev_roberts FROM st")
def shiryaev_roberts(spark, sf):
    return _stats(spark, sf).select("charger_id", "arrival", _sig("shiryaev_roberts"))


@query(_STREAMS + _ST + " SELECT charger_id, arrival, round(rm, 6) AS restarted_martingale FROM st")
def restarted_martingale(spark, sf):
    return _stats(spark, sf).select("charger_id", "arrival", _sig("restarted_martingale"))


@query(sql("", "dense") + ", " + _P + """, g AS (SELECT charger_id, arrival, p, unnest([0.1::DOUBLE, 0.4::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS e FROM pv),
gs AS (SELECT *, sum(ln(e) + (e - 1.0::DOUBLE) * ln(p)) OVER (PARTITION BY charger_id, e ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS s FROM g),
gm AS (SELECT charger_id, arrival, max(s) AS top FROM gs GROUP BY 1, 2) SELECT charger_id, arrival, round(any_value(top) + ln(sum(exp(s - top)) / 4.0::DOUBLE), 6) AS log_martingale FROM gs JOIN gm USING (charger_id, arrival) GROUP BY 1, 2""")
def mixture_martingale(spark, sf):
    rows = sequential.mixture(_p_values(spark, sf), STREAM, "arrival", "p", sequential.epsilon_grid([0.1, 0.4, 0.7, 1.0]))
    return rows.select("charger_id", "arrival", F.round("log_martingale", 6).alias("log_martingale"))


#: The accounts are divided by their sum after each bet, whose logarithm is kept beside them.
_JUMP = """, j AS (SELECT charger_id, arrival, n, (1.5::DOUBLE - p) / 3.0::DOUBLE AS a, 1.0::DOUBLE / 3.0::DOUBLE AS b, (0.5::DOUBLE + p) / 3.0::DOUBLE AS c, 0.0::DOUBLE AS log_martingale FROM o WHERE n = 1
UNION ALL SELECT charger_id, arrival, n, x / (x + y + z), y / (x + y + z), z / (x + y + z), log_martingale + ln(x + y + z) FROM (SELECT o.charger_id, o.arrival, o.n, (0.99::DOUBLE * a + 0.01::DOUBLE / 3.0::DOUBLE) * (1.5::DOUBLE - p) AS x, 0.99::DOUBLE * b + 0.01::DOUBLE / 3.0::DOUBLE AS y, (0.99::DOUBLE * c + 0.01::DOUBLE / 3.0::DOUBLE) * (0.5::DOUBLE + p) AS z, log_martingale
FROM j JOIN o ON o.charger_id = j.charger_id AND o.n = j.n + 1))"""


@query(_STREAMS + _JUMP + " SELECT charger_id, arrival, round(log_martingale, 6) AS log_martingale FROM j")
def jumper_martingale(spark, sf):
    rows = sequential.jumper(_p_values(spark, sf), STREAM, "arrival", "p", 0.01)
    return rows.select("charger_id", "arrival", F.round("log_martingale", 6).alias("log_martingale"))


@query(sql("SELECT charger_id, arrival, ((n - 1) // 50)::BIGINT AS \"window\", ((n - 1) % 50 + 1)::BIGINT AS window_position, (n - 1) % 50 = 0 AND n > 1 AS window_reset FROM (SELECT *, row_number() OVER (PARTITION BY charger_id ORDER BY arrival) AS n FROM dense)", "dense"))
def horizon_reset(spark, sf):
    return sequential.horizon_windows(t.telemetry(spark, sf, dense=True), STREAM, "arrival", 50).select("charger_id", "arrival", "window", "window_position", "window_reset")


@query(_STREAMS + _ST + """, e AS (SELECT charger_id, arrival, n, unnest([struct_pack(k := 'r', v := rm, h := ln(1.2::DOUBLE)), struct_pack(k := 'c', v := cu, h := ln(2.0::DOUBLE))]) AS t FROM st),
x AS (SELECT charger_id, arrival, n, t.k AS k, t.v >= t.h AS crossed FROM e), f AS (SELECT *, crossed AND NOT coalesce(lag(crossed) OVER (PARTITION BY charger_id, k ORDER BY arrival), false) AS fired FROM x),
c AS (SELECT *, sum(CASE WHEN fired THEN 1 ELSE 0 END) OVER (PARTITION BY charger_id, k ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS so_far FROM f) SELECT charger_id, arrival, bool_or(fired) AS alarm, sum(so_far)::BIGINT AS alarm_count, max(n) AS tested_count FROM c GROUP BY 1, 2""")
def ensemble_alarm(spark, sf):
    return sequential.ensemble(_p_values(spark, sf), STREAM, "arrival", "p", [("r", 0.5, "restarted_martingale", 1.2), ("c", 0.5, "cusum", 2.0)])


@query(sql("", "dense") + ", " + _P + """ SELECT charger_id, arrival, CASE WHEN p > 0.02::DOUBLE THEN 'low' WHEN p <= 1.0::DOUBLE / 20.0::DOUBLE / 20.0::DOUBLE THEN 'critical' WHEN p <= 1.0::DOUBLE / 20.0::DOUBLE / 5.0::DOUBLE THEN 'high' ELSE 'medium' END AS severity, CASE WHEN p <= 0.001::DOUBLE THEN 'red' WHEN p <= 0.005::DOUBLE THEN 'orange' ELSE 'yellow' END AS colour FROM pv""")
def conformal_severity(spark, sf):
    p = F.col("p")
    return _p_values(spark, sf).select("charger_id", "arrival", scalars.conformal_severity(p, p <= 0.02, F.lit(20.0)).alias("severity"), scalars.p_value_class(p).alias("colour"))


@query(sql("""SELECT arrival, CASE WHEN value <= 100 THEN 'low' WHEN value >= 150 THEN 'high' ELSE 'medium' END AS severity FROM dense""", "dense"))
def adaptive_severity(spark, sf):
    v = F.col("value")
    return t.telemetry(spark, sf, dense=True).select("arrival", scalars.adaptive_severity(v, v > 100.0, F.lit(100.0)).alias("severity"))


@query(sql("""SELECT arrival, value * 10.0::DOUBLE <= 709.782712893384::DOUBLE AS has_value, value * 10.0::DOUBLE > 709.782712893384::DOUBLE AS is_infinite, value * 10.0::DOUBLE AS log_value FROM dense""", "dense"))
def tracker_payload(spark, sf):
    made = sequential.payload(F.col("value") * 10.0)
    return t.telemetry(spark, sf, dense=True).select("arrival", made["value"].isNotNull().alias("has_value"), made["is_infinite"].alias("is_infinite"), made["log_value"].alias("log_value"))


@query(sql(", x AS MATERIALIZED (SELECT charger_id, arrival, value / 100.0::DOUBLE AS x, row_number() OVER (PARTITION BY charger_id ORDER BY arrival) AS n FROM dense), f AS (SELECT charger_id, arrival, n, x, x AS mean FROM x WHERE n = 1 UNION ALL SELECT x.charger_id, x.arrival, x.n, x.x, f.mean + (x.x - f.mean) / least(x.n, 100)::DOUBLE FROM f JOIN x ON x.charger_id = f.charger_id AND x.n = f.n + 1) SELECT arrival, round(least(abs(x - mean) / (1.0::DOUBLE + 1e-8::DOUBLE), 1.0::DOUBLE), 9) AS score FROM f", "dense").replace("WITH", "WITH RECURSIVE", 1))
def fallback_score(spark, sf):
    rows = t.telemetry(spark, sf, dense=True).select("charger_id", "arrival", (F.col("value") / 100.0).alias("x"))
    scored = sequential.fallback_scores(rows, STREAM, "arrival", "x")
    return scored.select("arrival", F.round("score", 9).alias("score"))


@query(sql("SELECT DISTINCT n_name AS family FROM nation ORDER BY 1"))
def model_families(spark, sf):
    return t.table(spark, sf, "nation").select(F.col("n_name").alias("family")).distinct().orderBy("family")


# --- moving statistics ---

_WIN = "(PARTITION BY charger_id ORDER BY arrival ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
_STATISTICS = {
    "average": f"avg(value) OVER {_WIN}",
    "geometric_average": f"exp(avg(ln(CASE WHEN value > 0 THEN value END)) OVER {_WIN})",
    "harmonic_average": f"1.0::DOUBLE / avg(1.0::DOUBLE / CASE WHEN value <> 0 THEN value END) OVER {_WIN}",
    "median": f"quantile_cont(value, 0.5) OVER {_WIN}",
    "quantile": f"quantile_cont(value, 0.9) OVER {_WIN}",
    "interquartile_range": f"quantile_cont(value, 0.75) OVER {_WIN} - quantile_cont(value, 0.25) OVER {_WIN}",
    "variance": f"var_pop(value) OVER {_WIN}",
    "average_absolute_deviation": f"list_avg(list_transform(list(value) OVER {_WIN}, lambda v: abs(v - avg_)))",
    "skewness": f"(avg(pow(value, 3)) OVER {_WIN} - 3 * avg_ * avg(pow(value, 2)) OVER {_WIN} + 2 * pow(avg_, 3)) / pow(var_pop(value) OVER {_WIN}, 1.5)",
    "kurtosis": f"(avg(pow(value, 4)) OVER {_WIN} - 4 * avg_ * avg(pow(value, 3)) OVER {_WIN} + 6 * pow(avg_, 2) * avg(pow(value, 2)) OVER {_WIN} - 3 * pow(avg_, 4)) / pow(var_pop(value) OVER {_WIN}, 2) - 3",
}


def _moving(kind: str, expression: str) -> None:
    places = 5 if kind in ("skewness", "kurtosis") else 6
    body = sql(f"SELECT arrival, round(s, {places}) AS statistic, round(abs(value - s), {places}) AS score FROM (SELECT arrival, value, n_, {expression} AS s FROM (SELECT *, avg(value) OVER {_WIN} AS avg_, count(*) OVER {_WIN} AS n_ FROM dense)) WHERE n_ = 50", "dense")

    def run(spark, sf):
        rows = moving.moving_scores(t.telemetry(spark, sf, dense=True), STREAM, "arrival", "value", kind, 50, 0.9)
        return rows.where("statistic is not null").select("arrival", F.round("statistic", places).alias("statistic"), F.round("score", places).alias("score"))

    run.__name__ = f"moving_{kind}"
    query(body)(run)


for _kind, _expression in _STATISTICS.items():
    _moving(_kind, _expression)


def _pairs(spark, sf):
    return t.telemetry(spark, sf, dense=True).withColumn("other", F.col("value") * 0.5 + (F.col("arrival") % 17))


_PAIR = """SELECT arrival, round(abs(w - s), 9) AS score FROM (SELECT arrival, count(*) OVER {b} AS n_, {f}(value, other) OVER {b} AS s, {f}(value, other) OVER {a} AS w FROM (SELECT *, value * 0.5::DOUBLE + (arrival % 17) AS other FROM dense)) WHERE n_ = 50"""


@query(sql(_PAIR.format(f="corr", b=_WIN, a=_WIN.replace("1 PRECEDING)", "CURRENT ROW)")), "dense"))
def moving_correlation(spark, sf):
    return moving.moving_pair_scores(_pairs(spark, sf), STREAM, "arrival", "value", "other", "correlation_coefficient", 50).where("statistic is not null").select("arrival", F.round("score", 9).alias("score"))


@query(sql(_PAIR.format(f="covar_pop", b=_WIN, a=_WIN.replace("1 PRECEDING)", "CURRENT ROW)")), "dense"))
def moving_covariance(spark, sf):
    return moving.moving_pair_scores(_pairs(spark, sf), STREAM, "arrival", "value", "other", "covariance", 50).where("statistic is not null").select("arrival", F.round("score", 9).alias("score"))


@query(sql(f"""SELECT arrival, round(sqrt(greatest((dx * dx * c - 2.0::DOUBLE * dx * dy * b + dy * dy * a) / (a * c - b * b), 0.0::DOUBLE)), 5) AS score FROM (SELECT arrival, count(*) OVER {_WIN} AS n_, value - avg(value) OVER {_WIN} AS dx, other - avg(other) OVER {_WIN} AS dy, var_pop(value) OVER {_WIN} AS a, var_pop(other) OVER {_WIN} AS c, covar_pop(value, other) OVER {_WIN} AS b FROM (SELECT *, value * 0.5::DOUBLE + (arrival % 17) AS other FROM dense)) WHERE n_ = 50""", "dense"))
def moving_mahalanobis(spark, sf):
    return moving.mahalanobis_scores(_pairs(spark, sf), STREAM, "arrival", ["value", "other"], 50).where("score is not null").select("arrival", F.round("score", 5).alias("score"))


_PAST = "(PARTITION BY charger_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(sql(f"SELECT arrival, round(coalesce(CASE WHEN stddev_pop(value) OVER {_PAST} > 0 THEN (value - avg(value) OVER {_PAST}) / stddev_pop(value) OVER {_PAST} ELSE 0 END, 0), 7) AS scaled FROM dense", "dense"))
def standard_scaler(spark, sf):
    return moving.standard_scaled(t.telemetry(spark, sf, dense=True), STREAM, "arrival", "value").select("arrival", F.round("scaled", 7).alias("scaled"))


@query(sql(f"SELECT arrival, round(coalesce(CASE WHEN max(value) OVER {_PAST} > min(value) OVER {_PAST} THEN (value - min(value) OVER {_PAST}) / (max(value) OVER {_PAST} - min(value) OVER {_PAST}) ELSE 0 END, 0), 9) AS scaled FROM dense", "dense"))
def minmax_scaler(spark, sf):
    return moving.min_max_scaled(t.telemetry(spark, sf, dense=True), STREAM, "arrival", "value").select("arrival", F.round("scaled", 9).alias("scaled"))


@query(sql("SELECT arrival, round(0.5::DOUBLE * value - 2.0::DOUBLE * (arrival % 17), 9) AS first, round(value + (arrival % 17), 9) AS second FROM dense", "dense"))
def random_projection(spark, sf):
    rows = t.telemetry(spark, sf, dense=True).withColumn("other", (F.col("arrival") % 17).cast("double"))
    made = moving.projected(rows, ["value", "other"], [[0.5, -2.0], [1.0, 1.0]])
    return made.select("arrival", F.round(F.get("projected", F.lit(0)), 9).alias("first"), F.round(F.get("projected", F.lit(1)), 9).alias("second"))


# --- evidence, charts, health ---


@query(sql("""SELECT charger_id, "timestamp", sensor_set[1] AS telemetry_type, CASE strategy WHEN 'static_baseline' THEN 'ml_conformal_static_univariate' ELSE 'ml_adaptive_stream_univariate' END AS anomaly_type, coalesce(p_value, anomaly_score) AS anomaly_value, CASE strategy WHEN 'static_baseline' THEN 'conformal_pvalue' ELSE 'anomaly_score' END AS value_type FROM evidence WHERE alarm AND sequence_number >= 1""", "evidence"))
def evidence_rows(spark, sf):
    rows = ev.valid_evidence(ev.complete_inputs(t.evidence(spark, sf)))
    return ev.anomaly_rows(rows).drop("sensor_set")


@query(sql("""SELECT service_id, tracker_id, "timestamp", sequence_number, value, last_value(threshold) OVER (PARTITION BY service_id, tracker_id ORDER BY "timestamp", sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS threshold FROM (SELECT service_id, sequence_number, "timestamp", CASE WHEN statistic_value IS NULL THEN 'primary' ELSE 'power' END AS tracker_id, coalesce(statistic_value, restarted_martingale) AS value, CASE WHEN statistic_value IS NULL THEN threshold ELSE tracker_threshold END AS threshold FROM evidence WHERE strategy = 'static_baseline') QUALIFY value > 0""", "evidence").replace("sequence_number, value, last_value", "value, last_value"))
def tracker_series(spark, sf):
    return charts.tracker_series(t.evidence(spark, sf), []).select("service_id", "tracker_id", "timestamp", "value", "threshold")


@query(sql("""SELECT service_id, "timestamp", anomaly_score AS value, last_value(threshold) OVER (PARTITION BY service_id ORDER BY "timestamp", sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS threshold FROM evidence WHERE strategy = 'adaptive_stream'""", "evidence"))
def adaptive_series(spark, sf):
    return charts.adaptive_series(t.evidence(spark, sf), [])


@query(sql("""SELECT service_id, greatest(1.0::DOUBLE, max(anomaly_score), arg_max(threshold, struct_pack(a := "timestamp", b := sequence_number))) AS top FROM evidence WHERE strategy = 'adaptive_stream' GROUP BY 1""", "evidence"))
def pane_top(spark, sf):
    return charts.pane_top(charts.adaptive_series(t.evidence(spark, sf), []), ["service_id"])


@query(sql("SELECT arrival, CASE anomaly_type WHEN 'ml_conformal_static_multivariate' THEN 'purple/diamond' WHEN 'ml_adaptive_stream_univariate' THEN 'orange/triangle' ELSE 'red/circle' END AS style FROM anomalies", "anomalies"))
def marker_styles(spark, sf):
    return t.anomalies(spark, sf).select("arrival", charts.marker_style(F.col("anomaly_type")).alias("style"))


_MODEL = """, ends AS (SELECT charger_id, max("timestamp") AS latest FROM evidence GROUP BY 1), times AS (SELECT DISTINCT charger_id, "timestamp" FROM dense),
tr AS (SELECT charger_id, service_id, "timestamp", sequence_number, CASE WHEN statistic_value IS NULL THEN 'primary' ELSE 'power' END AS tracker_id, coalesce(statistic_value, restarted_martingale) AS value, CASE WHEN statistic_value IS NULL THEN threshold ELSE tracker_threshold END AS threshold FROM evidence WHERE strategy = 'static_baseline'),
tl AS (SELECT *, last_value(threshold) OVER (PARTITION BY charger_id, service_id, tracker_id ORDER BY "timestamp", sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM tr),
al AS (SELECT *, last_value(threshold) OVER (PARTITION BY charger_id, service_id ORDER BY "timestamp", sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM evidence WHERE strategy = 'adaptive_stream'),
shown AS (SELECT charger_id, 'telemetry' AS part, NULL::VARCHAR AS series, "timestamp" AS time, NULL::TIMESTAMP AS until, value, NULL::DOUBLE AS threshold, NULL::VARCHAR AS label FROM dense
UNION ALL SELECT charger_id, 'tracker', service_id || '/' || tracker_id, "timestamp", NULL, value, latest, NULL FROM tl SEMI JOIN times USING (charger_id, "timestamp") WHERE value > 0
UNION ALL SELECT charger_id, 'adaptive', service_id, "timestamp", NULL, anomaly_score, latest, NULL FROM al SEMI JOIN times USING (charger_id, "timestamp")),
zoned AS (SELECT *, sum(new) OVER (PARTITION BY charger_id ORDER BY "timestamp" RANGE UNBOUNDED PRECEDING) AS zone FROM (SELECT *, CASE WHEN epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY charger_id ORDER BY "timestamp")) <= 300000000 THEN 0 ELSE 1 END AS new FROM dense_anomalies)),
marked AS (SELECT d.charger_id, d.arrival, d."timestamp", d.value, arg_min(a.anomaly_type, a.arrival) AS kind FROM dense d JOIN dense_anomalies a ON a.charger_id = d.charger_id AND abs(epoch_us(d."timestamp") - epoch_us(a."timestamp")) <= 5000000 GROUP BY 1, 2, 3, 4)
SELECT * FROM shown UNION ALL SELECT charger_id, 'extent', NULL, min(time), max(time), NULL, NULL, NULL FROM shown GROUP BY 1
UNION ALL SELECT charger_id, 'pending', NULL, "timestamp", NULL, value, NULL, NULL FROM dense JOIN ends USING (charger_id) WHERE "timestamp" > latest
UNION ALL SELECT charger_id, 'zone', NULL, min("timestamp"), max("timestamp"), count(*)::DOUBLE, NULL, NULL FROM zoned GROUP BY charger_id, zone
UNION ALL SELECT charger_id, 'marker', NULL, "timestamp", NULL, value, NULL, CASE kind WHEN 'ml_conformal_static_multivariate' THEN 'purple/diamond' WHEN 'ml_adaptive_stream_univariate' THEN 'orange/triangle' WHEN 'ml_adaptive_stream_multivariate' THEN 'blue/square' ELSE 'red/circle' END FROM marked"""


@query(sql(_MODEL, "dense_anomalies", "evidence"))
def chart_model(spark, sf):
    rows = t.telemetry(spark, sf, dense=True).select("charger_id", "timestamp", "value", "arrival")
    return charts.chart_model(rows, t.evidence(spark, sf), t.anomalies(spark, sf, dense=True).select("charger_id", "timestamp", "anomaly_type", "arrival"))


@query(sql("""SELECT service_id, sequence_number FROM evidence WHERE type = 'view' AND "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' AND service_id = 'svc-2'""", "evidence"))
def sensor_evidence(spark, sf):
    ends = [F.lit(f"2024-01-{d} 00:00:00").cast(t.NTZ) for d in ("05", "12")]
    return charts.for_sensor(t.evidence(spark, sf), "view", *ends, service_id="svc-2").select("service_id", "sequence_number")


@query("""SELECT o_orderpriority AS writer, count(*) AS batches, count(*) FILTER (WHERE o_orderstatus <> 'P') AS batches_ok, round(count(*) FILTER (WHERE o_orderstatus <> 'P') * 100.0::DOUBLE / count(*), 9) AS success_rate, round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 100000.0::DOUBLE END), 7) AS avg_latency,
CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'P') * 100.0::DOUBLE / count(*) < 95 OR avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 100000.0::DOUBLE END) > 5 OR max(o_orderkey % 12) > 10 THEN 'unhealthy' WHEN count(*) FILTER (WHERE o_orderstatus <> 'P') * 100.0::DOUBLE / count(*) < 98 OR avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 100000.0::DOUBLE END) > 2 OR max(o_orderkey % 12) > 5 THEN 'degraded' ELSE 'healthy' END AS health FROM orders GROUP BY 1""")
def writer_health(spark, sf):
    rows = t.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("writer"), (F.col("o_orderstatus") != "P").alias("ok"), (F.col("o_totalprice") / 100000.0).alias("latency_s"), F.lit(100).alias("records"), (F.col("o_orderkey") % 12).alias("in_flight"), F.col("o_orderdate").alias("at"))
    m = fleet.writer_metrics(rows, ["writer"])
    return m.select("writer", "batches", "batches_ok", F.round("success_rate", 9).alias("success_rate"), F.round("avg_latency", 7).alias("avg_latency"), fleet.health(F.col("success_rate"), F.col("avg_latency"), F.col("in_flight")).alias("health"))


@query("""SELECT l_returnflag AS destination, count(*) AS messages, count(*) FILTER (WHERE l_linestatus = 'O') AS delivered, round(count(*) FILTER (WHERE l_linestatus = 'O') * 100.0::DOUBLE / count(*), 9) AS success_rate, round(avg(l_discount), 9) AS avg_seconds FROM lineitem GROUP BY 1""")
def destination_metrics(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("destination"), (F.col("l_linestatus") == "O").alias("ok"), F.col("l_discount").alias("seconds"))
    return fleet.destination_metrics(rows).select("destination", "messages", "delivered", F.round("success_rate", 9).alias("success_rate"), F.round("avg_seconds", 9).alias("avg_seconds"))


@query(sql("SELECT charger_id, count(*) AS received, count(*) FILTER (WHERE type <> 'signup') AS processed, count(*) FILTER (WHERE value > 120) AS anomalies, count(*) FILTER (WHERE type = 'error') AS errors, count(*) FILTER (WHERE value > 120)::DOUBLE / greatest(count(*) FILTER (WHERE type <> 'signup'), 1) AS anomaly_rate, count(*) FILTER (WHERE type = 'error')::DOUBLE / greatest(count(*), 1) AS error_rate FROM dense GROUP BY 1", "dense"))
def processor_metrics(spark, sf):
    rows = t.telemetry(spark, sf, dense=True).select("charger_id", (F.col("type") != "signup").alias("processed"), (F.col("value") > 120).alias("anomaly"), (F.col("type") == "error").alias("error"))
    return fleet.processor_metrics(rows, STREAM)


@query("""SELECT s_suppkey AS service, array_to_string(list_filter([CASE WHEN s_suppkey % 5 = 0 THEN 'mqtt_disconnected' END, CASE WHEN (s_suppkey % 10) / 50.0::DOUBLE > 0.1 THEN 'high_error_rate' END, CASE WHEN (s_suppkey % 4) * 300 > 900 THEN 'high_memory_usage' END], lambda x: x IS NOT NULL), ',') AS alerts,
CASE WHEN s_suppkey % 5 = 0 THEN 'failed' WHEN (s_suppkey % 10) / 50.0::DOUBLE > 0.1 OR (s_suppkey % 4) * 300 > 900 THEN 'degraded' ELSE 'healthy' END AS status FROM supplier""")
def service_alerts(spark, sf):
    n = F.col("s_suppkey")
    alerts = fleet.active_alerts(n % 5 != 0, (n % 10) / 50.0, (n % 4) * 300.0, F.lit(1000.0), F.lit(0.0), F.lit(False))
    rows = t.table(spark, sf, "supplier").select(n.alias("service"), alerts.alias("a"))
    return rows.select("service", F.array_join("a", ",").alias("alerts"), fleet.service_status(F.col("a"), F.lit(True)).alias("status"))


@query("""SELECT s_suppkey AS service, CASE WHEN s_suppkey % 9 = 0 THEN 'error' WHEN s_suppkey % 7 = 0 THEN 'waiting_for_data' WHEN s_suppkey % 6 = 0 THEN 'aligning' WHEN s_suppkey * 20 < 1200 THEN 'collecting' WHEN s_suppkey * 20 < 1560 THEN 'calibrating' ELSE 'operational' END AS stage, CASE WHEN s_suppkey % 9 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 6 = 0 OR s_suppkey * 20 >= 1560 THEN NULL WHEN s_suppkey * 20 < 1200 THEN s_suppkey * 20 ELSE s_suppkey * 20 - 1200 END AS current FROM supplier""")
def operational_stages(spark, sf):
    n = F.col("s_suppkey")
    stage = fleet.operational_stage(F.lit("running"), F.when(n % 7 == 0, 0).otherwise(5), n % 6 != 0, n * 20, F.lit(1200), F.lit(360), n % 9 == 0)
    return t.table(spark, sf, "supplier").select(n.alias("service"), stage["stage"].alias("stage"), stage["current"].alias("current"))


@query(sql("SELECT id, CASE number % 4 WHEN 0 THEN 'stopped' WHEN 1 THEN 'error' ELSE 'operational' END AS stage, number % 4 > 1 AND epoch(TIMESTAMP '2024-01-01 01:00:00') - epoch(created_at) > 120 AS is_stale FROM services", "services"))
def stage_overrides(spark, sf):
    workload = F.element_at(F.array(*map(F.lit, ("exited", "dead", "running", "running"))), (F.col("number") % 4 + 1).cast("int"))
    made = fleet.effective_stage(F.lit("operational"), workload, F.col("created_at"), F.lit("2024-01-01 01:00:00").cast(t.NTZ))
    return t.services(spark, sf).select("id", made["stage"].alias("stage"), made["is_stale"].alias("is_stale"))


@query("""SELECT l_suppkey AS supplier, l_returnflag AS flag, zone, min(l_shipdate) AS zone_start, max(l_shipdate) AS zone_end, count(*) AS members FROM (SELECT *, sum(new) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate RANGE UNBOUNDED PRECEDING)::BIGINT AS zone FROM (SELECT *, CASE WHEN epoch_us(l_shipdate) - epoch_us(lag(l_shipdate) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate)) <= 259200000000 THEN 0 ELSE 1 END AS new FROM lineitem)) GROUP BY 1, 2, 3""")
def bulk_zones(spark, sf):
    """Zones over the largest table."""
    rows = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"), "l_shipdate")
    return series.zones(rows, ["supplier", "flag"], "l_shipdate", 259200.0)
