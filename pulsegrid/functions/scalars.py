"""Small column functions: names, texts, redaction, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_string(text: Column) -> Column:
    """URL-decoded, without slashes; null for an empty text."""
    return F.when(F.length(text) > 0, F.regexp_replace(F.try_url_decode(text), "/", ""))


def category(telemetry_type: Column) -> Column:
    low = F.lower(telemetry_type)
    return F.when(low.contains("cpu") | low.contains("thermal"), "cpu").when(low.startswith("system"), "system").when(low.startswith("controller"), "controller").otherwise("other")


def display_name(value: Column) -> Column:
    """A space before each capital, the first letter a capital, trimmed."""
    spaced = F.regexp_replace(value, "([A-Z])", " $1")
    return F.trim(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 2147483647)))


def last_seen(last_message: Column, seen: Column) -> Column:
    return F.coalesce(last_message.cast("string"), seen, F.lit(""))


def iso_utc(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def created_or(created: Column, timestamp: Column) -> Column:
    """When a row was stored, as text; older rows without it were stored at their event time."""
    return iso_utc(F.coalesce(created, timestamp))


def p_value_class(p: Column) -> Column:
    """Colour of a p-value on charts."""
    return F.when(p <= 0.001, "red").when(p <= 0.005, "orange").otherwise("yellow")


def conformal_severity(p: Column, alarm: Column, threshold: Column) -> Column:
    """threshold is the alarm's martingale level; its inverse is the p-value it corresponds to."""
    level = 1.0 / threshold
    return F.when(~alarm, "low").when(p <= level / 20.0, "critical").when(p <= level / 5.0, "high").otherwise("medium")


def adaptive_severity(score: Column, alarm: Column, threshold: Column) -> Column:
    return F.when(~alarm, "low").when(score >= threshold * 1.5, "high").otherwise("medium")


def redact(text: Column) -> Column:
    """E-mail addresses, the last part of IPv4 addresses, all but four groups of IPv6 addresses; texts over 120 characters are cut."""
    out = F.regexp_replace(text, r"\b([A-Za-z0-9])[A-Za-z0-9._%+-]*?([A-Za-z0-9])?@([A-Za-z0-9])[A-Za-z0-9.-]*?([A-Za-z0-9])?(\.[A-Za-z]{2,})(?![A-Za-z0-9.-])", "$1***$2@$3***$4$5")
    out = F.regexp_replace(out, r"\b(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}\b", "$1.x")
    out = F.regexp_replace(out, r"\b((?:[0-9a-fA-F]{1,4}:){4})(?:[0-9a-fA-F]{0,4}:){0,3}[0-9a-fA-F]{0,4}\b", "$1x")
    return F.when(F.length(out) > 120, F.concat(F.substring(out, 1, 117), F.lit("..."))).otherwise(out)


def token_hash(token: Column) -> Column:
    return F.substring(F.sha2(token, 256), 1, 10)


def anomaly_id(charger_id: Column, timestamp: Column, telemetry_type: Column) -> Column:
    """A reproducible identity of an anomaly's key."""
    return F.sha2(F.concat_ws("|", charger_id, F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss.SSSSSS"), telemetry_type), 256)


def compact_number(value: Column) -> Column:
    """Four significant digits without trailing zeros, all digits before the point; with two digits and an exponent below 0.001 and from a million on."""
    size = F.abs(value)
    places = F.greatest(F.lit(0), 3 - F.floor(F.log10(size))).cast("int")
    plain = F.element_at(F.array(*[F.format_string(f"%.{k}f", value) for k in range(7)]), F.least(places, F.lit(6)) + 1)
    plain = F.when(places > 0, F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    power = F.regexp_replace(F.format_string("%.2e", value), r"e([+-])0+(?=\d)", "e$1")
    return F.when(F.isnan(value) | (size == float("inf")), value.cast("string")).when(value == 0, "0").when((size < 0.001) | (size >= 1000000.0), power).otherwise(plain)
