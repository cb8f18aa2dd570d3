"""Topics of device messages: parsing, sensor keys, filters and their overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed format: device/evCharger/<charger>/<type of one or more levels>.
TOPIC_REGEX = r"^device/evCharger/(?P<charger_id>[^/]+)/(?P<telemetry_type>.+)$"
STRATEGIES = ("full_hierarchy", "top_level", "leaf")


def _java_regex(regex: str) -> str:
    """A regex with Python's named groups, checked to have both, in Java's syntax."""
    groups = re.compile(regex).groupindex
    if not {"charger_id", "telemetry_type"} <= set(groups):
        raise ValueError("the topic regex needs the groups charger_id and telemetry_type")
    return regex.replace("(?P<charger_id>", "(?<chargerId>").replace("(?P<telemetry_type>", "(?<telemetryType>")


def parse_topic(topic: Column, regex: str = TOPIC_REGEX) -> Column:
    """struct(charger_id, telemetry_type), or null where the topic has another shape, an empty level, or a wildcard in either part."""
    java, groups = _java_regex(regex), re.compile(regex).groupindex
    charger, kind = (F.trim(F.regexp_extract(topic, java, groups[g])) for g in ("charger_id", "telemetry_type"))
    sound = topic.rlike(java) & (charger != "") & ~charger.rlike("[+#]") & F.forall(F.split(kind, "/"), lambda x: (x != "") & ~x.rlike("[+#]"))
    return F.when(sound, F.struct(charger.alias("charger_id"), kind.alias("telemetry_type")))


def sensor_key(telemetry_type: Column, strategy: str = "full_hierarchy") -> Column:
    """The sensor that a type stands for: all its levels, the first, or the last; empty levels don't count."""
    levels = F.filter(F.split(telemetry_type, "/"), lambda x: x != "")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    return F.array_join(levels, "/") if strategy == "full_hierarchy" else F.try_element_at(levels, F.lit(1 if strategy == "top_level" else -1))


def required_sensors(topics: Iterable[str], strategy: str = "full_hierarchy", lenient: bool = False) -> list[str]:
    """Sorted sensor keys of concrete topics. Wildcards are refused, or skipped if lenient; two topics with one key are refused."""
    found: dict[str, str] = {}
    for topic in dict.fromkeys(topics):
        match = re.match(TOPIC_REGEX, topic.strip())
        levels = [x for x in match["telemetry_type"].split("/") if x] if match else []
        if not levels or any(c in topic for c in "+#"):
            if lenient:
                continue
            raise ValueError(f"not a concrete topic: {topic}")
        key = {"full_hierarchy": "/".join(levels), "top_level": levels[0], "leaf": levels[-1]}[strategy]
        if key in found and not lenient:
            raise ValueError(f"{topic} and {found[key]} have the same sensor key {key}")
        found[key] = topic
    return sorted(found)


def topic_matches(topic: Column, pattern: str) -> Column:
    """Whether a concrete topic matches a filter: + is one level, a last # any number of levels, none included."""
    parts = pattern.split("/")
    tail = parts[-1] == "#"
    body = "/".join("[^/]+" if p == "+" else re.escape(p) for p in (parts[:-1] if tail else parts))
    regex = ("^.*$" if not body else f"^{body}(/.*)?$") if tail else f"^{body}$"
    return topic.rlike(regex)


def filters_overlap(left: Column, right: Column) -> Column:
    """Whether some topic matches both filters. The first level at which both are fixed and differ rules it out; so does a filter that ends
    before the other, unless the other goes on with #."""
    a, b = F.split(left, "/"), F.split(right, "/")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, F.lit("")).alias("x"), F.coalesce(y, F.lit("")).alias("y"), x.isNull().alias("no_x"), y.isNull().alias("no_y")))
    # 1: they meet whatever follows; 0: they can't meet
    verdicts = F.transform(pairs, lambda p: F.when((p["x"] == "#") | (p["y"] == "#"), 1).when(p["no_x"] | p["no_y"], 0).when((p["x"] == "+") | (p["y"] == "+") | (p["x"] == p["y"]), F.lit(None).cast("int")).otherwise(0))
    return F.coalesce(F.try_element_at(F.array_compact(verdicts), F.lit(1)), F.lit(1)) == 1


def overlap(left: str, right: str) -> bool:
    """The same for two filters at hand."""
    a, b = left.split("/"), right.split("/")
    for x, y in zip(a, b):
        if "#" in (x, y):
            return True
        if x != y and "+" not in (x, y):
            return False
    longer = a if len(a) > len(b) else b
    return len(a) == len(b) or longer[min(len(a), len(b))] == "#"


def validate_filter(pattern: str, *, root_wildcard: bool = False) -> str:
    """The trimmed filter if it is well formed, else ValueError: at most 65535 bytes, no NUL, no empty level, + and # alone in their level, # last."""
    pattern = pattern.strip()
    if not pattern or len(pattern.encode()) > 65535 or "\0" in pattern:
        raise ValueError("a filter has 1 to 65535 bytes and no NUL")
    levels = pattern.split("/")
    if any(not x for x in levels):
        raise ValueError("a filter has no empty level")
    for k, x in enumerate(levels):
        if ("#" in x and (x != "#" or k < len(levels) - 1)) or ("+" in x and x != "+"):
            raise ValueError("+ and # stand alone in their level, # in the last")
    if levels == ["#"] and not root_wildcard:
        raise ValueError("a filter for all topics is not allowed")
    return pattern


def sound_filter(pattern: Column) -> Column:
    """The rules of `validate_filter` for a column of filters: whether each is well formed; null counts as not."""
    text = F.trim(pattern)
    levels = F.split(text, "/")
    last = F.size(levels) - 1
    level = F.forall(F.transform(levels, lambda x, k: (x != "") & (~x.contains("+") | (x == "+")) & (~x.contains("#") | ((x == "#") & (k == last)))), lambda sound: sound)
    return F.coalesce((text != "") & (F.octet_length(text) <= 65535) & ~text.contains("\0") & level & (text != "#"), F.lit(False))


def validate_device_filter(pattern: str) -> str:
    """A filter of the device namespace: device/#, or device/evCharger with two levels or more after it, wildcards or not."""
    pattern = validate_filter(pattern)
    levels = pattern.split("/")
    if pattern != "device/#" and (len(levels) < 4 or levels[:2] != ["device", "evCharger"]):
        raise ValueError("a filter starts with device/evCharger/ and goes on by a charger and a type, or is device/#")
    return pattern


def device_filter(pattern: Column) -> Column:
    """The rules of `validate_device_filter` for a column of filters; null counts as not."""
    text = F.trim(pattern)
    levels = F.split(text, "/")
    return sound_filter(pattern) & ((text == "device/#") | ((F.size(levels) >= 4) & (F.get(levels, F.lit(0)) == "device") & (F.get(levels, F.lit(1)) == "evCharger")))


def validate_charger_filter(pattern: str, *, concrete: bool = False) -> str:
    """A filter of the device namespace for one charger; concrete: without wildcards."""
    pattern = validate_device_filter(pattern)
    levels = pattern.split("/")
    if len(levels) < 4 or levels[2] in ("+", "#"):
        raise ValueError("a filter names one charger")
    if concrete and any(x in ("+", "#") for x in levels):
        raise ValueError("wildcards are not allowed here")
    return pattern


def distinct_trimmed(values: Column) -> Column:
    """Trimmed non-empty strings of an array, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))
