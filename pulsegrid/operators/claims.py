"""Claims of services on topics: which requests get what they ask for, and what becomes of the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.matching import overlapping
from pulsegrid.shared import cut


def fingerprint(topics: Column, settings: Column) -> Column:
    """A digest of what a service would do: its topics, each once, in order, and its settings (map<string,string>) by name, whatever order they are given in."""
    entries = F.transform(F.array_sort(F.map_keys(settings)), lambda k: F.struct(k.alias("name"), F.element_at(settings, k).alias("value")))
    return F.sha2(F.to_json(F.struct(F.array_sort(F.array_distinct(topics)).alias("topics"), entries.alias("settings"))), 256)


def arbitrate(requests: DataFrame) -> DataFrame:
    """request_id, verdict, granted_id of requests (request_id, at, service, topics, settings), as if they came one after another in order of (at, request_id).

    A request is granted if none of its topic filters overlaps one of a granted request: its verdict is `create`. Others name the earliest granted request that stands in their way: `reuse` if its fingerprint is theirs, `replace` if it is of
    the same service, else `conflict`. A request without topics is granted. request_id tells rows apart.

    In rounds: of each distinct filter the earliest open request leads it; a request that is the earliest of the leaders of all filters that overlap one of its own is granted, and open requests that overlap a granted one are
    refused. Distinct filters meet, not requests, so many requests for one filter make no pairs. Each round grants the earliest open request at least.
    """
    own = requests.select("request_id", "at", "service", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), fingerprint(F.coalesce("topics", F.array().cast("array<string>")), F.coalesce("settings", F.create_map().cast("map<string,string>"))).alias("mark"))
    own = cut(own)
    asked = cut(own.select(F.struct("at", "request_id").alias("turn"), F.explode(F.array_distinct("topics")).alias("filter")))
    filters = asked.select("filter").distinct()
    near = cut(overlapping(filters, filters.select(F.col("filter").alias("other")), "filter", "other").select("filter", "other"))
    verdicts = [own.where(F.size("topics") == 0).select(F.struct("at", "request_id").alias("turn"), F.struct("at", "request_id").alias("by"))]
    left = asked
    while left.take(1):
        first = left.groupBy(F.col("filter").alias("other")).agg(F.min("turn").alias("lead"))
        ahead = near.join(first, "other").groupBy("filter").agg(F.min("lead").alias("lead"))
        granted = cut(left.join(ahead, "filter").groupBy("turn").agg(F.min("lead").alias("lead")).where("lead = turn").select("turn"))
        taken = left.join(granted, "turn").groupBy(F.col("filter").alias("other")).agg(F.min("turn").alias("by"))
        closed = near.join(taken, "other").groupBy("filter").agg(F.min("by").alias("by"))
        # a granted request overlaps its own filters only: it stands in its own way
        decided = cut(left.join(closed, "filter").groupBy("turn").agg(F.min("by").alias("by")))
        verdicts.append(decided)
        left = cut(left.join(decided.select("turn"), "turn", "left_anti"))
    every = reduce(DataFrame.unionByName, verdicts)
    winners = own.select(F.col("request_id").alias("granted_id"), F.col("service").alias("_service"), F.col("mark").alias("_mark"))
    joined = every.select(F.col("turn.request_id").alias("request_id"), F.col("by.request_id").alias("granted_id")).join(own.drop("at", "topics"), "request_id").join(winners, "granted_id")
    verdict = F.when(F.col("request_id") == F.col("granted_id"), "create").when(F.col("mark") == F.col("_mark"), "reuse").when(F.col("service").eqNullSafe(F.col("_service")), "replace").otherwise("conflict")
    return joined.select("request_id", verdict.alias("verdict"), "granted_id")
