"""Connected components by alternating star contraction, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.support import cut, narrow


def _hung(edges: DataFrame, rows: int) -> DataFrame:
    """Each vertex's larger neighbours are hung on the vertex's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return narrow(both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b"), 2 * rows)


def _gathered(edges: DataFrame, rows: int) -> DataFrame:
    """Each vertex and its smaller neighbours are hung on the smallest of them. edges may repeat."""
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    moved = edges.join(low, "b").where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return narrow(low.select(F.col("low").alias("a"), "b").unionByName(moved), 2 * rows)


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """links (a, b) of ids -> (id, component): every id on a link with the smallest id that it reaches.

    Null ids and links of an id to itself are left out. Each round costs two joins on ids and is cut off from
    the last; the number of rounds grows with the logarithm of the longest chain. No vertex's neighbours are
    gathered in one row, so a hub only makes a hot join key, which adaptive execution splits. Rounds over few links run in few tasks;
    most: a bound of the number of links, if one is known.
    """
    plain = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = cut((plain if most is None else narrow(plain, most)).distinct())
    state = None
    while True:
        last, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = narrow(edges, state[0])
        if state == last or not state[0]:
            break
        edges = cut(narrow(_gathered(_hung(edges, state[0]), state[0]).distinct(), state[0]))
    roots = edges.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("component"))
    return narrow(edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id").unionByName(roots), 2 * state[0])
