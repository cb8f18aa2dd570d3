"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target is spread over its documents in proportion to their importance, up to the most copies that one may have. Each document first gets the whole copies that are certain. The fraction of a copy that remains is its inclusion chance p in
the source's sample: the documents are ranked by the ratio of random odds u / (1 - u) to inclusion odds p / (1 - p), and those with the smallest ratios are taken until
their words fill what the source still lacks. The cut in the ranking is found by two histograms of the ratio, so a source with a third of all
rows is never sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.support import cut, partitions

WEIGHTS = (3.0, 1.0, 2.0)
_BINS = 4096
#: Importance is rounded to quarter powers of two, within these powers, so that a source has a bounded number of classes of it.
_POWERS = 32


def n_words(text: Column) -> Column:
    """Runs of anything but space and \\x09-\\x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_size(size: Column) -> Column:
    """Importance by number of words: texts under 50 words a step of sqrt(2) below, texts of 500 and more one above the others."""
    return F.when(size < 50, F.lit(2.0**-0.5)).when(size < 500, F.lit(1.0)).otherwise(F.lit(2.0**0.5))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, place): sources by code point, null last, places from 0. Sorted by ranges, so no task gets all sources."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    key = [F.col("source").isNull(), F.col("source")]
    parts = totals.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key)
    parts = cut(parts.withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return parts.join(before, "part").select("source", "source_size", (F.col("within") + F.col("before")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = 150.0, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): `percent` of all words shared by weight (repeating over the sources in order); no target goes beyond
    `most` times its source's size, and what is cut off is shared again by weight. The driver gets four sums a round."""
    ranked = ranked_sources(sizes)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    shares = cut(ranked.select("source", "source_size", weight.alias("weight")))
    full = F.col("source_size") * F.lit(most)
    total = float(shares.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, stopped = 0.0, -1
    while True:
        free = full > F.col("weight") * F.lit(level)
        row = shares.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, full)).alias("held"), F.count_if(~free).alias("n")).first()
        if row.n == stopped or not row.w:
            break
        stopped, level = row.n, (total - float(row.held or 0)) / row.w
    # when every source is full, what is left has no taker
    return shares.select("source", "source_size", F.least(full, F.col("weight") * F.lit(level) if level else full).cast("double").alias("target"))


def _per_source(rows: DataFrame, table: DataFrame, ways: int = 64) -> DataFrame:
    """rows with the columns of their source's row of table (source, ...). Rows of a source go to `ways` places, each with a copy of the source's row, so a
    source with a third of all rows is no single task."""
    names = [c for c in table.columns if c != "source"]
    copies = table.select(F.col("source").alias("_source"), *names, F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("_way"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(ways)).cast("int"))
    joined = salted.join(copies, (F.col("_salt") == F.col("_way")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.drop("_source", "_way", "_salt")


def _until(parts: DataFrame, by: list[str]) -> DataFrame:
    """Adds how many words the smaller bins of the same group hold."""
    order = Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("below", F.coalesce(F.sum("words").over(order), F.lit(0)))


def _rates(sizes: DataFrame, shares: DataFrame, most: float) -> DataFrame:
    """(source, source_size, target, rate): the rate at which min(most, rate * importance) copies of each document have the target's words; null if all need `most`."""
    classes = sizes.where("importance > 0").groupBy("source", "importance").agg(F.sum("size").alias("words"))
    classes = classes.join(shares.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("source").orderBy(F.desc("importance"))
    full = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("importance")).over(order.rowsBetween(0, Window.unboundedFollowing))
    rates = classes.select("source", "importance", F.when(rest > 0, (F.col("target") - F.lit(most) * full) / rest).alias("rate"))
    rates = rates.where(F.col("rate") * F.col("importance") <= most * (1 + 1e-12)).groupBy(F.col("source").alias("s")).agg(F.max_by("rate", "importance").alias("rate"))
    return shares.join(rates, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "rate")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = 150.0, most: float = 2.0, seed: int = 17, importance: str | Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source; others are ignored).

    `importance` names a column of numbers, or makes one from the number of words: the expected copies of a document are in proportion to it (rounded to quarter powers of two), within `most`; without one all of a source are
    alike. Documents of no importance are not taken. Sources with the same text of name are one, null is a source of its own. Texts without words have size 0 and are taken as often as others of their
    source and importance. Repeated rows are ranked each: rows equal in doc_id and text draw the same number and are told apart by their place in their partition. The same table gives the same result on each run but for such ties.
    A text of any length is counted whole; one longer than its source's target is taken or not as a whole. An empty table gives no rows.
    """
    size = n_words(F.col("text").cast("string"))
    value = F.lit(1.0) if importance is None else F.col(importance).cast("double") if isinstance(importance, str) else importance(size)
    steps = F.greatest(F.least(F.round(F.log2(value) * 4), F.lit(4.0 * _POWERS)), F.lit(-4.0 * _POWERS))
    classed = F.when((value > 0) & ~F.isnan(value), F.pow(F.lit(2.0), steps / 4)).otherwise(0.0)
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("source").cast("string").alias("source"), size.alias("size"), classed.alias("importance")))
    per_source = _rates(sizes, targets(sizes, weights, percent, most), most)
    rows = _per_source(sizes, per_source)
    wanted = F.when(F.col("importance") > 0, F.least(F.lit(float(most)), F.col("rate") * F.col("importance"))).otherwise(0.0)
    rows = rows.withColumn("sure", F.floor(wanted)).withColumn("chance", wanted - F.col("sure"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    ratio = (draw / (1 - draw)) / (F.col("chance") / (1 - F.col("chance")))
    open_ = (F.col("chance") > 0) & (F.col("size") > 0)
    at = F.when(open_, ratio / (1 + ratio) * F.lit(float(_BINS)))
    rows = rows.withColumn("at", at).withColumn("coarse", F.least(F.floor("at"), F.lit(_BINS - 1)).cast("int"))
    rows = rows.withColumn("fine", F.least(F.floor((F.col("at") - F.col("coarse")) * _BINS), F.lit(_BINS - 1)).cast("int"))
    rows = cut(rows.withColumn("tie", F.monotonically_increasing_id()))

    # what whole copies leave open, by source
    lack = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("lack"))
    bins = rows.where("at is not null").groupBy("source", "coarse").agg(F.sum("size").alias("words"))
    bins = _until(bins, ["source", "coarse"])
    edge = bins.join(lack.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("below < lack and below + words >= lack")
    edge = edge.select("s", F.col("coarse").alias("edge"), "lack", F.col("below").alias("edge_below"))
    inner = rows.where("at is not null").join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("edge")))
    fine = _until(inner.groupBy("source", "fine").agg(F.sum("size").alias("words"), F.first("lack").alias("lack"), F.first("edge").alias("edge"), F.first("edge_below").alias("edge_below")), ["source", "fine"])
    fine = fine.withColumn("below", F.col("below") + F.col("edge_below")).where("below < lack and below + words >= lack").select(F.col("source").alias("f"), F.col("fine").alias("fine_edge"), "below")
    lines = edge.join(fine, F.col("s").eqNullSafe(F.col("f")), "left").select("s", "edge", "fine_edge", "lack", "below")
    fills = lack.join(lines.drop("lack"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "edge", "fine_edge", "lack", "below")
    rows = _per_source(rows, fills)
    past = F.col("edge").isNull() & (F.col("lack") > 0)  # all that can be ranked is not too much
    inside = past | (F.col("coarse") < F.col("edge")) | ((F.col("coarse") == F.col("edge")) & (F.col("fine") < F.col("fine_edge")))
    verge = (F.col("coarse") == F.col("edge")) & (F.col("fine") == F.col("fine_edge"))
    rows = rows.withColumn("inside", F.coalesce(F.col("at").isNotNull() & inside, F.lit(False))).withColumn("verge", F.coalesce(F.col("at").isNotNull() & verge, F.lit(False)))
    order = Window.partitionBy("source").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where("verge").withColumn("so_far", F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("inside", F.col("lack") - F.col("so_far") >= F.col("size") / 2)
    # a text without words fills nothing: it is taken by its own draw
    free = F.col("at").isNull() & (F.col("size") == 0) & (draw < F.col("chance"))
    every = rows.where("not verge").unionByName(last.select(*rows.columns))
    copies = (F.col("sure") + F.when(F.col("inside") | free, 1).otherwise(0)).cast("long")
    return every.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it. Rows that are equal in doc_id, text and source are taken together, and share their copies evenly.

    Rows without a doc_id are told apart by their texts, rows without a source are a source of their own. Null, empty and wordless texts fill nothing and are taken as often as others of their source and importance. Texts of any
    length are taken or left whole. An empty table stays empty."""
    names = ["doc_id", "text_key", "source"]
    taken = mix(docs, **settings).groupBy(*names).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    keys = [F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("source").cast("string").alias("of")]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *keys)
    rows = rows.join(taken, rows["id"].eqNullSafe(taken["doc_id"]) & (rows["key"] == taken["text_key"]) & rows["of"].eqNullSafe(taken["source"])).select("row", "id", "key", "of", "copies", "n")
    equal = rows.where("n > 1").withColumn("place", F.row_number().over(Window.partitionBy("id", "key", "of").orderBy("n")))
    equal = equal.withColumn("copies", F.floor(F.col("copies") / F.col("n")) + F.when(F.col("place") <= F.col("copies") % F.col("n"), 1).otherwise(0)).drop("place")
    every = rows.where("n = 1").unionByName(equal).where("copies > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
