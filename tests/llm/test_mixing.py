from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulsegrid.llm import mixing


def expected_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: (3.0, 1.0, 2.0)[k % 3] for k, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [n for n in names if n not in full]
        left = total - sum(2 * sizes[n] for n in full)
        target = {n: 2.0 * sizes[n] if n in full else left * weight[n] / sum(weight[m] for m in free) for n in names}
        over = {n for n in free if target[n] > 2 * sizes[n]}
        if not over:
            return target
        full |= over


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_sizes(small_docs, no_docs):
    rows, got = small_docs.collect(), mixing.mix(small_docs).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + n_words(r.text)
    want = expected_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    assert mixing.mix(no_docs).count() == 0


def test_taken_is_near_target_and_repeats(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 13).cast("string"))).alias("source"))
    one, two = ({r.doc_id: r.taken for r in mixing.mix(docs).collect()} for _ in range(2))
    assert one == two
    for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 21


def test_importance_gives_unequal_chances(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), F.when(F.col("id") % 4 < 2, 1.5).otherwise(0.5).alias("rank"))
    taken = {r.heavy: r.n for r in mixing.mix(docs, percent=50.0, importance="rank").join(docs.select("doc_id", (F.col("rank") > 1).alias("heavy")), "doc_id").groupBy("heavy").agg(F.sum("copies").alias("n")).collect()}
    assert taken[True] > 2 * taken[False] > 0


def test_inclusion_frequencies(spark):
    """Mean copies of the classes of importance are as asked for, in sources below, at and near twice their size, and the words meet the targets."""
    size = F.element_at(F.array(*map(F.lit, (30, 200, 600))), (F.col("id") % 3 + 1).cast("int"))
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), size).alias("text"), F.concat(F.lit("s"), F.floor(F.col("id") / 3000).cast("string")).alias("source"))
    for percent in (60.0, 150.0, 190.0):
        rows = mixing.mix(docs, percent=percent, importance=mixing.by_size).groupBy("source", "size").agg(F.avg("copies").alias("mean"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
        for source in ("s0", "s1", "s2"):
            own = {r["size"]: r for r in rows if r.source == source}
            target = own[30].target
            words, step = {30: 30_000, 200: 200_000, 600: 600_000}, {30: 2**-0.5, 200: 1.0, 600: 2**0.5}
            low, high = 0.0, 1e6
            for _ in range(200):  # the rate by bisection
                rate = (low + high) / 2
                low, high = (rate, high) if sum(min(2.0, rate * step[n]) * words[n] for n in words) < target else (low, rate)
            for n, r in own.items():
                assert abs(r["mean"] - min(2.0, low * step[n])) < 0.05 and r.most <= 2
            assert abs(sum(r.taken for r in own.values()) - target) <= 301


def test_no_importance_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 0.0, 1), (2, "c d", "s", 1.0, 2), (3, None, "s", None, 3), (4, "e f", "s", float("nan"), 4), (None, "g h", None, 1.0, 5)], "doc_id long, text string, source string, rank double, mixed_copies int")
    got = {r.doc_id: r.copies for r in mixing.mix(docs, percent=100.0, importance="rank").collect()}
    assert got == {1: 0, 2: 2, 3: 0, 4: 0, None: 1}
    twice = docs.where("doc_id = 2").unionByName(docs.where("doc_id = 2")).unionByName(docs.where("doc_id is null"))
    rows = mixing.mixed_rows(twice, percent=1000 / 6, weights=(1.0,))
    assert rows.columns == docs.columns and rows.where("doc_id = 2").count() == 3


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 2_000_000, "s")] + [(k, "a b c", "s") for k in range(2, 40)], "doc_id long, text string, source string")
    assert {r.size: r.copies for r in mixing.mix(docs, percent=200.0).collect()} == {2_000_000: 2, 3: 2}


def test_mixed_rows_keep_columns(small_docs, no_docs):
    assert mixing.mixed_rows(small_docs).columns == small_docs.columns and mixing.mixed_rows(no_docs).count() == 0
    named = small_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in mixing.mix(named).collect()}
    assert {r.doc_id: r.n for r in mixing.mixed_rows(named).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {k: v for k, v in copies.items() if v}


def test_source_order_over_partitions(spark):
    sizes = spark.createDataFrame([(n, 1) for n in ["b", "a", "é", "Z", None, "aa", "c", "d", "e"]], "source string, size long")
    places = {r.source: r.place for r in mixing.ranked_sources(sizes).collect()}
    assert places == {"Z": 0, "a": 1, "aa": 2, "b": 3, "c": 4, "d": 5, "e": 6, "é": 7, None: 8}
