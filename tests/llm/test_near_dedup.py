from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from pulsegrid.llm import near_dedup
from pulsegrid.llm.components import components
from pulsegrid.llm.near_dedup import keep_one, near_duplicates

from .conftest import LOWER


def brute(rows, percent, width):
    """{row place: (n_shingles, component)} by all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        if rows[i][0] is not None:
            for x in s:
                for j in where[x]:
                    common[j] += 1
                where[x].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(sets[i]), None if doc is None else least[find(i)]) for i, (doc, _) in enumerate(rows)]


@pytest.mark.parametrize(("percent", "width"), [(85, 3), (80, 5)])
def test_matches_all_pairs(small_docs, percent, width):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    got = near_duplicates(small_docs, percent, width).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, percent, width), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("limits", [{}, {"leaf": 8, "cell": 8, "rounds": 1}, {"leaf": 16, "cell": 12, "rounds": 4}])
def test_chain_of_copies_and_large_families(spark, limits):
    """A drifting chain: neighbours are linked, ends are not; with small limits the family is branched, cut into cells and blocks."""
    rng = random.Random(1)
    words, rows = [f"w{k}" for k in range(120)], []
    for k in range(150):
        rows.append((k, " ".join(words)))
        words[rng.randrange(len(words))] = f"n{k}"
    rows += [(1000 + k, f"other text number {k} of its own {k * 7} {k * 13}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 85, 3, **limits).collect()}
    assert got == {doc: component for doc, _, component in brute(rows, 85, 3)}


def test_hub_of_copies_near_the_threshold(spark):
    """Near copies of one text with zero to eight edits: some are linked through others, some with none."""
    rng, rows = random.Random(7), []
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    for k in range(500):
        own = list(base)
        for _ in range(k % 9):
            own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), {doc: component for doc, _, component in brute(rows, 85, 3)}
    assert 1 < len(set(want.values())) < 500
    for limits in ({}, {"leaf": 32, "cell": 64}):
        assert {r.doc_id: r.component_id for r in near_duplicates(docs, 85, 3, **limits).collect()} == want


def test_recall_of_pairs_near_the_threshold(spark):
    """Pairs of otherwise unrelated texts at 85 to 90 % are found one by one: no component helps."""
    rng, rows, planted = random.Random(3), [], 0
    for k in range(600):
        words = [f"v{rng.randrange(10**7)}" for _ in range(202)]
        other = list(words)
        # e distant edits of 200 shingles: (200 - 3 e) / (200 + 3 e)
        for place in rng.sample(range(3, 199, 7), rng.choice([4, 5])):
            other[place] = f"x{rng.randrange(10**7)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        planted += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = near_duplicates(docs, 85, 3).where("doc_id <> component_id").count()
    assert linked >= 0.999 * planted


def test_repeated_ids_are_rated_by_their_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (4, a + " y"), (3, b + " x"), (5, a), (7, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, 85, 3).collect()) == sorted(brute(rows, 85, 3))
    kept = sorted((r.doc_id, r.text[:2]) for r in keep_one(docs, percent=85, width=3).collect())
    assert kept == [(3, "b0"), (4, "a0"), (7, "on")]
    two = spark.createDataFrame([(5, a), (5, b), (5, b)], "doc_id long, text string")
    assert sorted(r.text[:2] for r in keep_one(two).collect()) == ["a0", "b0"]


def test_very_long_texts(spark):
    long = " ".join(f"l{k % 60_000} m{k % 7919}" for k in range(150_000))
    rows = [(k, long + f" end {k}") for k in (9, 8, 2)] + [(1, "x" * 3_000_000), (0, "y " * 500_000), (3, "short text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 85, 3).collect()} == {9: 2, 8: 2, 2: 2, 1: 1, 0: 0, 3: 3}


def test_keep_one_keeps_columns(small_docs, no_docs):
    kept = keep_one(small_docs)
    assert kept.columns == small_docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert 0 in ids and 8 in ids and 9 not in ids and ids.count(5) == 2 and len(ids) == len(set(ids)) + 1
    assert keep_one(no_docs).count() == 0 and near_duplicates(no_docs).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), (20, 10)] + [(100, k) for k in range(101, 130)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, **{k: 100 for k in range(100, 130)}}


def test_blocks_grow_with_their_probes(spark):
    """A node of one large component and five others: rows grow in proportion to its members, and each of the five meets all of the node once."""
    join, rows = near_dedup._Join(80, 5, 4, 64, 256, 2), {}
    for n in (2000, 8000):
        level = spark.range(n).select(F.lit(7).cast("long").alias("node"), "id", F.when(F.col("id") < 5, F.col("id")).otherwise(9).alias("component"), F.lit(n).cast("long").alias("n"), F.lit(1).cast("long").alias("weight"))
        cells = join.blocks(level).cache()
        rows[n] = cells.count()
        met = cells.alias("a").join(cells.alias("b"), "cell").where("a.id < 5 and a.id <> b.id").groupBy("a.id").agg(F.countDistinct("b.id").alias("met")).collect()
        assert {r.id: r.met for r in met} == {k: n - 1 for k in range(5)}
    assert rows[8000] <= 4.5 * rows[2000] and rows[8000] <= 6 * 8000
