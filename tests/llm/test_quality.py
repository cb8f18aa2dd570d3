from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality
from pulsegrid.llm.support import table

from .conftest import SF


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts, places, seen, again = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            places.update(range(i, i + 5))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(places), len(w) < 10 or 100 * len(places) > 20 * len(w)


def test_base_counts(small_docs, no_docs):
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r)[:7] for r in quality.rate(small_docs, quality.LineField()).collect()]
    assert sorted(got, key=key) == sorted(((r.doc_id, *base(r.text)) for r in small_docs.collect()), key=key)
    assert quality.rate(no_docs, quality.LineField()).count() == 0
    kept = quality.keep_good(small_docs, quality.LineField())
    assert kept.columns == small_docs.columns and kept.count() == sum(not base(r.text)[-1] for r in small_docs.collect())


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    field = quality.LineField(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    counts = np.array([3, 0, 6, 1, 5])
    x = rng.normal(size=(counts.sum(), quality.FEATURES))
    got, at = field.decode(x, counts), 0
    for n in counts:
        scores = x[at : at + n] @ field.emit

        def value(path, scores=scores):
            return field.start[path[0]] + sum(scores[i, s] for i, s in enumerate(path)) + sum(field.step[a, b] for a, b in zip(path, path[1:])) if path else 0.0

        best = max(product((0, 1), repeat=int(n)), key=value)
        assert tuple(got[at : at + n]) == best
        at += n


def test_fit_follows_gradient_to_separation():
    rng = np.random.default_rng(1)
    counts = np.full(80, 5)
    marks = np.repeat(rng.integers(0, 2, 80), 5)
    x = rng.normal(size=(400, quality.FEATURES))
    x[:, 3] += marks * 1.5
    field = quality.LineField().fit(x, counts, marks)
    assert (field.decode(x, counts) == marks).mean() > 0.95


def test_held_out_accuracy(spark):
    """Fitted on one half of the labels, right on nine in ten of the other half."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    field = quality.fit_field(docs, labels.where(half == 0))
    rows = quality.rate(docs, field).join(labels.where(half == 1), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98


def test_without_labels_all_lines_are_content(spark, small_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert (quality.fit_field(small_docs, none).emit == 0).all()


@pytest.mark.parametrize("sf", [SF])
def test_long_single_text(spark, sf):
    docs = spark.createDataFrame([(1, "word and more words in a line of text here.\n" * 3000)], "doc_id long, text string")
    assert quality.rate(docs, quality.LineField()).first().n_dup_lines == 2999


def test_one_very_long_text_among_short_ones(spark):
    """Memory follows the lines, not the longest text times the number of texts."""
    rows = [(0, "some line of text\n" * 150_000)] + [(k, f"short row number {k} of a few words and then some more") for k in range(1, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("quality", F.lit(7)).withColumn("content_share", F.lit(7))
    field = quality.LineField(np.zeros((quality.FEATURES, 2)), np.array([[0.5, 0.0], [0.0, 0.5]]), np.zeros(2))
    got = quality.rate(docs, field).where("doc_id in (0, 1)").orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [600_000, 12] and got[0].base_failed and not got[1].base_failed
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    fitted = quality.fit_field(docs, labels)
    assert (fitted.emit != 0).any() and quality.keep_good(docs, fitted).columns == docs.columns
