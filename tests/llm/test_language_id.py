"""Forward-backward against sums over all labellings, accuracy on held-out documents and on spliced ones, rows without letters."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language_id as l
from tests.llm.conftest import SF


def test_chances_against_all_labellings():
    rng = np.random.default_rng(2)
    scores, step, start = rng.normal(size=(6, 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    for counts in ([6], [1, 0, 5], [2, 4]):
        first, got = 0, l.chances(scores, np.array(counts), step, start)
        for n in counts:
            want = np.zeros((n, 3))
            for path in itertools.product(range(3), repeat=n):
                if n:
                    weight = np.exp(start[path[0]] + sum(scores[first + t, y] for t, y in enumerate(path)) + sum(step[x, y] for x, y in itertools.pairwise(path)))
                    want[np.arange(n), path] += weight
            if n:
                assert np.allclose(got[first : first + n], want / want[0].sum())
            first += n


def test_pieces_are_chained_exactly(monkeypatch):
    rng = np.random.default_rng(4)
    counts = np.array([1, 64, 65, 0, 300, 128])
    scores, step, start = rng.normal(size=(counts.sum(), 4)) * 3, rng.normal(size=(4, 4)), rng.normal(size=4)
    got = l.chances(scores, counts, step, start)
    monkeypatch.setattr(l, "STRIDE", 1000)
    assert np.allclose(got, l.chances(scores, counts, step, start))


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return l.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def test_held_out(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    held = {r.doc_id: r.lang for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    found = {r.doc_id: r for r in l.identify(docs, model).collect()}
    assert len(held) > 30 and np.mean([found[d].lang_pred == lang for d, lang in held.items()]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_code_switching(spark, model):
    """Documents spliced from held-out ones: words are labelled where the language switches."""
    texts = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        words = [w for w in r.text.split() if w.isalpha()]
        if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and len(words) >= 60:
            texts.setdefault(r.lang, " ".join(words[20:50]))
    langs = sorted(texts)
    spliced = [(k, f"{texts[a]} {texts[b]} {texts[a]}", a, b) for k, (a, b) in enumerate(itertools.permutations(langs, 2))]
    got = {r.doc_id: r.langs for r in l.label_words(spark.createDataFrame([s[:2] for s in spliced], "doc_id long, text string"), model).collect()}
    right = [x == y for k, _, a, b in spliced for x, y in zip(got[k], [a] * 30 + [b] * 30 + [a] * 30, strict=True)]
    assert len(langs) > 2 and np.mean(right) >= 0.95


def test_odd_rows(spark, model, small_docs, no_docs):
    rows = [(1, None), (2, ""), (3, "123 -- 45"), (4, "🤖🤖 —"), (None, "Ñ"), (None, None), (5, "漢字"), (6, "é" * 70000), (7, "der die das " * 30000), (7, "der die das")]
    got = l.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()
    und = sorted((r.doc_id if r.doc_id is not None else -1) for r in got if r.lang_pred == "und")
    assert len(got) == len(rows) and und == [-1, 1, 2, 3, 4] and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got} <= {*model.languages, "und"}
    assert l.identify(no_docs, model).count() == 0 and l.identify(small_docs, model).count() == small_docs.count()


def test_nothing_learned(spark, small_docs, no_docs):
    blank = l.fit(no_docs)
    assert blank.languages == [] and {r.lang_pred for r in l.identify(small_docs, blank).collect()} == {"und"}
    only = l.fit(small_docs.where("lang is not null"))
    assert only.languages == ["en"] and {(r.lang_pred, r.score) for r in l.identify(small_docs, only).collect()} <= {("en", 1.0), ("und", 0.0)}


def test_lower_case():
    text = "ÀÉÞ×ß ABz Ω"
    assert bytes(l.lowered(np.frombuffer(text.encode(), np.uint8))).decode() == "àéþ×ß abz Ω"
