from __future__ import annotations

import re

import pytest

from pulsegrid.llm import decontamination
from pulsegrid.llm.support import scratch_path

from .conftest import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("chunk", [200_000, 12])
def test_matches_brute_force(spark, small_docs, monkeypatch, chunk):
    monkeypatch.setattr(decontamination, "CHUNK_WORDS", chunk)
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[7].split(" ")[:30])), (2, texts[9]), (3, "One, two"), (4, None), (5, "..."), (6, texts[-8][5:60]), (7, " ".join(texts[7].split(" ")[:30])), (8, "words that nobody wrote in any of these texts at all today")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(small_docs, benchmark, 10).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(brute(rows, items, 10), key=key)


def test_empty_tables(spark, small_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(no_docs, none).count() == 0
    assert {r.n_hit for r in decontamination.contamination(small_docs, none).collect()} == {0}
    assert decontamination.clean(small_docs, none).count() == small_docs.count()


def test_clean_tells_rows_by_text(spark, small_docs):
    """Of rows that repeat a doc_id the clean one stays; a contaminated row without a doc_id goes; columns and repeats are kept."""
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"start {passage} end", "a"), (1, "a clean text under the same id", "b"), (None, passage, "c"), (None, "clean", "d"), (2, None, "e"), (2, "", "f"), (3, "clean", "g"), (3, "clean", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hit string")
    kept = decontamination.clean(docs, spark.createDataFrame([(9, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r._hit for r in kept.collect()) == ["b", "d", "e", "f", "g", "g"]


def test_a_long_item_is_searched_in_pieces(spark, monkeypatch):
    """Every window of an item is found, also those across pieces; no chunk is much longer than its bound."""
    import random

    rng, sizes = random.Random(2), []
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))
    parts = long.split(" ")
    docs = [(k, " ".join(["x", *parts[k : k + 10], "y"])) for k in range(491)] + [(491, long), (492, " ".join(parts[:9]))]
    monkeypatch.setattr(decontamination, "CHUNK_WORDS", 40)
    made = decontamination.Phrases.__init__
    monkeypatch.setattr(decontamination.Phrases, "__init__", lambda self, items, width: (sizes.append(sum(len(w) for _, w in items)), made(self, items, width))[1])
    found = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, long), (6, " ".join(parts[:3]))], "item_id long, text string").coalesce(1), 10).collect()
    assert {r.doc_id: r.n_hit for r in found} == {k: 10 for k in range(491)} | {491: 500, 492: 3}
    assert max(sizes) <= 2 * (40 + 9) and len(sizes) > 8


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the rare cat sat on a red mat"), (2, "rare x x x x x x x mat"), (3, "mat then rare"), (4, None)], "doc_id long, text string")
    index = decontamination.build_index(docs, scratch_path(spark, "near"))
    assert sorted(r.doc_id for r in decontamination.proximity(index, "Rare mat", 6).collect()) == [1, 3]
    assert decontamination.proximity(index, "rare dog", 6).count() == 0 and decontamination.proximity(index, "", 6).count() == 0
