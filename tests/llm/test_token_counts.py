from __future__ import annotations

import random

import numpy as np
import pytest

from pulsegrid.llm.queries import word_vocabulary
from pulsegrid.llm.token_counts import END, Automaton, count_tokens, pieces_of

from .conftest import LOWER


def greedy(word, pieces, longest):
    symbols, at, n = (*word, END), 0, 0
    while at < len(symbols):
        step = next((k for k in range(min(longest, len(symbols) - at), 0, -1) if symbols[at : at + k] in pieces), 0)
        if not step:
            return 1
        at, n = at + step, n + 1
    return n


@pytest.mark.parametrize("seed", range(30))
def test_random_vocabularies(seed):
    rng = random.Random(seed)
    pieces = {tuple(rng.choice([97, 98, 99]) for _ in range(rng.randint(0, 3))) + rng.choice([(97,), (98,), (END,)]) for _ in range(rng.randint(1, 9))}
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    assert Automaton(sorted(pieces)).count(data, starts, ends).tolist() == [greedy(w, pieces, 4) for w in words]


def test_documents(spark, small_docs, no_docs):
    pieces = set(pieces_of(word_vocabulary()))
    longest = max(map(len, pieces))
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in count_tokens(small_docs, word_vocabulary()).collect()}
    want = set()
    for r in small_docs.collect():
        raw = (r.text or "").translate(LOWER).encode()
        words = [w for w in raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if w]
        want.add((r.doc_id, len(words), sum(greedy(w, pieces, longest) for w in words)))
    assert got == want and count_tokens(no_docs, word_vocabulary()).count() == 0


def test_very_long_words(spark):
    pieces = set(pieces_of(word_vocabulary()))
    longest, word = max(map(len, pieces)), "abcdefghijklm" * 700 + "é!"
    docs = spark.createDataFrame([(1, f"a {word} b"), (2, "x" * 5_000_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, word_vocabulary()).collect()}
    assert got[1] == sum(greedy(w.encode(), pieces, longest) for w in ("a", word, "b")) and got[2] > 100_000
