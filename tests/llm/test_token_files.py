from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import textkit, token_files
from pulsegrid.llm.queries import word_vocabulary
from pulsegrid.llm.support import scratch_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_vocabulary())


def test_round_trip(spark, small_docs, no_docs, tokenizer):
    path = scratch_path(spark, "t")
    token_files.write_tokens(small_docs, path, word_vocabulary())
    got = sorted(token_files.read_digest(spark, path).collect(), key=lambda r: r.start)
    rows = small_docs.collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    start, want = 0, {}
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        if r.doc_id not in (None, 5):
            assert token_files.read_ids(spark, path, r.doc_id) == ids
            assert token_files.read_ids(spark, path, r.doc_id, 3, 11) == ids[3:11]
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    assert token_files.read_ids(spark, path, 10**9) == []
    token_files.write_tokens(no_docs, path, word_vocabulary())
    assert token_files.read_digest(spark, path).count() == 0


@pytest.mark.parametrize("text", ["don't 'tis it's", "áb Á x", "abc123def", "“Hi”—!ok… 'S I'LL", "a'b''c '' 's's", "日本語テキスト、漢字123", "\x00\x1c\x1fa\x85b", "e≠ ½ ２３ Ⅷ", "İstanbul ſ K Å", "!'s ,'t 'RE", "≠ x́,", "<|endoftext|>x"])
def test_pieces_encode_like_whole_texts(tokenizer, text):
    encoder = token_files.Encoder(word_vocabulary())
    for own in (text, f"zz {text} {text}", text.upper()):
        assert encoder.block(next(textkit.blocks(pa.array([own]))))[0].tolist() == tokenizer.encode(own, add_special_tokens=False).ids


def test_grammar_is_lossless_and_shrinks():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.append(np.tile(rng.integers(5, 60, 12), 30), 1) for _ in range(40)]).astype(np.uint32)
    alphabet, rules, lengths, symbols = token_files.compress(ids, 1)
    shard = token_files.Shard(*(x.tobytes() for x in (alphabet, rules, lengths, symbols)))
    assert (shard.ids() == ids).all() and len(symbols) < len(ids) / 3 and lengths[symbols].sum() == len(ids)
    assert not (rules == np.searchsorted(alphabet, 1)).any()
    for few in ([], [1], [7, 7, 7, 1]):
        shard = token_files.Shard(*(x.tobytes() for x in token_files.compress(np.array(few, np.uint32), 1)))
        assert shard.ids().tolist() == few


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=400), st.integers(2, 5))
def test_no_frequent_pair_is_left(ids, least):
    """Runs of one id and overlaps included: the grammar is lossless, and no pair beside the end id occurs `least` times without overlap."""
    ids = np.array(ids, np.uint32)
    alphabet, rules, lengths, symbols = token_files.compress(ids, 1, least)
    assert token_files.Shard(*(x.tobytes() for x in (alphabet, rules, lengths, symbols))).ids().tolist() == ids.tolist()
    counts, free = Counter(), -1
    for k, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)):
        twin = pair[0] == pair[1]
        if 1 not in [alphabet[s] for s in pair if s < len(alphabet)] and not (twin and k <= free):
            counts[pair] += 1
            free = k + 1 if twin else k
    assert max(counts.values(), default=0) < least


def test_runs_of_one_id_shrink_to_their_logarithm():
    symbols = token_files.compress(np.full(1 << 14, 9, np.uint32), 1)[3]
    assert len(symbols) <= 16


def test_many_symbols_take_four_bytes():
    rng = np.random.default_rng(1)
    ids = np.concatenate((np.arange(2, 70_002), np.tile(rng.integers(2, 70_002, 50), 40))).astype(np.uint32)
    out = token_files.compress(ids, 1)
    assert out[3].dtype == np.uint32 and (token_files.Shard(*(x.tobytes() for x in out)).ids() == ids).all() and len(out[3]) < 70_200


def test_cache_bound(monkeypatch, tokenizer):
    monkeypatch.setattr(token_files, "CACHE_PIECES", 5)
    encoder = token_files.Encoder(word_vocabulary())
    for text in ("a b c d e f g h", "c d e", "x y z a b"):
        assert encoder.block(next(textkit.blocks(pa.array([text]))))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
