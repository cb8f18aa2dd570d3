"""The sweep against groups taken from sets of offsets, on odd and long texts and on a table."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import pytest

from pulsegrid.llm import token_alignment as t
from pulsegrid.llm.token_counts import byte_letters
from tests.llm.conftest import SF

tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
ODD = [
    (None, None), (None, ""), (7, "a▁b"), (7, "a▁b"), (8, " "), (9, "  x \n\n y\r\n\t "), (10, "ﬁ ½  é́ 漢字🤖🤖"), (11, "<s>x</s><|endoftext|> <unk> <0x41>"), (12, "=" * 3000), (12, "=" * 3000),
    (None, "dup " * 30), (None, "dup " * 30), (13, "word " * 40000), (14, "\0a\x1fb \x85c"), (15, " " * 500 + "a" + " " * 33), (16, "qzj" * 3000), (17, "é ñ " * 30000 + "x"),
]


def groups(texts: list[str | None]) -> list[list[tuple[list[int], list[int]]]]:
    import sentencepiece

    a_model, b_model, letters = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a_model.encode_special_tokens = True
    names = {k: v for v, k in a_model.get_vocab().items()}

    def b_bytes(k: int) -> bytes:
        piece = b_model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(k) else piece.replace("▁", " ").encode()

    out = []
    for text in texts:
        own = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_parts, b_parts = [bytes(letters[c] for c in names[k]) for k in a], [b_bytes(k) for k in b]
            if b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
                a_ends, b_ends = np.cumsum([len(p) for p in a_parts]).tolist(), np.cumsum([len(p) for p in b_parts]).tolist()
                i = j = 0
                for end in sorted(set(a_ends) & set(b_ends)):
                    i2, j2 = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
                    own.append((a[i:i2], b[j:j2]))
                    i, j = i2, j2
        out.append(own)
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    found = groups([text for _, text in rows])
    links = [[(x, y) for a, b in own for x in a for y in b] for own in found]
    count = collections.Counter(pair for own in links for pair in set(own))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (doc, _), own, pairs in zip(rows, found, links, strict=True):
        name = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append((doc, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(pairs), sum(count[p] == top[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(name.encode()).hexdigest() if own else ""))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    return some.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "doc_id as pairs", "'x' as spread").repartition(3).cache()


@pytest.fixture(scope="module")
def wanted(documents):
    return brute([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("most", [t.BROADCAST_PAIRS, 0])
def test_against_sets(documents, wanted, most):
    got = sorted((tuple(r) for r in t.align(documents, A, B, most).collect()), key=repr)
    assert got == wanted


def test_small_steps_and_wide_groups(documents, wanted, monkeypatch):
    """The machine in steps of a few tokens, with every larger group counted by its distinct ids."""
    for name, value in (("STEP_BYTES", 50), ("WIDE", 2), ("TABLE_PAIRS", 3)):
        monkeypatch.setattr(t, name, value)
    both = t.Vocabularies.of(A, B)
    sweep, done = t.Sweep(*both.lengths()), []
    rows = [(r.doc_id, r.text) for r in documents.collect() if r.text and len(r.text) < 3000]
    for k, (_, text) in enumerate(rows):
        a, b, same = both.encode(both.pieces(text))
        if same.all():
            ids = [np.concatenate(x).astype(np.uint16) for x in (a, b)]
            cuts = [np.arange(0, len(x), 7) for x in ids]
            ends = [np.concatenate(([0], np.cumsum(n[x]))) for n, x in zip(both.lengths(), ids, strict=True)]
            events = sorted((int(ends[s][c]), s, ids[s][c : c + 7].tobytes()) for s in (0, 1) for c in cuts[s])
            for i in range(0, len(events), 3):
                done += sweep.take([(k,)] * len(events[i : i + 3]), events[i : i + 3])
    done += sweep.end()
    by_text = {row[0]: row for row in done}
    for k, row in by_text.items():
        own = [w for w in wanted if w[0] == rows[k][0] and w[7] == row[6]]
        assert own and tuple(row[2:6]) == own[0][1:5]
        assert t.unpack(row[7]).size == len(np.frombuffer(row[8], "<u4")) and int(np.frombuffer(row[8], "<u4").sum()) == own[0][4]


def test_pieces_keep_tokens(monkeypatch):
    monkeypatch.setattr(t, "PIECE", 20)
    both = t.Vocabularies.of(A, B)
    text = "Some words, and more\nof them   with gaps  \t and\n\nlines; l'été à Noël " * 9
    assert len(both.pieces(text)) > 10 and "".join(both.pieces(text)) == " " + text
    for side, whole in zip(both.encode(both.pieces(text))[:2], both.encode([" " + text])[:2], strict=True):
        assert np.concatenate(side).tolist() == whole[0].tolist()


@pytest.mark.parametrize("known", [3, 40, t.KNOWN_WORDS])
def test_words_are_encoded_as_in_their_text(documents, monkeypatch, known):
    """Ids of distinct words, put together, are those of whole texts; white space of every kind beside words; a small store that is emptied often."""
    import pyarrow as pa

    from pulsegrid.llm import textkit

    monkeypatch.setattr(t, "KNOWN_WORDS", known)
    texts = [r.text for r in documents.collect() if r.text and len(r.text) < 20000 and "▁" not in r.text]
    texts += ["é è\u00a0 a\u3000 b\u2028 c\x85 d", "ñ ñ\n n\t t\x1f x\r y", "x ", " x", "a  b   c", "ü", "\u00a0", "漢 字 🤖 x", "à à"]
    both = t.Vocabularies.of(A, B)
    words = t.Words(both)
    for block in textkit.blocks(pa.array(texts), 5000):
        starts, ends, counts = t.spans(block)
        facts = words.facts(block, starts, ends)
        assert facts[:, 4].all() and len(counts) == len(block)
        want = both.encode([" " + x for x in texts[block.first : block.stop]])
        for side in (0, 1):
            data, _ = words.packed(side, facts)
            assert np.frombuffer(data, words.kinds[side]).tolist() == np.concatenate(want[side]).tolist()


def test_empty(spark, documents):
    assert t.align(documents.limit(0), A, B).count() == 0
    assert {tuple(r)[1:] for r in t.align(documents.where("text is null or text = ''"), A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}
