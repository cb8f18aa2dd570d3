"""Alignment of two tokenizers' tokens over the same bytes, by an event sweep.

Tokens' ends of both tokenizers are events on a document's bytes. They are united, dealt out by document, sorted by offset, and streamed through a machine that closes a group wherever both
tokenizers end a token; every A token of a group is linked to every B token of it. An event row holds the ends of a piece of text as packed ids (an end is the sum of the
token lengths before it), so what is shuffled are two bytes a token. The machine holds the open group, a running digest and the distinct links of one document.

How many documents link a pair of ids is counted over the whole corpus; each document's links are then looked up in these counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.support import cut, drop_path, scratch_path, small_batches
from pulsegrid.llm.token_counts import byte_letters

KEY = ["doc_id", "hash1", "hash2", "spread"]
EVENTS = "doc_id long, hash1 long, hash2 int, spread int, start long, side int, ids binary"
SWEPT = "doc_id long, hash1 long, hash2 int, spread int, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Characters of a piece of text that is encoded at once, if a word ends there.
PIECE = 1 << 16
#: A piece starts with a space after a word; no token of either kind reaches across that place.
_SEAM = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
#: Bytes of token ids that the machine takes at once, and links of a group from which its ids are counted first.
STEP_BYTES, WIDE = 1 << 20, 1 << 14
#: Pairs of ids that are counted in one table in memory, and the most whose counts are sent to every task.
TABLE_PAIRS, BROADCAST_PAIRS = 1 << 22, 4_000_000
#: Rows of the same document and text are told apart by one of so many numbers, so that copies of a row are spread.
SPREAD = 64
_OFFSET_BITS = 40
_loaded: dict[tuple[str, str], Vocabularies] = {}


@dataclass
class Vocabularies:
    """Both tokenizers, and the bytes of each of their tokens."""

    a: object
    b: object
    a_bytes: pa.Array
    b_bytes: pa.Array
    seams: bool

    @staticmethod
    def of(a_path: str, b_path: str) -> Vocabularies:
        if (a_path, b_path) not in _loaded:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            import sentencepiece
            from tokenizers import Tokenizer

            a, b, letters = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), byte_letters()
            a.encode_special_tokens = True
            special = {t.content for t in a.get_added_tokens_decoder().values()}
            a_bytes = [b""] * (max(a.get_vocab().values()) + 1)
            for token, k in a.get_vocab().items():
                a_bytes[k] = token.encode() if token in special else bytes(letters[c] for c in token)
            pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
            b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
            seams = not any("▁" in p.lstrip("▁") for p in pieces)
            _loaded[a_path, b_path] = Vocabularies(a, b, pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary()), seams)
        return _loaded[a_path, b_path]

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(x) for x in side.to_pylist()], np.int64) for side in (self.a_bytes, self.b_bytes))

    def pieces(self, text: str) -> list[str]:
        """The text behind a space, cut where the next piece starts with a space after a word."""
        whole, first, out = " " + text, 0, []
        while self.seams and len(whole) - first > PIECE and (seam := _SEAM.search(whole, first + PIECE)):
            out.append(whole[first : seam.start()])
            first = seam.start()
        return [*out, whole[first:]]

    def encode(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and of B of each piece, and whether the tokens of both join to the piece's bytes."""
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = [np.array(ids, np.int64) for ids in self.b.encode([p[1:] for p in pieces], num_threads=1)]
        raw = [p.encode() for p in pieces]
        same = np.ones(len(pieces), bool)
        for side, table in ((a, self.a_bytes), (b, self.b_bytes)):
            joined = table.take(pa.array(np.concatenate(side)))
            data, offsets = memoryview(joined.buffers()[2] or b"").cast("B"), np.frombuffer(joined.buffers()[1], np.int32)
            edges = offsets[np.cumsum([0, *map(len, side)])].tolist()
            same &= [data[i:j] == r for i, j, r in zip(edges[:-1], edges[1:], raw, strict=True)]
        return a, b, same


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


_SPACE, _WHITE = 0x20, textkit.byte_class((0x09, 0x0D), (0x1C, 0x20))
#: Words whose ids a worker keeps, a few each.
KNOWN_WORDS = 500_000


def spans(block: textkit.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block's texts, without the space before each, and the number of words of each text. A seam is a space, not the last byte, after a byte or a letter of two bytes that is no white space."""
    data, n = block.data, len(block.data)
    seam = np.zeros(n, bool)
    if n > 2:
        plain = (data[:-2] < 0x80) & ~_WHITE[data[:-2]]
        two = np.zeros(n - 2, bool)
        two[1:] = (data[: n - 3] >= 0xC3) & (data[: n - 3] <= 0xDF) & (data[1 : n - 2] >= 0x80) & (data[1 : n - 2] <= 0xBF)
        seam[1:-1] = (data[1:-1] == _SPACE) & (plain | two)
    filled = np.diff(block.offsets) > 0
    firsts, lasts = block.offsets[:-1][filled], block.offsets[1:][filled] - 1
    seam[firsts] = seam[lasts] = False
    cuts = np.flatnonzero(seam)
    starts = np.sort(np.concatenate((firsts, cuts + 1)))
    ends = np.sort(np.concatenate((lasts + 1, cuts)))
    return starts, ends, np.diff(np.searchsorted(starts, block.offsets))


class Words:
    """The ids of both tokenizers of words seen lately, by hash, in a large sorted table and a small one that is merged into it now and then. A fact is (first and number of A ids, of B ids, spelled or not)."""

    def __init__(self, both: Vocabularies):
        self.both = both
        self.kinds = [_width(len(both.a_bytes)), _width(len(both.b_bytes))]
        self.forget()

    def forget(self) -> None:
        self.old, self.new = ((np.zeros(0, np.uint64), np.zeros((0, 5), np.int64)) for _ in range(2))
        self.ids, self.used = [np.zeros(1 << 16, k) for k in self.kinds], [0, 0]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        facts = np.full((len(hashes), 5), -1)
        for keys, own in (self.old, self.new):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                there = keys[at] == hashes
                facts[there] = own[at[there]]
        return facts

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        a, b, same = self.both.encode([" " + w for w in words])
        facts = np.empty((len(words), 5), np.int64)
        for side, own in enumerate((a, b)):
            counts, ids = np.array([len(x) for x in own], np.int64), np.concatenate(own)
            if self.used[side] + len(ids) > len(self.ids[side]):
                self.ids[side] = np.concatenate((self.ids[side], np.zeros(max(len(ids), len(self.ids[side])), self.kinds[side])))
            self.ids[side][self.used[side] : self.used[side] + len(ids)] = ids
            facts[:, 2 * side], facts[:, 2 * side + 1] = self.used[side] + np.cumsum(counts) - counts, counts
            self.used[side] += len(ids)
        facts[:, 4] = same
        whole = 4 * (len(hashes) + len(self.new[0])) > len(self.old[0])
        keys, facts = (np.concatenate(x) for x in zip((hashes, facts), self.new, *([self.old] if whole else []), strict=True))
        order = np.argsort(keys, kind="stable")
        self.new = keys[order], facts[order]
        if whole:
            self.old, self.new = self.new, (keys[:0], facts[:0])

    def facts(self, block: textkit.Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The facts of each word of a block."""
        hashes, first, back = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
        found = self._find(hashes)
        if (found[:, 0] < 0).any():
            if len(self.old[0]) + len(self.new[0]) + int((found[:, 0] < 0).sum()) > KNOWN_WORDS or sum(self.used) > 16 * KNOWN_WORDS:
                self.forget()
                found[:] = -1
            lacking = np.flatnonzero(found[:, 0] < 0)
            raw = block.data.tobytes()
            self._learn(hashes[lacking], [raw[i:j].decode() for i, j in zip(starts[first[lacking]].tolist(), ends[first[lacking]].tolist(), strict=True)])
            found = self._find(hashes)
        return found[back]

    def packed(self, side: int, facts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words' ids of a side as bytes, and where each word's begin, and the end."""
        size = np.dtype(self.kinds[side]).itemsize
        return self.ids[side][textkit.ragged(facts[:, 2 * side], facts[:, 2 * side + 1])].tobytes(), size * np.concatenate(([0], np.cumsum(facts[:, 2 * side + 1])))


def _events(a_path: str, b_path: str):
    """The event rows of each document: packed ids of A (side 0) and B (side 1) by piece; a document without tokens has one of side 0 without ids."""

    def block_rows(words: Words, block: textkit.Block) -> Iterator[tuple[int, int, int, bytes]]:
        starts, ends, counts = spans(block)
        facts = words.facts(block, starts, ends) if len(starts) and words.both.seams else np.zeros((len(starts), 5), np.int64)
        sides = [words.packed(side, facts) for side in (0, 1)]
        sums = np.concatenate(([0], np.cumsum(ends - starts + 1)))  # with the space before each word
        unlike = np.concatenate(([0], np.cumsum(facts[:, 4] != 1)))
        firsts = np.concatenate(([0], np.cumsum(counts))).tolist()
        for row, (first, stop) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
            if first == stop:
                yield row, 0, 0, b""
            elif unlike[stop] > unlike[first]:
                yield from whole_rows(words, row, block.text(block.offsets[row], block.offsets[row + 1]))
            else:
                edges = np.flatnonzero(np.diff((sums[first:stop] - sums[first]) // PIECE)) + first + 1
                for i, j in zip([first, *edges.tolist()], [*edges.tolist(), stop], strict=True):
                    for side, (data, at) in enumerate(sides):
                        yield row, int(sums[i] - sums[first]), side, data[at[i] : at[j]]

    def whole_rows(words: Words, row: int, text: str) -> Iterator[tuple[int, int, int, bytes]]:
        """A text with a word that isn't spelled, by all of its pieces."""
        pieces = words.both.pieces(text)
        a, b, same = words.both.encode(pieces)
        if not same.all():
            yield row, 0, 0, b""
            return
        start = 0
        for piece, *ids in zip(pieces, a, b, strict=True):
            for side in (0, 1):
                yield row, start, side, ids[side].astype(words.kinds[side]).tobytes()
            start += len(piece.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Vocabularies.of(a_path, b_path))
        for batch in batches:
            for block in textkit.blocks(batch.column(4)):
                keys = [batch.column(k).slice(block.first, len(block)) for k in range(4)]
                rows, starts, sides, ids = zip(*block_rows(words, block), strict=True)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array(starts, pa.int64()), pa.array(sides, pa.int32()), pa.array(ids, pa.binary())], names=[*KEY, "start", "side", "ids"])

    return run


@dataclass
class Document:
    """What the machine keeps of the document that it is reading."""

    key: tuple
    copies: int = 0
    sums: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    digest: object = field(default_factory=hashlib.sha256)
    links: list = field(default_factory=list)
    held: int = 0

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        if len(pairs):
            self.links.append((pairs, times))
            self.held += len(pairs)
            if len(self.links) > 1 and self.held > TABLE_PAIRS:
                self.links = [merged(self.links)]
                self.held = len(self.links[0][0]) // 2

    def row(self) -> tuple:
        pairs, times = merged(self.links)
        sha = self.digest.hexdigest() if self.sums[2] else ""
        return (*self.key, self.copies, *self.sums.tolist(), sha, pack(pairs), times.astype("<u4").tobytes())


def merged(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs with the sums of their numbers."""
    tables = [t for t in tables if len(t[0])]
    if len(tables) == 1:
        return tables[0]
    if not tables:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs, numbers = (np.concatenate(x) for x in zip(*tables, strict=True))
    order = np.argsort(pairs, kind="stable")
    pairs, numbers = pairs[order], numbers[order]
    firsts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    return pairs[firsts], np.add.reduceat(numbers, firsts)


def pack(pairs: np.ndarray) -> bytes:
    """Sorted pairs as differences, of four bytes each if all fit."""
    steps = np.diff(pairs, prepend=0)
    return b"\4" + steps.astype("<u4").tobytes() if int(steps.max(initial=0)) < 1 << 32 else b"\10" + steps.astype("<u8").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed[1:], "<u4" if packed[0] == 4 else "<u8").astype(np.int64))


class Sweep:
    """The machine. Rows come sorted by document, offset and side; what it holds is one document's open group, digest and distinct links."""

    def __init__(self, a_lengths: np.ndarray, b_lengths: np.ndarray):
        self.lengths, self.size = (a_lengths, b_lengths), len(b_lengths)
        self.kinds = [_width(len(a_lengths)), _width(len(b_lengths))]
        self.numbers = max(len(a_lengths), len(b_lengths))
        self.words = pa.array([f"{mark}{k}" for mark in ("", ",", ";", "|") for k in range(self.numbers)], pa.string())
        self.open: Document | None = None
        self.last: tuple | None = None
        self._clear()

    def _clear(self) -> None:
        self.pending = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]

    def _tokens(self, side: int, rows: list, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends, in order, of a side; an end is the document's place among those at hand and the offset in it."""
        own = [k for k, row in enumerate(rows) if row[1] == side]
        ids = np.frombuffer(b"".join([rows[k][2] for k in own]), self.kinds[side]).astype(np.int64)
        counts = np.array([len(rows[k][2]) for k in own], np.int64) // np.dtype(self.kinds[side]).itemsize
        ends = np.cumsum(self.lengths[side][ids])
        before = np.concatenate(([0], ends))[np.cumsum(counts) - counts]
        base = (docs[own] << _OFFSET_BITS) + np.array([rows[k][0] for k in own], np.int64) - before
        held_ids, held_ends = self.pending[side]
        return np.concatenate((held_ids, ids)), np.concatenate((held_ends, ends + np.repeat(base, counts)))

    def _links(self, group_docs: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, A id, B id) as one sorted number, and how often each is linked."""
        scale, tables = len(self.lengths[0]) * self.size, []
        a_first, b_first, wide = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb > WIDE
        narrow = np.repeat(~wide, na)
        group = np.repeat(np.arange(len(na)), na)[narrow]
        left = group_docs[group] * scale + a[narrow] * self.size
        pairs = np.repeat(left, nb[group]) + b[textkit.ragged(b_first[group], nb[group])]
        tables.append(np.unique(pairs, return_counts=True))
        for g in np.flatnonzero(wide):  # long stretches without a common end: distinct ids first
            (ua, ca), (ub, cb) = (np.unique(x[f : f + n], return_counts=True) for x, f, n in ((a, a_first[g], na[g]), (b, b_first[g], nb[g])))
            tables.append(((group_docs[g] * scale + ua[:, None] * self.size + ub).ravel(), (ca[:, None] * cb).ravel()))
        return merged(tables)

    def take(self, keys: list[tuple], rows: list[tuple[int, int, bytes]]) -> list[tuple]:
        """Rows (offset, side, ids) and their documents' keys; the documents that end before the last row."""
        docs, fresh, number = [], [], 0
        copies = [0]
        for key, row in zip(keys, rows, strict=True):
            if self.open is None and not number or key != self.last[0]:
                number += 1
                fresh.append(Document(key))
                copies.append(0)
                again = False
            else:
                again = row[:2] == self.last[1]  # the row of a copy
            copies[-1] += row[0] == 0 and row[1] == 0
            docs.append(-1 if again else number)
            self.last = (key, row[:2])
        kept = [k for k, d in enumerate(docs) if d >= 0]
        rows, at = [rows[k] for k in kept], np.array([docs[k] for k in kept], np.int64)
        (a, a_ends), (b, b_ends) = self._tokens(0, rows, at), self._tokens(1, rows, at)
        where = np.searchsorted(b_ends, a_ends)
        a_closes = where < len(b_ends)
        a_closes[a_closes] = b_ends[where[a_closes]] == a_ends[a_closes]
        b_closes = np.zeros(len(b_ends), bool)
        b_closes[where[a_closes]] = True
        a_last, b_last = np.flatnonzero(a_closes), np.flatnonzero(b_closes)
        na, nb = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        a_open, b_open = int(na.sum()), int(nb.sum())
        group_docs = a_ends[a_last] >> _OFFSET_BITS
        every = [self.open, *fresh]
        for doc, n in zip(every, copies, strict=True):
            if doc:
                doc.copies += n
        if len(na):
            self._close(every, group_docs, a[:a_open], b[:b_open], na, nb)
        done = [doc.row() for doc in every[:-1] if doc]
        self.open = every[-1]
        own = (len(every) - 1) << _OFFSET_BITS
        self.pending = [(a[a_open:], a_ends[a_open:] - own), (b[b_open:], b_ends[b_open:] - own)]
        return done

    def _close(self, every: list, group_docs: np.ndarray, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        edges = np.searchsorted(group_docs, np.arange(len(every) + 1))
        sums = [np.concatenate(([0], np.cumsum(x)))[edges] for x in (na, nb, np.ones(len(na), np.int64), na * nb)]
        # the text of the groups: A ids, a bar, B ids; what stands before an id tells where it is
        begun = np.array([bool(doc and doc.sums[2]) for doc in every])
        first = np.concatenate(([True], group_docs[1:] != group_docs[:-1])) & ~begun[group_docs]
        a_first, b_first = np.cumsum(na) - na, np.cumsum(nb) - nb
        marks = np.full(len(a) + len(b), 1, np.int64)
        marks[a_first + b_first] = np.where(first, 0, 2)
        marks[a_first + b_first + na] = 3
        a_places = np.arange(len(a)) + np.repeat(b_first, na)
        ids = np.empty(len(marks), np.int64)
        ids[a_places] = a
        ids[np.arange(len(b)) + np.repeat(a_first + na, nb)] = b
        text = self.words.take(pa.array(marks * self.numbers + ids))
        data, offsets = memoryview(text.buffers()[2]), np.frombuffer(text.buffers()[1], np.int32)
        spans = offsets[np.concatenate((a_first + b_first, [len(marks)]))[edges]].tolist()
        pairs, times = self._links(group_docs, a, b, na, nb)
        scale = len(self.lengths[0]) * self.size
        cuts = np.searchsorted(pairs, np.arange(len(every) + 1) * scale).tolist()
        for k, doc in enumerate(every):
            if doc:
                doc.sums += [x[k + 1] - x[k] for x in sums]
                doc.digest.update(data[spans[k] : spans[k + 1]])
                doc.add(pairs[cuts[k] : cuts[k + 1]] - k * scale, times[cuts[k] : cuts[k + 1]])

    def end(self) -> list[tuple]:
        done = [self.open.row()] if self.open else []
        self.open = self.last = None
        self._clear()
        return done


def _swept(a_path: str, b_path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("hash1", pa.int64()), ("hash2", pa.int32()), ("spread", pa.int32()), *((n, pa.int64()) for n in ("copies", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(*Vocabularies.of(a_path, b_path).lengths())
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            rows = list(zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True))
            sizes, first = np.cumsum([len(r[2]) for r in rows]), 0
            while first < len(rows):
                stop = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + STEP_BYTES, "right")))
                if done := sweep.take(keys[first:stop], rows[first:stop]):
                    yield batch_of(done)
                first = stop
        if done := sweep.end():
            yield batch_of(done)

    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs and the number of documents that link them, of a task's rows, in tables of some millions of pairs."""
    tables, held, floor = [], 0, 0
    as_batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1])], names=["pair", "n"])
    for batch in batches:
        for copies, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pairs = unpack(packed)
            tables.append((pairs, np.full(len(pairs), copies, np.int64)))
            held += len(pairs)
            if held > 2 * floor + TABLE_PAIRS:
                tables = [merged(tables)]
                floor = held = len(tables[0][0])
                if held > TABLE_PAIRS:
                    yield as_batch(tables[0])
                    tables, held, floor = [], 0, 0
    if tables:
        yield as_batch(merged(tables))


def _scored(table):
    """Each document's sums over its links, from the counts of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                copies, packed, times = part.column("copies").to_numpy(), part.column("pairs").to_pylist(), part.column("times").to_pylist()
                own = [unpack(p) for p in packed]
                at = np.searchsorted(pairs, np.concatenate(own))
                edges = np.cumsum([0, *map(len, own)])
                times = np.frombuffer(b"".join(times), "<u4").astype(np.int64)
                n_best, count_sum = (np.diff(np.concatenate(([0], np.cumsum(times * x)))[edges]) for x in (best[at], counts[at]))
                back = pa.array(np.repeat(np.arange(len(own)), copies))
                columns = [part.column("doc_id"), *(part.column(n) for n in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), part.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays([c.take(back) for c in columns], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct link of a document: its row's place, the pair, how often."""
    for batch in batches:
        for row in range(0, batch.num_rows, 64):
            part = batch.slice(row, 64)
            own = [unpack(p) for p in part.column("pairs").to_pylist()]
            back = pa.array(np.repeat(np.arange(len(own)), [len(p) for p in own]))
            times = np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(back) for k in KEY), pa.array(np.concatenate(own)), pa.array(times)], names=[*KEY, "pair", "times"])


def sweep_events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The columns of SWEPT for each distinct row of docs (doc_id, text): the end events of both tokenizers, united, dealt out by document, sorted, and swept.

    `pairs` holds the document's distinct links as A id * size of B + B id (see `unpack`), `times` how often each is linked."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash1"), F.hash(text).alias("hash2"), (F.monotonically_increasing_id() % SPREAD).cast("int").alias("spread"), text.alias("text"))
    events = keyed.mapInArrow(_events(a_path, b_path), EVENTS)
    return events.repartition(*KEY).sortWithinPartitions(*KEY, "start", "side").mapInArrow(_swept(a_path, b_path), SWEPT)


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The columns of ALIGNED for each row of docs (doc_id, text; other columns are ignored): A is a byte-level tokenizers file, B a sentencepiece model with byte fallback.

    A encodes a space and the text, B the text, to which it adds the space; special tokens' strings are plain text. Places where tokens of both end part the document's bytes into groups; the
    A and B tokens of a group are linked. A pair of ids counts as often as there are rows of docs with a link of it. n_best: links whose pair counts as much as any of the same A id; count_sum: the
    counts summed over the links; groups_sha256: of the groups' ids.

    Null and empty texts, and those that either tokenizer's tokens don't spell (a normaliser changed them), have zeros and ''. Null ids are kept; repeated rows are counted each. Long texts are encoded in
    pieces that no token crosses, a text without spaces as one piece. No rows give no rows. Up to `broadcast_pairs` distinct pairs are sent to every task; the counts of more are joined by a shuffle.
    """
    spark = docs.sparkSession
    size = len(Vocabularies.of(a_path, b_path).b_bytes)
    path = scratch_path(spark, "alignment")
    try:
        sweep_events(docs, a_path, b_path).write.option("compression", "zstd").parquet(path)
        swept = spark.read.parquet(path)
        counts = cut(swept.select("copies", "pairs").mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
        if counts.count() <= broadcast_pairs:
            known = counts.toArrow().sort_by("pair")
            pairs, numbers = (known.column(k).to_numpy() for k in ("pair", "n"))
            firsts = np.flatnonzero(np.diff(pairs // size, prepend=-1))
            best = numbers == np.repeat(np.maximum.reduceat(numbers, firsts), np.diff(firsts, append=len(pairs))) if len(pairs) else numbers
            table = spark.sparkContext.broadcast((pairs, numbers, best))
            return cut(swept.select("doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times").mapInArrow(_scored(table), ALIGNED))
        best = counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / size))))
        sums = swept.select(*KEY, "pairs", "times").mapInArrow(_listed, "doc_id long, hash1 long, hash2 int, spread int, pair long, times long").join(best, "pair").groupBy(*KEY)
        sums = sums.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        named = swept.select([F.col(k).alias(f"own_{k}") if k in KEY else F.col(k) for k in swept.columns if k not in ("pairs", "times")])
        both = named.join(sums, [F.col(f"own_{k}").eqNullSafe(sums[k]) for k in KEY], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        none = F.lit(0).cast("long")
        return cut(both.select(F.col("own_doc_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"))
    finally:
        drop_path(spark, path)
