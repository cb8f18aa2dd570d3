"""Token ids of documents in ascending doc_id order, compressed shard by shard with a Re-Pair grammar.

A token file is a Parquet dataset (SHARD below), so Spark's writers and readers place and find it in any store. Each row is a shard of about
`SHARD_TOKENS` ids of whole documents; `first_id` and `last_id` bound its documents, so that a reader of one of them skips the other shards. Symbols below `len(alphabet)` stand for ids; the others for rules, in order of their making:
each rule is a pair of earlier symbols. `lengths` has each symbol's number of ids, so any range of a document's ids can be
reached without expanding what precedes it. The end id is in no rule, so no rule crosses documents.

Encoding calls the tokenizers library once for each new piece of text that its normaliser and pre-tokenizer can't join with
what surrounds it, and keeps the answers of a worker in a bounded cache.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.support import partitions, small_batches

SHARD = "part long, shard long, first_id long, last_id long, n_tokens long, alphabet binary, rules binary, lengths binary, symbols binary, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>"
SHARD_TOKENS = 1 << 20
CACHE_PIECES = 1_500_000

#: 0 white space, 1 letters, 2 digits, 3 other ASCII signs; 4 joins with its neighbours: apostrophes, controls and non-ASCII bytes
_KIND = np.full(256, 4, np.uint8)
_KIND[33:127] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = _KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[39] = 4
_LETTERS = regex.compile(r"\p{L}+")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes blocks of texts with a tokenizer whose words are lower-cased, split at white space and between ASCII letters, digits and
    signs, and marked at their ends, as word_bpe_49k.json has them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        """Empties the cache: pieces by hash, in a large sorted table and a small one of those learned lately, which is merged into it now and then."""
        self.known, self.late = ((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2))
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces in some order, their ids one after another, and how many each has. Words of letters alone are encoded as one text, up to 500 at a time."""
        letters = _LETTERS.fullmatch
        plain = np.fromiter((letters(p) is not None for p in pieces), bool, len(pieces))
        order, ids, counts = [], [np.zeros(0, np.uint32)], []
        where = np.flatnonzero(plain)
        for k in range(0, len(where), 500):
            own = where[k : k + 500]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in own.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) != len(own):
                plain[own] = False
                continue
            order.append(own)
            ids.append(found)
            counts.append(np.diff(stops, prepend=0))
        other = np.flatnonzero(~plain)
        for k in range(0, len(other), 500):
            own = other[k : k + 500]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in own.tolist()], add_special_tokens=False)]
            order.append(own)
            ids.append(np.array([i for e in found for i in e], np.uint32))
            counts.append(np.array([len(e) for e in found], np.int64))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        order, ids, counts = self._encoded(pieces)
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.late = self._merged(self.late, (keys[order], self.n_ids + np.cumsum(counts) - counts, counts))
        self.n_ids += len(ids)
        if 4 * len(self.late[0]) > len(self.known[0]):
            self.known, self.late = self._merged(self.known, self.late), tuple(x[:0] for x in self.late)

    @staticmethod
    def _merged(one: tuple, two: tuple) -> tuple:
        """Two tables (keys, firsts, counts) as one, sorted by key."""
        joined = [np.concatenate(pair) for pair in zip(one, two, strict=True)]
        order = np.argsort(joined[0], kind="stable")
        return tuple(x[order] for x in joined)

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's first id and number of ids; -1 if it isn't known."""
        firsts, counts = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for own, first, count in (self.known, self.late):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                there = own[at] == keys
                firsts[there], counts[there] = first[at[there]], count[at[there]]
        return firsts, counts

    def block(self, block: textkit.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's rows, one after another, and how many each has."""
        raw = block.data.tobytes()
        whole = any(s in raw for s in self.special)
        texts = {}
        if whole:  # a special token's text is one token wherever it stands
            for row in range(len(block)):
                own = raw[block.offsets[row] : block.offsets[row + 1]]
                if any(s in own for s in self.special):
                    texts[row] = np.array(self.tokenizer.encode(own.decode(), add_special_tokens=False).ids, np.uint32)
        kind = _KIND[block.lowered().data]
        inside = kind > 0
        cut = np.zeros(len(kind) + 1, bool)
        cut[block.offsets[:-1]] = True
        cut[1:-1] |= (kind[1:] != kind[:-1]) & (((kind[1:] < 4) & (kind[:-1] < 4)) | (kind[1:] == 0) | (kind[:-1] == 0))
        cut[-1] = True
        starts = np.flatnonzero(cut[:-1] & inside)
        edges = np.flatnonzero(cut)
        ends = edges[np.searchsorted(edges, starts, "right")]
        hashes = block.hashes(starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        firsts, counts = self._found(distinct)
        if (firsts < 0).any():
            if len(self.known[0]) + len(self.late[0]) + int((firsts < 0).sum()) > CACHE_PIECES:
                self.forget()
                firsts[:] = -1
            new = np.flatnonzero(firsts < 0)
            data = block.data.tobytes()
            self._learn(distinct[new], [data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            firsts, counts = self._found(distinct)
        counts = counts[back]
        ids = self.ids[textkit.ragged(firsts[back], counts)]
        rows = np.searchsorted(starts, block.offsets)
        sums = np.concatenate(([0], np.cumsum(counts)))
        sizes = np.diff(sums[rows])
        if texts:
            split = np.split(ids, np.cumsum(sizes)[:-1])
            for row, own in texts.items():
                split[row], sizes[row] = own, len(own)
            ids = np.concatenate(split)
        return ids, sizes


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and each id's place among them."""
    if not len(ids) or int(ids.max()) > 1 << 24:
        alphabet, symbols = np.unique(ids, return_inverse=True)
        return alphabet, symbols.astype(np.uint32)
    alphabet = np.flatnonzero(np.bincount(ids))
    place = np.zeros(int(alphabet[-1]) + 1, np.uint32)
    place[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    return alphabet, place[ids]


def _chosen(ranked: list[int], pairs: list[int], bits: int) -> np.ndarray:
    """Of groups in the order of their frequency those whose pairs can't overlap one another."""
    lefts, rights, chosen = set(), set(), []
    for k, pair in zip(ranked, pairs, strict=True):
        a, b = pair >> bits, pair & ((1 << bits) - 1)
        if a not in rights and b not in lefts and (a != b or (a not in lefts and b not in rights)):
            lefts.add(a)
            rights.add(b)
            chosen.append(k)
    return np.array(chosen)


def compress(ids: np.ndarray, end: int, least: int = 8, share: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, rules, lengths, symbols): each round replaces the most frequent pairs, as many as can't overlap one another and are at least `share` times as
    frequent as the first; it ends when no pair occurs `least` times. In a run of one symbol pairs are taken from the left.

    A pair that is too rare stays so, and new pairs lie beside new symbols: after the first round only the places of frequent and of new pairs are sorted. A rule takes eight bytes and a
    use saves two. Symbols and rules have two bytes each, or four if there are more than 65,536 symbols.
    """
    alphabet, symbols = _numbered(ids)
    stop = int(np.searchsorted(alphabet, end))
    stop = stop if stop < len(alphabet) and alphabet[stop] == end else -1
    size, rules, lengths = len(alphabet), [np.zeros((0, 2), np.uint32)], np.ones(len(alphabet), np.uint32)
    places = max(1, len(symbols).bit_length())
    shift, low = np.uint64(places), np.uint64((1 << places) - 1)
    at = np.arange(max(0, len(symbols) - 1), dtype=np.int32)
    # a place and its pair are one number; the longest of shards that leaves no bits for that is kept as it is
    while len(at) and 2 * (bits := size.bit_length()) + places <= 64:
        left, right = symbols[at], symbols[1:][at]
        ok = (left != stop) & (right != stop)
        twins = np.flatnonzero(left == right)
        where = at[twins]
        heads = np.concatenate((np.ones(min(1, len(twins)), bool), (where[1:] - where[:-1] > 1) | (left[twins[1:]] != left[twins[:-1]])))
        odd = (where - where[np.maximum.accumulate(np.where(heads, np.arange(len(twins), dtype=np.int32), 0))]) % 2 == 1
        ok[twins[odd]] = False
        own = np.flatnonzero(ok)
        keyed = np.sort(left[own].astype(np.uint64) << np.uint64(bits + places) | right[own].astype(np.uint64) << shift | at[own].astype(np.uint64))
        pairs = keyed >> shift
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1])))
        counts = np.diff(np.append(heads, len(pairs)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        ranked = often[counts[often] >= max(least, share * counts.max())]
        ranked = ranked[np.argsort(-counts[ranked], kind="stable")]
        chosen = _chosen(ranked.tolist(), pairs[heads[ranked]].tolist(), bits)
        made = pairs[heads[chosen]]
        rules.append(np.stack((made >> np.uint64(bits), made & np.uint64((1 << bits) - 1)), 1).astype(np.uint32))
        lengths = np.concatenate((lengths, lengths[rules[-1][:, 0]] + lengths[rules[-1][:, 1]]))
        used = (keyed[textkit.ragged(heads[chosen], counts[chosen])] & low).astype(np.int32)
        rest = np.concatenate(((keyed[textkit.ragged(heads[often], counts[often])] & low).astype(np.int32), where[odd]))
        symbols[used] = np.repeat(np.arange(size, size + len(chosen), dtype=np.uint32), counts[chosen])
        keep = np.ones(len(symbols), bool)
        keep[used + 1] = False
        moved = np.cumsum(keep, dtype=np.int32) - 1
        symbols = symbols[keep]
        size += len(chosen)
        live = np.zeros(len(symbols), bool)
        live[moved[rest[keep[rest]]]] = True
        fresh = moved[used]
        live[fresh] = True
        live[fresh[fresh > 0] - 1] = True
        at = np.flatnonzero(live[:-1]).astype(np.int32)
    width = _width(size)
    return alphabet.astype(np.uint32), np.concatenate(rules).astype(width), lengths, symbols.astype(width)


def _width(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


class Shard:
    """One row of a token file, for decoding."""

    def __init__(self, alphabet: bytes, rules: bytes, lengths: bytes, symbols: bytes):
        self.lengths = np.frombuffer(lengths, np.uint32).astype(np.int64)
        width = _width(len(self.lengths))
        self.symbols = np.frombuffer(symbols, width).astype(np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        expanded = [alphabet[k : k + 4] for k in range(0, len(alphabet), 4)]
        for a, b in np.frombuffer(rules, width).reshape(-1, 2).tolist():
            expanded.append(expanded[a] + expanded[b])
        self.flat = np.frombuffer(b"".join(expanded), np.uint32)

    def ids(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of a range of symbols."""
        own = self.symbols[first:stop]
        return self.flat[textkit.ragged(self.firsts[own], self.lengths[own])]

    def range(self, first: int, stop: int, start: int, end: int) -> np.ndarray:
        """Ids start to end of the document of these symbols; only symbols that cover the range are expanded."""
        sums = np.concatenate(([0], np.cumsum(self.lengths[self.symbols[first:stop]])))
        a, b = max(0, int(np.searchsorted(sums, start, "right")) - 1), int(np.searchsorted(sums, end, "left"))
        return self.ids(first + a, first + b)[start - sums[a] : end - sums[a]]


def _packed(part: int, shard: int, ids: np.ndarray, docs: list[int | None], sizes: np.ndarray, end: int) -> pa.RecordBatch:
    alphabet, rules, lengths, symbols = compress(ids, end)
    sums = np.concatenate(([0], np.cumsum(lengths[symbols].astype(np.int64))))
    doc_symbols = np.diff(np.searchsorted(sums, np.concatenate(([0], np.cumsum(sizes)))))
    named = [d for d in docs if d is not None]
    return pa.RecordBatch.from_arrays(
        [*(pa.array([x], pa.int64()) for x in (part, shard, min(named, default=None), max(named, default=None), len(ids))), *(textkit.binary_column([x.tobytes()]) for x in (alphabet, rules, lengths, symbols)), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([doc_symbols], pa.list_(pa.int64()))],
        names=["part", "shard", "first_id", "last_id", "n_tokens", "alphabet", "rules", "lengths", "symbols", "doc_ids", "doc_tokens", "doc_symbols"],
    )


def _sharded(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, shard = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        docs: list[int | None] = []
        for batch in batches:
            names = batch.column(0).to_pylist()
            for block in textkit.blocks(batch.column(1)):
                ids, counts = encoder.block(block)
                held.append(np.insert(ids, np.cumsum(counts), end))
                sizes.append(counts + 1)
                docs += names[block.first : block.stop]
                if sum(map(len, held)) >= SHARD_TOKENS:
                    yield _packed(part, shard, np.concatenate(held), docs, np.concatenate(sizes), end)
                    held, sizes, docs, shard = [], [], [], shard + 1
        if docs:
            yield _packed(part, shard, np.concatenate(held), docs, np.concatenate(sizes), end)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 1) -> None:
    """Writes the token file of docs (doc_id, text; other columns are ignored), in ascending doc_id order with null ids first; each document ends with `end`.

    A null text is empty and has the end id alone; one longer than a shard is a shard of its own. Rows that repeat a doc_id follow one another. An empty table makes a file without shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    small_batches(spark)
    spread.select("doc_id", "text").mapInArrow(_sharded(tokenizer, end), SHARD).write.option("compression", "zstd").mode("overwrite").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, shard, *payload, docs, tokens, symbols = (batch.column(c)[k].as_py() for c in range(9))
            ids = Shard(*payload).ids()
            assert len(ids) == sum(tokens), "a shard's ids don't fit its documents"
            stops = np.cumsum(tokens, dtype=np.int64)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), tokens, strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x)) for x in (part, shard)), pa.array(docs, pa.int64()), pa.array(stops - np.array(tokens, np.int64)), pa.array(tokens, pa.int64()), pa.array(sums, pa.int64()), pa.array(symbols, pa.int64())], names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32", "n_symbols"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_symbols of each document, from the decoded ids of a token file."""
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("of_part"))  # a row for each part file
    order = Window.partitionBy("part").orderBy("shard")
    starts = sizes.select("part", "shard", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("of_shard")).join(parts, "part")
    rows = shards.drop("first_id", "last_id", "n_tokens").mapInArrow(_decoded, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long, n_symbols long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("of_part") + F.col("of_shard") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")


def read_ids(spark: SparkSession, path: str, doc_id: int, start: int = 0, end: int | None = None) -> list[int]:
    """Ids start to end of one document, decoded from its shard alone."""
    row = spark.read.schema(SHARD).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id))).first()
    if row is None:
        return []
    k = row.doc_ids.index(doc_id)
    first = sum(row.doc_symbols[:k])
    shard = Shard(*(bytes(x) for x in (row.alphabet, row.rules, row.lengths, row.symbols)))
    n = row.doc_tokens[k]
    return shard.range(first, first + row.doc_symbols[k], min(start, n), n if end is None else min(end, n)).tolist()
