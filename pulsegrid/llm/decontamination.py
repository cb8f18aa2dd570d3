"""Benchmark decontamination with a distributed positional inverted index.

`build_index` turns the documents into one row per block of whole texts: the block's sorted distinct terms (64-bit hashes), how
many postings each has, the sorted token positions of all terms, and the block's documents. The index is a Parquet
table in the shared folder. Searches take the test phrases in chunks of bounded size against all blocks. In a block, a
phrase starts from the postings of its globally rarest term, moved by its offset, and is intersected with the postings of the next
rarest, and so on; what is left after the last term is an exact match.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.support import cut, drop_path, scratch_path, small_batches

INDEX = "block long, terms binary, counts binary, gaps binary, doc_ids array<long>, first_words array<long>, n_words array<long>"
#: Bytes of text that a block of the index has at most, if it has more than one document.
INDEX_BYTES = 2 << 20
#: Hashed words of test phrases that one search takes at a time, or up to twice as many; what is shipped to the tasks is about 200 bytes times this.
CHUNK_WORDS = 200_000


def _terms(block: textkit.Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, firsts = block.lowered().words(textkit.ALPHANUMERIC)
    return block.hashes(starts, ends), firsts


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for block in textkit.blocks(batch.column(1), INDEX_BYTES):
            hashes, firsts = _terms(block)
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            heads = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
            counts = np.diff(np.append(heads, len(ranked))).astype(np.int32)
            gaps = np.diff(order, prepend=0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + at]), *(textkit.binary_column([x.tobytes()]) for x in (ranked[heads], counts, gaps)),
                    pa.array([ids[block.first : block.stop]], pa.list_(pa.int64())), pa.array([firsts[:-1]], pa.list_(pa.int64())), pa.array([np.diff(firsts)], pa.list_(pa.int64())),
                ],
                names=["block", "terms", "counts", "gaps", "doc_ids", "first_words", "n_words"],
            )
            at += 1


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Writes the index of docs (doc_id, text; other columns are ignored) to path and returns it. A null text has no words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.mapInArrow(_indexed, INDEX).write.option("compression", "zstd").mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Phrases:
    """Test phrases of items or of pieces of them: distinct runs of hashed words, of up to `width` words, with the items that have them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int):
        runs, lengths, owners = [np.zeros((0, width), np.uint64)], [], []
        for item, words in items:
            if len(words):
                run = min(width, len(words))
                own = np.zeros((len(words) - run + 1, width), np.uint64)
                own[:, :run] = np.lib.stride_tricks.sliding_window_view(words, run)
                runs.append(own)
                lengths.append(np.full(len(own), run, np.uint64))
                owners.append(np.full(len(own), item, np.int64))
        terms = np.concatenate(runs)
        keyed = np.ascontiguousarray(np.column_stack([terms, np.concatenate([np.zeros(0, np.uint64), *lengths])]))
        _, first, back = np.unique(keyed.view(np.dtype((np.void, keyed.itemsize * (width + 1)))).ravel(), return_index=True, return_inverse=True)
        self.width = width
        self.terms, self.lengths = terms[first], keyed[first, width].astype(np.int64)
        pairs = np.unique(np.column_stack([back, np.concatenate([np.zeros(0, np.int64), *owners])]), axis=0)
        self.items, self.item_counts = pairs[:, 1], np.bincount(pairs[:, 0], minlength=len(first))
        self.item_firsts = np.cumsum(self.item_counts) - self.item_counts
        self.vocabulary = np.unique(self.terms[np.arange(width) < self.lengths[:, None]])
        self.order = np.tile(np.arange(width), (len(first), 1))

    def rarest_first(self, counts: np.ndarray) -> Phrases:
        """counts: of the vocabulary in the whole index."""
        if len(self.lengths):
            often = counts[np.minimum(np.searchsorted(self.vocabulary, self.terms), len(counts) - 1)]
            often = np.where(np.arange(self.width) < self.lengths[:, None], often, np.iinfo(np.int64).max)
            self.order = np.argsort(often, axis=1, kind="stable")
        return self


class Postings:
    """One block of the index, decoded."""

    def __init__(self, terms: pa.Scalar, counts: pa.Scalar, gaps: pa.Scalar):
        self.terms = np.frombuffer(terms.as_buffer(), np.uint64)
        self.counts = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.positions = np.cumsum(np.frombuffer(gaps.as_buffer(), np.int32), dtype=np.int64)
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.positions

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's place in the block, and whether it has one."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, bool)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, self.terms[at] == terms

    def has(self, places: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether a posting of the term at this place has this position."""
        keys = (places << 32) | positions
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (positions >= 0)

    def matches(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its first word) of each place where all words of a phrase follow one another, possibly across documents."""
        places, there = self.find(phrases.terms)
        used = np.arange(phrases.width) < phrases.lengths[:, None]
        alive = np.flatnonzero((there | ~used).all(1) & (phrases.lengths > 0))
        rare = phrases.order[alive, 0]
        at = places[alive, rare]
        starts = self.positions[textkit.ragged(self.firsts[at], self.counts[at])] - np.repeat(rare, self.counts[at])
        phrase = np.repeat(alive, self.counts[at])
        for k in range(1, phrases.width):
            offset = phrases.order[phrase, k]
            ok = (phrases.lengths[phrase] <= k) | self.has(places[phrase, offset], starts + offset)
            phrase, starts = phrase[ok], starts[ok]
        return phrase, starts


def _term_counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(terms.as_buffer(), np.uint64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, vocabulary), len(own) - 1)
                    total += np.where(own[at] == vocabulary, np.frombuffer(counts.as_buffer(), np.int32)[at], 0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    return run


def _searched(phrases: Phrases):
    """Blocks of the index to a row for each of their documents: the number of hit words, they as bits, and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                firsts, sizes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                ids, n = batch.column(4)[k].values, len(firsts)
                phrase, starts = Postings(batch.column(1)[k], batch.column(2)[k], batch.column(3)[k]).matches(phrases)
                row = np.searchsorted(firsts, starts, "right") - 1
                inside = starts + phrases.lengths[phrase] <= firsts[row] + sizes[row]
                phrase, starts, row = phrase[inside], starts[inside], row[inside]
                edges = np.zeros(int(sizes.sum()) + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + phrases.lengths[phrase], -1)
                hit = np.cumsum(edges[:-1]) > 0
                held = np.unique(np.stack([np.repeat(row, phrases.item_counts[phrase]), phrases.items[textkit.ragged(phrases.item_firsts[phrase], phrases.item_counts[phrase])]], 1), axis=0)
                cuts = np.searchsorted(held[:, 0], np.arange(n + 1))
                some = np.zeros(n, bool)
                some[row] = True
                total = np.concatenate(([0], np.cumsum(hit)))
                bits = [np.packbits(hit[firsts[d] : firsts[d] + sizes[d]]).tobytes() if some[d] else b"" for d in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.arange(n)), ids, pa.array(sizes), pa.array(total[firsts + sizes] - total[firsts]), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(held[:, 1]))],
                    names=["block", "row", "doc_id", "n_words", "n_hit", "bits", "items"],
                )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_words, bit sets, item lists) to (doc_id, n_words, n_hit, items)."""
    for batch in batches:
        hits, items = [], []
        for sets, lists in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            joined = np.zeros(max((len(s) for s in sets), default=0), np.uint8)
            for s in sets:
                joined[: len(s)] |= np.frombuffer(s, np.uint8)
            hits.append(int(np.bitwise_count(joined).sum()))
            items.append(sorted({i for one in lists for i in one}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "n_words", "n_hit", "items"])


def _item_words(width: int, size: int):
    """The hashed words of items, in pieces of `size` words that overlap, so that each run of `width` words is whole in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in textkit.blocks(batch.column(1)):
                hashes, firsts = _terms(block)
                for item, a, b in zip(ids[block.first : block.stop], firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                    for k in range(a, max(a + 1, b - width + 1), size):
                        yield pa.RecordBatch.from_arrays([pa.array([item], pa.int64()), textkit.binary_column([hashes[k : min(b, k + size + width - 1)].tobytes()])], names=["item_id", "words"])

    return run


def _chunks(items: DataFrame, width: int) -> Iterator[Phrases]:
    """Phrases of pieces of items, as many at a time as have up to about CHUNK_WORDS words."""
    held: list[tuple[int, np.ndarray]] = []
    n_words = 0
    rows = items.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_item_words(width, CHUNK_WORDS), "item_id long, words binary")
    for row in rows.toLocalIterator():
        held.append((row.item_id, np.frombuffer(bytes(row.words), np.uint64)))
        n_words += len(held[-1][1])
        if n_words >= CHUNK_WORDS:
            yield Phrases(held, width)
            held, n_words = [], 0
    if held:
        yield Phrases(held, width)


def _rarest_first(index: DataFrame, phrases: Phrases) -> Phrases:
    """The driver gets a count for each word of the chunk's vocabulary."""
    counts = np.zeros(len(phrases.vocabulary), np.int64)
    for row in index.select("terms", "counts").mapInArrow(_term_counts(phrases.vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row.term] = row.n
    return phrases.rarest_first(counts)


def search(index: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array of item_ids) for each document of an index.

    A phrase is `width` consecutive words of an item, or all words of an item that has fewer; n_hit counts the document's words inside any
    occurrence of a phrase. Items without words or without an id hit nothing; equal phrases of several items count for each of them.
    """
    found, chunks = "block long, row long, doc_id long, n_words long, n_hit long, bits binary, items array<long>", _chunks(items, width)
    first, second = next(chunks, None) or Phrases([], width), next(chunks, None)
    whole = index.mapInArrow(_searched(_rarest_first(index, first)), found)
    if second is None:
        return whole.select("doc_id", "n_words", "n_hit", "items")
    # each chunk's hits are written before the next one is searched for
    path = scratch_path(index.sparkSession, "hits")
    try:
        whole.write.option("compression", "zstd").parquet(path)
        for phrases in chain([second], chunks):
            index.mapInArrow(_searched(_rarest_first(index, phrases)), found).where("n_hit > 0").write.mode("append").option("compression", "zstd").parquet(path)
        every = index.sparkSession.read.schema(found).parquet(path).groupBy("block", "row")
        held = every.agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("bits").alias("sets"), F.collect_list("items").alias("lists")).drop("block", "row")
        return cut(held.mapInArrow(_counted, "doc_id long, n_words long, n_hit long, items array<long>"))
    finally:
        drop_path(index.sparkSession, path)


def _near(phrase_terms: np.ndarray, reach: int, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                firsts, sizes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                post = Postings(batch.column(1)[k], batch.column(2)[k], batch.column(3)[k])
                places, there = post.find(phrase_terms[rank])
                if not there.all():
                    continue
                anchor = post.positions[post.firsts[places[0]] : post.firsts[places[0]] + post.counts[places[0]]]
                row = np.searchsorted(firsts, anchor, "right") - 1
                low, high = np.maximum(anchor - reach, firsts[row]), np.minimum(anchor + reach, firsts[row] + sizes[row] - 1)
                ok = np.ones(len(anchor), bool)
                for place in places[1:]:
                    own = post.positions[post.firsts[place] : post.firsts[place] + post.counts[place]]
                    ok &= np.searchsorted(own, low) < np.searchsorted(own, high, "right")
                ids = np.array(batch.column(4)[k].as_py(), object)[row[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((anchor - firsts[row])[ok], pa.int64())], names=["doc_id", "position"])

    return run


def proximity(index: DataFrame, text: str, reach: int) -> DataFrame:
    """doc_id, position of each occurrence of the rarest word of `text` that has all of its other words within `reach` words on either side in the same document.

    A text without words is found nowhere; a word that is in the text twice counts once. Documents without a text or words have nothing, documents without a doc_id and repeated ones are found each under the id that
    they have; a document of any length is searched whole. An empty index gives no rows.
    """
    words = next(_item_words(1, 1 << 20)(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([text])], names=["i", "t"])]))).column(1)[0].as_py()
    terms = np.unique(np.frombuffer(words, np.uint64))
    if not len(terms):
        return index.sparkSession.createDataFrame([], "doc_id long, position long")
    counts = np.zeros(len(terms), np.int64)
    for row in index.select("terms", "counts").mapInArrow(_term_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row.term] = row.n
    return index.mapInArrow(_near(terms, reach, np.argsort(counts, kind="stable")), "doc_id long, position long")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items for each row of docs (doc_id, text), against items (item_id, text); other columns are ignored.

    A null or wordless text has n_words 0 and hits nothing. Repeated rows are searched each. Rows with a null doc_id keep it. An empty benchmark hits nothing, an empty
    table of documents gives no rows. A text of any length is indexed whole, in a block of its own if it is longer than one. The index lives in the shared folder until the result is made.
    """
    spark: SparkSession = docs.sparkSession
    path = scratch_path(spark, "postings")
    try:
        return cut(search(build_index(docs, path), items, width))
    finally:
        drop_path(spark, path)


def clean(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """docs, all columns, without the rows whose text has a phrase of the items.

    Rows are told apart by doc_id and text together, as one 64-bit hash: of rows that repeat a doc_id those with a clean text stay, and rows without a doc_id go by their text as others do. Null, empty and wordless texts
    have no phrase and stay; repeats of a row share its fate; texts of any length are searched whole. An empty benchmark takes nothing away, an empty table stays empty.
    """
    name = lambda: F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    hit = contamination(docs.select(name().alias("doc_id"), docs["text"]), items, width).where("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, name() == hit["_hit"], "left_anti")
