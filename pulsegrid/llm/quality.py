"""Quality rules: base counts, and a linear-chain conditional random field that labels lines content or boilerplate.

The field is fitted on a bounded sample of labelled documents: each line of a good document is taken as content, each line of a bad one as
boilerplate, so that its weights tell what lines of either kind look like and how labels follow one another. Viterbi decoding
labels the lines of every whole document; the share of its words on content lines decides whether it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.support import small_batches

_SYMBOLS = textkit.byte_class(*((b, b) for b in b"#*$%&|<>"))
_UPPER, _LOWER, _DIGIT = textkit.byte_class((65, 90)), textkit.byte_class((97, 122), (128, 255)), textkit.byte_class((48, 57))
_MARKS = textkit.byte_class((33, 47), (58, 64), (91, 96), (123, 126))
_LINE = ~textkit.byte_class((10, 10))
_HEADS = ~textkit.byte_class((0x80, 0xBF))
FEATURES = 13
REPEAT_WINDOW = 5


@dataclass
class Measures:
    """A block's counts by document and features by line."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def _summed(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends] - total[starts]


def measure(block: textkit.Block) -> Measures:
    data, n = block.data, len(block)
    starts, ends, firsts = block.words(textkit.BETWEEN_SPACES)
    words = block.hashes(starts, ends)
    grams = textkit.windows(words, REPEAT_WINDOW)
    repeated = np.zeros(len(words) + 1, np.int64)
    for first, stop in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        own = grams[first : max(first, stop - REPEAT_WINDOW + 1)]
        order = np.sort(own)
        if len(twice := order[1:][order[1:] == order[:-1]]):
            at = first + np.flatnonzero(np.isin(own, twice))
            np.add.at(repeated, at, 1)
            np.add.at(repeated, at + REPEAT_WINDOW, -1)
    marked = np.cumsum(repeated)[:-1] > 0

    heads = _HEADS[data]
    inside = textkit.BETWEEN_SPACES[data]
    line_starts, line_ends, line_firsts = block.words(_LINE)
    low, high = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    hashes, line_doc = block.hashes(line_starts, line_ends), textkit.row_of(line_firsts)
    real = high > low
    line_starts, line_ends, low, high, hashes, line_doc = (x[real] for x in (line_starts, line_ends, low, high, hashes, line_doc))
    order = np.lexsort((np.arange(len(hashes)), hashes, line_doc))
    again = np.zeros(len(hashes), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (line_doc[order[1:]] == line_doc[order[:-1]])

    size = (line_ends - line_starts).astype(float)
    n_words = (high - low).astype(float)
    share = lambda table: _summed(table[data], line_starts, line_ends) / size
    upper, lower = _summed(_UPPER[data], line_starts, line_ends), _summed(_LOWER[data], line_starts, line_ends)
    symbols = share(_SYMBOLS)
    adjacent = np.concatenate((words[1:] == words[:-1], [False])) if len(words) else np.zeros(0, bool)
    last = data[line_ends - 1] if len(line_ends) else data[:0]
    features = np.stack(
        [
            np.ones(len(size)), np.minimum(n_words, 60) / 60, n_words < 4, np.minimum(size / np.maximum(n_words, 1), 20) / 20, np.minimum(symbols * 8, 1), symbols > 0.03,
            upper / np.maximum(upper + lower, 1), upper > lower, np.minimum(share(_DIGIT) * 4, 1), np.minimum(share(_MARKS) * 5, 1), again,
            np.minimum(_summed(marked, low, high) / np.maximum(n_words, 1) + _summed(adjacent, low, high) / np.maximum(n_words, 1), 1), (last == 46) | (last == 33) | (last == 63),
        ],
        1,
    ).astype(np.float64)
    by_doc = lambda flags: _summed(flags, block.offsets[:-1], block.offsets[1:])
    return Measures(
        np.diff(firsts), by_doc(inside & heads), by_doc(_SYMBOLS[data]), np.bincount(line_doc[again], minlength=n), _summed(marked, firsts[:-1], firsts[1:]), line_doc, high - low, features,
    )


@dataclass
class LineField:
    """Weights of the field: label 1 is content, 0 is boilerplate. All zero: every line is content."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    @staticmethod
    def _padded(scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines as (step, sequence), and each line's cell in it."""
        cell = (np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts), np.repeat(np.arange(len(counts)), counts))
        out = np.zeros((int(counts.max(initial=0)), len(counts), scores.shape[1]))
        out[cell] = scores
        return out, cell

    def decode(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels of sequences with these numbers of lines, in step over all sequences; ties go to content."""
        order = np.argsort(-counts, kind="stable")
        ranked = counts[order]
        # lines by step, then by sequence from the longest on: as many cells as lines, whatever their lengths
        live = np.searchsorted(-ranked, -np.arange(int(ranked.max(initial=0))), "left")
        firsts, steps = (np.cumsum(counts) - counts)[order], np.cumsum(live) - live
        scores = features @ self.emit
        back = np.zeros((len(scores), 2), np.int8)
        best = self.start + scores[firsts[: live[0]]] if len(live) else np.zeros((0, 2))
        for t in range(1, len(live)):
            n, at = live[t], steps[t]
            ways = best[:n, :, None] + self.step
            back[at : at + n] = ways[:, 1] >= ways[:, 0]
            best[:n] = ways.max(1) + scores[firsts[:n] + t]
        labels = np.zeros(len(scores), np.int8)
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for t in range(len(live) - 1, -1, -1):
            n, at = live[t], steps[t]
            labels[firsts[:n] + t] = state[:n]
            state[:n] = back[np.arange(at, at + n), state[:n]]
        return labels

    def fit(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 1e-3) -> LineField:
        """Gradient ascent (Adam) on the mean log-likelihood of the sequences' labels."""
        x, cell = self._padded(features, counts)
        used = np.zeros(x.shape[:2], bool)
        used[cell] = True
        y = np.zeros(x.shape[:2], np.int64)
        y[cell] = labels
        gold = np.eye(2)[y] * used[:, :, None]
        weight = 1.0 / max(1, len(labels))
        params = [self.emit, self.step, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for turn in range(1, rounds + 1):
            score = x @ self.emit
            ahead, behind = np.zeros_like(score), np.zeros_like(score)
            ahead[0] = self.start + score[0]
            for t in range(1, len(x)):
                ahead[t] = np.where(used[t][:, None], np.logaddexp(ahead[t - 1][:, :1] + self.step[0], ahead[t - 1][:, 1:] + self.step[1]) + score[t], ahead[t - 1])
            for t in range(len(x) - 2, -1, -1):
                after = behind[t + 1] + score[t + 1]
                behind[t] = np.where(used[t + 1][:, None], np.logaddexp(self.step[:, 0] + after[:, :1], self.step[:, 1] + after[:, 1:]), 0)
            norm = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
            odds = np.exp(np.minimum(ahead + behind - norm[None, :, None], 0)) * used[:, :, None]
            pair = np.exp(np.minimum(ahead[:-1, :, :, None] + self.step + (score[1:] + behind[1:])[:, :, None, :] - norm[None, :, None, None], 0)) * used[1:, :, None, None]
            slopes = [
                np.tensordot(x, gold - odds, ([0, 1], [0, 1])),
                np.einsum("tsi,tsj->ij", gold[:-1] * used[1:, :, None], gold[1:]) - pair.sum((0, 1)),
                (gold[0] - odds[0]).sum(0),
            ]
            for k, (p, slope) in enumerate(zip(params, slopes, strict=True)):
                slope = slope * weight - decay * p
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                p += rate * first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
        return self


def _lines_of(piece: int, pieces: int):
    def spread(rows: np.ndarray) -> bytes:
        cuts = np.arange(0, len(rows), piece)
        if len(cuts) > pieces:
            rows = rows[textkit.ragged(cuts[np.linspace(0, len(cuts) - 1, pieces).astype(np.int64)], np.full(pieces, piece)).clip(0, len(rows) - 1)]
        return rows.astype(np.float32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                m = measure(block)
                cuts = np.searchsorted(m.line_doc, np.arange(len(block) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), textkit.binary_column([spread(m.features[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])], names=["quality", "features"])

    return run


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = 1000, piece: int = 64, pieces: int = 16) -> LineField:
    """The field of the lines of `sample` documents of each quality (0 and 1) at most, those with the smallest hash of doc_id.

    The bounds keep what the driver gathers small: texts are cut into pieces of `piece` lines, and of a longer text `pieces` of them, spread evenly over all of it, are fitted. With no
    labelled documents of one of the two kinds the field stays zero, which calls every line content.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("draw", F.xxhash64("doc_id"))
    picked = rated.where("quality = 0").orderBy("draw", "doc_id").limit(sample).unionByName(rated.where("quality = 1").orderBy("draw", "doc_id").limit(sample)).withColumnRenamed("doc_id", "rated_id")
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == picked["rated_id"]).groupBy("rated_id").agg(F.first("quality").cast("long").alias("quality"), F.min("text").alias("text"))
    found = rows.orderBy("rated_id").select("quality", "text").mapInArrow(_lines_of(piece, pieces), "quality long, features binary").collect()
    lines, counts, marks = [], [], []
    for row in found:
        own = np.frombuffer(bytes(row.features), np.float32).reshape(-1, FEATURES)
        for k in range(0, len(own), piece):
            part = own[k : k + piece]
            lines.append(part)
            counts.append(len(part))
            marks.append(np.full(len(part), row.quality))
    if len({row.quality for row in found}) < 2 or not lines:
        return LineField()
    return LineField().fit(np.concatenate(lines).astype(np.float64), np.array(counts), np.concatenate(marks))


def _rated(model: LineField, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                m, n = measure(block), len(block)
                good = model.decode(m.features, np.bincount(m.line_doc, minlength=n)) == 1
                total = np.bincount(m.line_doc, m.line_words, n)
                share = np.where(total > 0, np.bincount(m.line_doc[good], m.line_words[good], n) / np.maximum(total, 1), 0.0)
                failed = (m.n_words < 10) | (100 * m.n_repeat_words > 20 * m.n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, n), *(pa.array(x.astype(np.int64)) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)), pa.array(failed), pa.array(~failed & (share >= least)), pa.array(share)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
                )

    return run


RATED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def rate(docs: DataFrame, model: LineField, least_content: float = 0.5) -> DataFrame:
    """The columns of RATED for each row of docs (doc_id, text; other columns are ignored).

    Null, empty and wordless texts have counts of 0 and fail the base rules. Repeated rows are rated each; null ids are kept as null. A text of any length is rated whole, in memory in proportion to it. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_rated(model, least_content), RATED)


def _passing(model: LineField, least: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = _rated(model, least)
        for batch in batches:
            two = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            flags = [b.column(7) for b in verdict(iter([two]))]
            if flags:
                yield batch.filter(pa.concat_arrays(flags))

    return run


def keep_good(docs: DataFrame, model: LineField, least_content: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows that `rate` does not keep; one narrow pass.

    Null, empty and wordless texts fail the base rules and go. Rows without a doc_id and repeated rows are rated each by their texts; a text of any length is rated whole. An empty table stays empty."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_passing(model, least_content, docs.columns.index("text")), docs.schema)
