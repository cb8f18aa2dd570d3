"""Language identification by a linear-chain conditional random field over words, so that text that switches languages is told apart word by word.

A word's features are its affixes, its n-grams of bytes (both hashed) and its shares in the lexicons of the languages; transitions between the languages of neighbouring words are learned with
them, on sequences spliced from runs of labelled documents. Forward-backward over every whole document gives each word's chances; the language with the
largest expected share of a document's letters is its language, the share its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.support import small_batches

PREDICTED = "doc_id long, lang_pred string, score double"
UNDETERMINED = "und"
#: a-z and all of the non-ASCII bytes, for text in lower case
_LETTERS = textkit.byte_class((0x61, 0x7A), (0x80, 0xFF))
_LETTER = regex.compile(r"\p{L}")
BUCKETS = 1 << 17
AFFIXES, GRAMS = (1, 2, 3, 4), (2, 3)
#: Words of a document that forward-backward walks one after another; pieces of so many are walked side by side.
STRIDE = 64
_LEAST = 1e-30


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and U+00C0 to U+00DE in lower case."""
    data = textkit.LOWER[data]
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[second] += 0x20
    return data


@dataclass
class Words:
    """The words of a block of texts: the place of each among the distinct ones, the number of each text, and letters in bytes."""

    hashes: np.ndarray
    buckets: np.ndarray
    owners: np.ndarray
    place: np.ndarray
    counts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(block: textkit.Block) -> Words:
        block.data = lowered(block.data)
        starts, ends, firsts = block.words(_LETTERS)
        hashes, first, place = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
        buckets, owners = _features(block, starts[first], ends[first])
        return Words(hashes, buckets, owners, place, np.diff(firsts), ends - starts)


def _features(block: textkit.Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the affixes and n-grams of each word, and the word that each belongs to."""
    sizes, spans = ends - starts, []
    every = np.arange(len(starts))
    for k in AFFIXES:
        own = every[sizes >= k]
        spans += [(own, starts[own], starts[own] + k, 1), (own, ends[own] - k, ends[own], 2)]
    for k in GRAMS:
        counts = np.maximum(sizes - k + 1, 0)
        at = textkit.ragged(starts, counts)
        spans.append((np.repeat(every, counts), at, at + k, 3))
    owners = np.concatenate([s[0] for s in spans])
    salts = np.concatenate([np.full(len(s[0]), s[3] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64) for s in spans])
    hashes = block.hashes(np.concatenate([s[1] for s in spans]), np.concatenate([s[2] for s in spans]))
    return (textkit.mix(hashes ^ salts) % np.uint64(BUCKETS)).astype(np.int64), owners


@dataclass
class LanguageField:
    """The field's weights. `lexicon` holds hashes of words, sorted, and `shares` their shares in each language's lexicon."""

    languages: list[str]
    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray
    shares: np.ndarray
    lexical: np.ndarray

    @staticmethod
    def blank(languages: list[str]) -> LanguageField:
        n = len(languages)
        return LanguageField(languages, np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n), np.zeros(0, np.uint64), np.zeros((0, n)), np.zeros((n, n)))

    def looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's shares in the lexicons, less what an unknown word has."""
        out = np.zeros((len(hashes), len(self.languages)))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            known = self.lexicon[at] == hashes
            out[known] = self.shares[at[known]] - 1.0 / len(self.languages)
        return out

    def scores(self, words: Words) -> np.ndarray:
        """The languages' scores of each distinct word: the mean weight of its affixes and n-grams, and of its shares."""
        n = len(words.hashes)
        total = np.stack([np.bincount(words.owners, self.weights[words.buckets, k], n) for k in range(len(self.languages))], 1) if n else np.zeros((0, len(self.languages)))
        return total / np.sqrt(np.maximum(np.bincount(words.owners, minlength=n), 1))[:, None] + self.looked_up(words.hashes) @ self.lexical


def chances(scores: np.ndarray, counts: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Forward-backward: the chances of the labels at each place of sequences with these numbers of places.

    Sequences are cut into pieces of STRIDE places. A piece is a product of matrices, pieces are chained from these, and then all pieces are walked side by side from both of their ends.
    """
    n_labels = scores.shape[1]
    e = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), _LEAST)
    move, begin = np.exp(step - step.max()), np.exp(start - start.max())
    n_pieces = -(-counts // STRIDE)
    owner = np.repeat(np.arange(len(counts)), n_pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    at, size = (np.cumsum(counts) - counts)[owner] + nth * STRIDE, np.minimum(counts[owner] - nth * STRIDE, STRIDE)
    order = np.argsort(-size, kind="stable")
    at, head, ranked = at[order], (nth == 0)[order], size[order]
    live = np.searchsorted(-ranked, -np.arange(int(ranked.max(initial=0))), "left")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    def normal(x: np.ndarray, axes=-1) -> np.ndarray:
        return x / x.sum(axis=axes, keepdims=True)

    maps = np.repeat(np.eye(n_labels)[None], len(order), axis=0)
    for t, n in enumerate(live.tolist()):
        after = maps[:n] @ move
        if t == 0:
            after[head[:n]] = begin
        maps[:n] = normal(after * e[at[:n] + t, None, :], (1, 2))
    into, out = np.full((len(order), n_labels), 1.0 / n_labels), np.full((len(order), n_labels), 1.0 / n_labels)
    firsts = np.cumsum(n_pieces) - n_pieces
    longest = np.argsort(-n_pieces, kind="stable")
    deep = np.searchsorted(-n_pieces[longest], -np.arange(int(n_pieces.max(initial=0))), "left").tolist()
    for k in range(len(deep) - 1):
        here = rank[firsts[longest[: deep[k + 1]]] + k]
        after = rank[firsts[longest[: deep[k + 1]]] + k + 1]
        into[after] = normal((into[here, None, :] @ maps[here])[:, 0])
    for k in range(len(deep) - 1, 0, -1):
        here = rank[firsts[longest[: deep[k]]] + k]
        before = rank[firsts[longest[: deep[k]]] + k - 1]
        out[before] = normal((maps[here] @ out[here, :, None])[:, :, 0])
    ahead = np.empty_like(e)
    for t, n in enumerate(live.tolist()):
        now = into[:n] @ move
        if t == 0:
            now[head[:n]] = begin
        into[:n] = ahead[at[:n] + t] = normal(now * e[at[:n] + t])
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        ahead[at[:n] + t] = normal(ahead[at[:n] + t] * out[:n])
        out[:n] = normal((e[at[:n] + t] * out[:n]) @ move.T)
    return ahead


def _lexicon(blank: LanguageField, texts: list[bytes], labels: list[int]) -> None:
    """The words of these texts that occur in two of them at least, and their shares in the languages, by relative frequency."""
    block = _joined(texts)
    words = Words.of(block)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    seen = np.unique(words.place * len(texts) + doc) // len(texts)
    counts = np.zeros((len(words.hashes), len(blank.languages)))
    np.add.at(counts, (words.place, np.array(labels)[doc]), 1.0)
    rates = counts / np.maximum(counts.sum(axis=0), 1)
    kept = np.bincount(seen, minlength=len(words.hashes)) >= 2
    blank.lexicon, blank.shares = words.hashes[kept], rates[kept] / rates[kept].sum(axis=1, keepdims=True)


def _joined(texts: list[bytes]) -> textkit.Block:
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    return textkit.Block(np.frombuffer(b"".join(texts), np.uint8), offsets, 0, len(texts))


def learn(languages: list[str], texts: list[bytes], labels: list[int], *, passes: int = 4, rate: float = 0.5, decay: float = 1e-6, length: int = 64, batch: int = 64, seed: int = 0) -> LanguageField:
    """The field of labelled texts. Every other text goes into the lexicon, the others into sequences of `length` words: runs of 4 to 40 words of one text after another, so that languages switch
    inside a sequence. Steps are Adagrad's on the log-likelihood."""
    model = LanguageField.blank(languages)
    _lexicon(model, texts[::2], labels[::2])
    texts, labels = texts[1::2] or texts, labels[1::2] or labels
    words = Words.of(_joined(texts))
    if not len(words.place):
        return model
    n, rng = len(languages), np.random.default_rng(seed)
    per_word = np.bincount(words.owners, minlength=len(words.hashes))
    by_word = np.argsort(words.owners, kind="stable")
    buckets, first_bucket, known = words.buckets[by_word], np.cumsum(per_word) - per_word, model.looked_up(words.hashes)
    scale = 1.0 / np.sqrt(np.maximum(per_word, 1))
    label = np.repeat(np.array(labels), words.counts)
    runs = []
    for first, count in zip((np.cumsum(words.counts) - words.counts).tolist(), words.counts.tolist(), strict=True):
        cuts = first + np.concatenate(([0], np.cumsum(rng.integers(4, 41, size=count // 4 + 1))))
        runs += [(a, min(b, first + count)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if a < first + count]
    squares = [np.full_like(p, 1e-8) for p in (model.weights, model.step, model.start, model.lexical)]
    for _ in range(passes):
        dealt = np.concatenate([np.arange(*runs[k]) for k in rng.permutation(len(runs))])
        for k in range(0, len(dealt), length * batch):
            own = dealt[k : k + length * batch]
            counts = np.full(-(-len(own) // length), length)
            counts[-1] = len(own) - length * (len(counts) - 1)
            place, gold = words.place[own], np.eye(n)[label[own]]
            features = buckets[textkit.ragged(first_bucket[place], per_word[place])]
            at = np.repeat(np.arange(len(own)), per_word[place])
            total = np.stack([np.bincount(at, model.weights[features, j], len(own)) for j in range(n)], 1)
            scores = total * scale[place, None] + known[place] @ model.lexical
            odds = chances(scores, counts, model.step, model.start)
            miss = gold - odds
            inner = np.ones(len(own), bool)
            inner[::length] = False
            here = np.flatnonzero(inner)
            # chances of neighbours' labels, from the chances of the left one and the field's step
            left = odds[here - 1][:, :, None] * _onward(scores, here, counts, model)
            slopes = [
                np.stack([np.bincount(features, (miss[:, j] * scale[place])[at], BUCKETS) for j in range(n)], 1), gold[here - 1].T @ gold[here] - left.sum(axis=0),
                miss[::length].sum(axis=0), known[place].T @ miss,
            ]
            for p, square, slope in zip((model.weights, model.step, model.start, model.lexical), squares, slopes, strict=True):
                slope = slope / len(counts) - decay * p
                square += slope**2
                p += rate * slope / np.sqrt(square)
    return model


def _onward(scores: np.ndarray, here: np.ndarray, counts: np.ndarray, model: LanguageField) -> np.ndarray:
    """For places that have a left neighbour the chances of the label given the neighbour's."""
    behind = _behind(scores, counts, model.step)
    weight = np.exp(model.step - model.step.max())[None] * (np.exp(scores - scores.max(axis=1, keepdims=True)) * behind)[here][:, None, :]
    return weight / np.maximum(weight.sum(axis=2, keepdims=True), _LEAST)


def _behind(scores: np.ndarray, counts: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The backward values of sequences of equal length but the last, each scaled to a sum of one."""
    length, out = int(counts[0]), np.full_like(scores, 1.0 / scores.shape[1])
    e, move = np.maximum(np.exp(scores - scores.max(axis=1, keepdims=True)), _LEAST), np.exp(step - step.max())
    firsts = np.cumsum(counts) - counts
    for t in range(length - 2, -1, -1):
        at = (firsts + t)[counts > t + 1]
        after = (e[at + 1] * out[at + 1]) @ move.T
        out[at] = after / after.sum(axis=1, keepdims=True)
    return out


def _runs(pieces: int, words: int):
    """Of each text `pieces` runs of so many words, spread evenly over all of it; all of a text that has no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                block.data = lowered(block.data)
                starts, ends, firsts = block.words(_LETTERS)
                taken = []
                for first, stop in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                    cuts = np.arange(first, stop, words)
                    if len(cuts) > pieces:
                        cuts = cuts[np.linspace(0, len(cuts) - 1, pieces).astype(np.int64)]
                    own = textkit.ragged(cuts, np.minimum(words, stop - cuts))
                    taken.append(b" ".join(block.data[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), textkit.binary_column(taken)], names=["lang", "words"])

    return run


def fit(docs: DataFrame, *, sample: int = 400, pieces: int = 8, words: int = 40, seed: int = 0) -> LanguageField:
    """The field of docs (doc_id, text, lang) with a lang: of each language `sample` documents drawn by a hash of doc_id, and of each of these `pieces` runs of `words` words spread over
    the whole text. These bounds keep what the driver gathers under about a megabyte a language. Documents without an id or a lang are not taken; of rows with the same id and lang one is."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null")
    # a language's documents are thinned by their hash to a few times the sample before they are ranked, so that no task ranks all of a language
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("size"))
    drawn = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("draw")).join(F.broadcast(sizes), "lang")
    thin = drawn.where((F.pmod(F.shiftrightunsigned("draw", 11), F.lit(1 << 40)) / float(1 << 40)) * F.col("size") < 4 * sample + 50).select("doc_id", "lang", "draw").distinct()
    picked = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))).where(F.col("rank") <= sample).select("doc_id", "lang")
    texts = rows.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = texts.orderBy("doc_id", "lang").select("lang", "text").mapInArrow(_runs(pieces, words), "lang string, words binary").collect()
    languages = sorted({row.lang for row in found})
    if not languages:
        return LanguageField.blank([])
    return learn(languages, [bytes(row.words) for row in found], [languages.index(row.lang) for row in found], seed=seed)


def _predicted(model: LanguageField):
    names = np.array([*model.languages, UNDETERMINED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                ascii_letters = np.concatenate(([0], np.cumsum((block.data | 32) - 97 < 26)))[block.offsets]
                odd = {row: block.text(block.offsets[row], block.offsets[row + 1]) for row in np.flatnonzero(np.diff(ascii_letters) == 0).tolist()}
                words = Words.of(block)
                lettered = words.counts > 0
                lettered[[row for row, text in odd.items() if not _LETTER.search(text)]] = False
                best, score = np.full(len(block), len(model.languages)), np.zeros(len(block))
                if len(words.place) and model.languages:
                    odds = chances(model.scores(words)[words.place], words.counts, model.step, model.start)
                    row = np.repeat(np.arange(len(block)), words.counts)
                    shares = np.stack([np.bincount(row, odds[:, k] * words.sizes, len(block)) for k in range(len(model.languages))], 1)
                    best[lettered] = shares[lettered].argmax(axis=1)
                    score[lettered] = np.minimum(shares[lettered].max(axis=1) / shares[lettered].sum(axis=1), 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(names[best]), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageField) -> DataFrame:
    """The columns of PREDICTED for each row of docs (doc_id, text; other columns are ignored), in one narrow pass over whole texts.

    Null and empty texts, texts without a letter, and all texts if no language was learned are `und` with a score of 0. Null ids are kept, repeated rows are rated each, no rows give no rows; memory
    follows the longest text. Of languages with the same share the first in order is taken.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predicted(model), PREDICTED)


def _labelled(model: LanguageField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED])
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                words = Words.of(block)
                odds = chances(model.scores(words)[words.place], words.counts, model.step, model.start) if len(words.place) else np.zeros((0, 1))
                labels = names[odds.argmax(axis=1)] if len(odds) else names[:0]
                edges = pa.array(np.concatenate(([0], np.cumsum(words.counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.ListArray.from_arrays(edges, pa.array(labels.tolist(), pa.string())), pa.ListArray.from_arrays(edges, pa.array(odds.max(axis=1) if len(odds) else odds[:, 0]))], names=["doc_id", "langs", "chances"])

    return run


def label_words(docs: DataFrame, model: LanguageField) -> DataFrame:
    """doc_id, langs, chances: the likeliest language of each word (run of letters) of each row of docs, and its chance. Texts without words have empty lists; the model knows a language at least."""
    if not model.languages:
        raise ValueError("the model has learned no language")
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_labelled(model), "doc_id long, langs array<string>, chances array<double>")
