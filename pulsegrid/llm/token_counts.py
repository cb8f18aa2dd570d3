"""Token counts by greedy longest match, in one pass over each word's symbols and without building pieces.

The vocabulary is a trie. Each node has a failure link, to the node that holds the rest of its text once the longest pieces at its
front are taken, and the number of pieces taken on the way. A word's count is the sum of these numbers over the failures that its
symbols cause. Words are bytes closed by an end mark, which pieces ending a word carry as their last symbol.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.support import small_batches

END = 256
_WIDTH = 257
#: Longer words move on alone: steps over all words would be as many as the longest has bytes.
LONG_BYTES = 1024
_automata: dict[str, Automaton] = {}


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces_of(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The symbols of each piece of a tokenizer file's vocabulary; special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special, letters = {t["content"] for t in model["added_tokens"]}, byte_letters()
    found = []
    for token in model["model"]["vocab"]:
        if token not in special:
            body = token.removesuffix(end)
            found.append(tuple(letters[c] for c in body) + ((END,) if body != token else ()))
    return [p for p in found if p]


class Automaton:
    """Trie of symbol tuples with failure links and popped-piece counts. A word that can't be cut into pieces counts as one unknown."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        whole = {}
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in children[node]:
                    children[node][symbol] = len(children)
                    children.append({})
                node = children[node][symbol]
            whole[node] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = [0]
        for node in queue:
            for symbol, child in children[node].items():
                queue.append(child)
                if child in whole:
                    fail[child], pops[child] = 0, 1
                    continue
                back, taken = fail[node], pops[node]
                while back >= 0 and symbol not in children[back]:
                    taken += pops[back]
                    back = fail[back]
                if back >= 0:
                    fail[child], pops[child] = children[back][symbol], taken
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        edges = sorted((node * _WIDTH + symbol, child) for node, own in enumerate(children) for symbol, child in own.items())
        self.edges: dict[int, int] | None = None
        self.links: list[tuple[int, int]] = []
        self.keys, self.next = np.array([k for k, _ in edges], np.int64), np.array([c for _, c in edges], np.int64)

    @staticmethod
    def of(path: str) -> Automaton:
        if path not in _automata:
            _automata[path] = Automaton(pieces_of(path))
        return _automata[path]

    def _step(self, nodes: np.ndarray, symbols: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The nodes after one more symbol; pieces taken are added to the counts of the words; -1 where a word can't go on."""
        nodes = nodes.copy()
        live = np.flatnonzero(nodes >= 0)
        while len(live):
            keys = nodes[live] * _WIDTH + symbols[live]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there = self.keys[at] == keys
            nodes[live[there]] = self.next[at[there]]
            live = live[~there]
            counts[words[live]] += self.pops[nodes[live]]
            nodes[live] = self.fail[nodes[live]]
            live = live[nodes[live] >= 0]
        return nodes

    def _count_one(self, word: bytes) -> int:
        if self.edges is None:
            self.edges, self.links = dict(zip(self.keys.tolist(), self.next.tolist(), strict=True)), list(zip(self.pops.tolist(), self.fail.tolist(), strict=True))
        node = count = 0
        for symbol in (*word, END):
            while (after := self.edges.get(node * _WIDTH + symbol)) is None:
                taken, node = self.links[node]
                count += taken
                if node < 0:
                    return 1
            node = after
        while node > 0:
            taken, node = self.links[node]
            count += taken
        return 1 if node < 0 else count

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; words of at most LONG_BYTES move on together, a symbol at a time."""
        long = np.flatnonzero(ends - starts > LONG_BYTES)
        if len(long):
            counts, short = np.zeros(len(starts), np.int64), np.flatnonzero(ends - starts <= LONG_BYTES)
            counts[short] = self.count(data, starts[short], ends[short])
            counts[long] = [self._count_one(data[a:b].tobytes()) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            return counts
        order = np.argsort(starts - ends, kind="stable")
        sizes = (ends - starts)[order]
        counts, nodes = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        words = order
        for k in range(int(sizes.max(initial=-1)) + 1):
            n = int(np.searchsorted(-sizes, -k, "right"))
            symbols = np.where(sizes[:n] > k, data[np.minimum(starts[order[:n]] + k, len(data) - 1)].astype(np.int64), END)
            nodes[:n] = self._step(nodes[:n], symbols, counts, words[:n])
        lost = nodes < 0
        live = np.flatnonzero(nodes > 0)
        while len(live):  # what the last node holds
            counts[words[live]] += self.pops[nodes[live]]
            nodes[live] = self.fail[nodes[live]]
            lost[live] |= nodes[live] < 0
            live = live[nodes[live] > 0]
        counts[words[lost]] = 1
        return counts


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.of(path)
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                starts, ends, firsts = block.lowered().words(textkit.BETWEEN_SPACES)
                _, first, back = np.unique(block.hashes(starts, ends), return_index=True, return_inverse=True)
                counts = automaton.count(block.data, starts[first], ends[first])[back] if len(first) else np.zeros(0, np.int64)
                sums = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(np.diff(firsts)), pa.array(np.diff(sums[firsts]))], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_words, n_tokens for each row of docs (doc_id, text; other columns are ignored), in one narrow pass.

    A-Z are lower-cased; words lie between spaces and \\x09-\\x0D; n_tokens is the number of pieces that greedy longest match cuts them into.
    Null, empty and wordless texts have 0 of both. Repeated rows are counted each, null ids stay null, texts and words of any length are counted whole, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counted(tokenizer), "doc_id long, n_words long, n_tokens long")
