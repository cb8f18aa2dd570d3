"""Near-duplicate documents by chosen-path set similarity join.

Each document is the set of its word shingles; documents with the same set are one member. Every tree branches the members by a few chosen minwise
values: a member goes to the child of its smallest token under the node's own hash, and with a small chance to a second child, so that two members as similar as
the threshold have one common child on average. The work then goes from cheap to exact:

1. all members go down `trees` trees by two levels, in one narrow pass. Nodes of at most `leaf` rows are compared exhaustively on sketches of 64 minwise values, with a bar far below the threshold;
   larger nodes are branched by two more levels, and what is still large counts as alike as a whole. No pairs are formed: a node gives a spanning forest;
2. the connected members of all trees are a family. A family of at most `cell` members is one cell: its full sets come to one task once, however many trees showed
   it, and are compared exhaustively and exactly;
3. a larger family is branched further, by trees of its own: members next to one another in several orders of their sketches are tried on full sets first, which
   joins most of a group of copies; nodes whose members are of one component are dropped; nodes of at most a cell are compared exactly; what is larger after `rounds` rounds is compared in
   blocks of a cell, all members against those outside of the node's largest component.

A pair at the threshold is missed by ten trees of depth two with a chance of about 3e-7 (85 %) or 2e-6 (80 %), at depth four 4e-5 or 2e-4, and by the sketches with less than 1e-6; closer
pairs far less, and a component is usually held by many links. Only what `percent` of the full sets confirms is a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.components import components
from pulsegrid.llm.support import cut, cut_counted, narrow, partitions, small_batches

COORDINATES = 64
#: Coordinates that a tree has for itself in its first two levels; ten trees have six each.
POOL = 6
#: A pair at the threshold falls under the sketch bar (five deviations) in less than one of a million cases.
DEVIATIONS = 5.0
#: Shingles that a cell has at most, unless it is of two members.
CELL_SHINGLES = 1 << 21
#: Orders in which the members of a large family are tried with their neighbours.
TURNS = 3
#: Nodes up to so many rows give all of their similar pairs, larger ones a spanning forest.
FEW = 8
_SCALES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 3) ** 5 + 0xD1B54A32D192ED03 * k) & ((1 << 64) - 1) | 1 for k in range(COORDINATES)], np.uint64)
NODES = "node long, id long"
PAIRS = "a long, b long"


def _sets(block: textkit.Block, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    starts, ends, firsts = block.lowered().words(textkit.BETWEEN_SPACES)
    words = block.hashes(starts, ends)
    shingles = textkit.windows(words, width)
    for first, stop in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if stop - first >= width:
            found = np.sort(shingles[first : stop - width + 1])
            yield found[np.concatenate(([True], found[1:] != found[:-1]))]
        elif stop > first:
            whole = np.uint64(stop - first)
            for word in words[first:stop]:
                whole = textkit.mix(np.array([whole ^ word]))[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets and two 64-bit sums over each, which name it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    one, two, full = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64), np.flatnonzero(sizes)
    if len(full):
        flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        one[full] = np.add.reduceat(textkit.mix(flat), starts)
        two[full] = np.add.reduceat(textkit.mix(flat ^ textkit._LENGTH), starts)
    return sizes, one.view(np.int64), two.view(np.int64)


def _children(keys: np.ndarray, values: np.ndarray, pool: np.ndarray, spare: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key of child) for each child of the rows at the nodes in keys: by one coordinate of the pool, which the node chooses, and by another with chance `spare`."""
    draw = textkit.mix(keys + np.uint64(0x632BE59BD9B4E019))
    first = draw % np.uint64(len(pool))
    second = (first + np.uint64(1) + (draw >> np.uint64(8)) % np.uint64(len(pool) - 1)) % np.uint64(len(pool))
    more = np.flatnonzero((draw >> np.uint64(20)).astype(np.float64) / float(1 << 44) < spare)
    every = np.arange(len(keys))
    rows = np.concatenate((every, more))
    pick = pool[np.concatenate((first, second[more])).astype(np.int64)]
    return rows, textkit.mix(keys[rows] ^ textkit.mix(values[rows, pick].astype(np.uint64) + (pick.astype(np.uint64) << np.uint64(56))))


def _planted(mins: np.ndarray, trees: int, spare: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of each row's nodes at depth two, sorted by row; each tree has coordinates of its own."""
    rows, keys = [], []
    for tree in range(trees):
        pool = np.arange(tree * POOL, (tree + 1) * POOL) % COORDINATES
        at, key = _children(np.full(len(mins), textkit.mix(np.array([tree + 1], np.uint64) * np.uint64(0xA0761D6478BD642F))[0]), mins, pool[:2], spare)
        deeper, key = _children(key, mins[at], pool[2:], spare)
        rows.append(at[deeper])
        keys.append(key)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(rows, kind="stable")
    return rows[order], keys[order]


def _describe(width: int, trees: int, spare: float):
    """Rows of id, text, text's key to id, key, set size, 128 bits of the set, its sketch of 64 bytes and its nodes at depth two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(1)):
                sets = list(_sets(block, width))
                sizes, one, two = _names(sets)
                full = np.flatnonzero(sizes)
                mins = np.zeros((len(full), COORDINATES), np.uint64)
                if len(full):
                    flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                    for k in range(COORDINATES):
                        mins[:, k] = np.minimum.reduceat(flat * _SCALES[k], starts)
                    mins = textkit.mix(mins)
                sketches = np.zeros((len(sets), COORDINATES), np.uint8)
                sketches[full] = mins & np.uint64(255)
                rows, keys = _planted(mins, trees, spare)
                counts = np.zeros(len(sets) + 1, np.int64)
                counts[full + 1] = np.bincount(rows, minlength=len(full))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, len(block)), batch.column(2).slice(block.first, len(block)), pa.array(sizes), pa.array(one), pa.array(two), textkit.binary_column([row.tobytes() for row in sketches]),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.array(keys.view(np.int64))),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "sketch", "nodes"],
                )

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _deeper(spare: float, levels: int):
    """Rows (node, id, sketch) to the rows (node, id) of their descendants so many levels down."""
    pool = np.arange(COORDINATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False), _sketches(batch.column(2))
            for _ in range(levels):
                rows, keys = _children(keys, values, pool, spare)
                ids, values = ids[rows], values[rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids)], names=["node", "id"])

    return run


def _by_first(handle: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray] | None]):
    """Batches sorted by their first column, whole groups at a time, to the pairs that handle makes of a table and the first column's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                a, b = handle(rows, rows.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                last = batch.column(0)[batch.num_rows - 1]
                heads = batch.column(0).to_numpy(zero_copy_only=False)
                done = int(np.argmax(heads == last.as_py())) if heads[0] != heads[-1] else 0
                if held and held[-1].column(0)[0] != batch.column(0)[0]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                if done:
                    yield from pairs(pa.Table.from_batches([*held, batch.slice(0, done)]))
                    held = []
                held.append(batch.slice(done))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _spans(groups: np.ndarray) -> list[tuple[int, int]]:
    heads = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    return list(zip(heads.tolist(), [*heads[1:].tolist(), len(groups)], strict=True))


def _joined(labels: np.ndarray, order: np.ndarray, probe: Callable[[int], np.ndarray]) -> np.ndarray:
    """Labels of the components, from labels of what is joined already; probe(i) tells the rows that are linked to i. The members of the component that is the largest at the time
    need not be tried: those outside of it are, against all."""
    tried = np.zeros(len(labels), bool)
    while True:
        largest = np.bincount(labels).argmax()
        left = order[~tried[order] & (labels[order] != largest)]
        if not len(left):
            return labels
        tried[left[0]] = True
        found = np.unique(labels[probe(int(left[0]))])
        if len(found) > 1:
            labels[np.isin(labels, found)] = found[0]


def _stars(ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's id with that of its label's first row, but for that row itself."""
    _, first, which = np.unique(labels, return_index=True, return_inverse=True)
    ok = first[which] != np.arange(len(labels))
    return ids[first[which]][ok], ids[ok]


def _alike(bar: int):
    """Rows (node, id, sketch) sorted by node to pairs that connect the rows of a node whose sketches agree in `bar` places."""

    def handle(rows: pa.Table, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, mins = rows.column(1).to_numpy(), _sketches(rows.column(2))
        spans = _spans(nodes)
        counts = np.array([stop - first for first, stop in spans])
        few = np.repeat(counts <= FEW, counts)
        left, right = [], []
        for lag in range(1, FEW):
            at = np.flatnonzero(few[:-lag] & (nodes[lag:] == nodes[:-lag]))
            at = at[(mins[at] == mins[at + lag]).sum(1) >= bar]
            left.append(ids[at])
            right.append(ids[at + lag])
        for first, stop in spans:
            if stop - first > FEW:
                own = mins[first:stop]
                a, b = _stars(ids[first:stop], _joined(np.arange(stop - first), np.arange(stop - first), lambda i, own=own: (own == own[i]).sum(1) >= bar))
                left.append(a)
                right.append(b)
        pairs = np.unique(np.stack((np.minimum(a := np.concatenate(left), b := np.concatenate(right)), np.maximum(a, b))), axis=1)
        return pairs[0], pairs[1]

    return _by_first(handle)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(x) + len(y) - n)


def _unpacked(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), np.uint64) for value in column]


def _exact(percent: int):
    """Rows (cell, id, component, shingles) sorted by cell to the links that connect what is linked in each cell: a forest of pairs."""

    def resolve(ids: np.ndarray, known: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        labels = np.unique(known, return_inverse=True)[1]
        before = labels.copy()
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        tokens, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        rows_of, starts = owner[order].astype(np.int32), np.cumsum(often) - often
        firsts = np.cumsum(sizes) - sizes
        # the rows that share most are tried first, so that a group of copies soon is one component
        central = np.argsort(-np.add.reduceat(often[which], firsts) / sizes, kind="stable")

        def probe(i: int) -> np.ndarray:
            own = which[firsts[i] : firsts[i] + sizes[i]]
            n = np.bincount(rows_of[textkit.ragged(starts[own], often[own])], minlength=len(sets))
            return 100 * n >= percent * (sizes[i] + sizes - n)

        after = _joined(labels, central, probe)
        a, b = _stars(ids, after)
        return (a, b) if (after != before).any() else (a[:0], b[:0])

    def handle(rows: pa.Table, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids, known = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        for first, stop in _spans(cells):
            own, at = np.unique(ids[first:stop], return_index=True)
            at += first
            if len(own) < 2 or (known[at] == known[at[0]]).all():
                continue
            sets = _unpacked(rows.column(3).take(pa.array(at)))
            if len(own) > 2:
                a, b = resolve(own, known[at], sets)
            else:
                a, b = (own[:1], own[1:]) if _linked(*sets, percent) else (own[:0], own[:0])
            left.append(a)
            right.append(b)
        return np.concatenate(left), np.concatenate(right)

    return _by_first(handle)


def _neighbours(percent: int):
    """Rows (family, id, shingles) in some order to the links between rows of a family that follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = [(f, i, np.frombuffer(s.as_buffer(), np.uint64)) for f, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
            pairs = [(x[1], y[1]) for x, y in zip([last, *rows[:-1]], rows, strict=True) if x and x[0] == y[0] and x[1] != y[1] and _linked(x[2], y[2], percent)]
            last = rows[-1] if rows else last
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["a", "b"])

    return run


def _with_sets(width: int):
    """Rows (family, id, set_a, set_b, text) to (family, id, shingles) of those whose text has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textkit.blocks(batch.column(4)):
                sets = list(_sets(block, width))
                own = batch.slice(block.first, len(block))
                _, one, two = _names(sets)
                ok = np.flatnonzero((one == own.column(2).to_numpy()) & (two == own.column(3).to_numpy()))
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(ok)), own.column(1).take(pa.array(ok)), textkit.binary_column([sets[k].tobytes() for k in ok])], names=["family", "id", "shingles"])

    return run


def _sized(rows: DataFrame, by: str, component: str | None = None) -> DataFrame:
    """Rows (by, id, n_shingles, ...) of groups with two members or more, and of two components if that column is given, with the group's n and weight."""
    aggregates = [F.count("*").alias("n"), F.sum("n_shingles").alias("weight")]
    if component:
        aggregates += [F.min(component).alias("low"), F.max(component).alias("high")]
    groups = rows.groupBy(by).agg(*aggregates).where("n > 1")
    if component:
        groups = groups.where("low <> high").drop("low", "high")
    return rows.join(groups, by)


class _Join:
    """One run of the join: its settings and the members' tables."""

    def __init__(self, percent: int, width: int, trees: int, leaf: int, cell: int, rounds: int):
        bar = percent / 100
        self.percent, self.width, self.trees, self.leaf, self.rounds = percent, width, trees, leaf, rounds
        self.bar = int(np.floor(COORDINATES * bar - DEVIATIONS * np.sqrt(COORDINATES * bar * (1 - bar))))
        self.spare = 1 / bar - 1
        self.cell = cell
        self.fits = f"n <= {cell} and (weight <= {CELL_SHINGLES} or n = 2)"

    def weak_links(self, members: DataFrame) -> tuple[DataFrame, int]:
        """Pairs that connect members of alike sketches, by nodes of all trees."""
        planted = members.select(F.explode("nodes").alias("node"), "id")
        sizes = planted.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        nodes, rows = cut_counted(planted.join(sizes, "node"))
        sketches = members.select("id", "sketch")

        def alike(small: DataFrame) -> DataFrame:
            return small.select("node", "id").join(sketches, "id").select("node", "id", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(_alike(self.bar), PAIRS)

        pairs = alike(nodes.where(F.col("n") <= self.leaf))
        large, more = cut_counted(nodes.where(F.col("n") > self.leaf), rows)
        if more:
            deep = large.join(sketches, "id").select("node", "id", "sketch").mapInArrow(_deeper(self.spare, 2), NODES)
            deep, _ = cut_counted(deep.join(deep.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1"), "node"), 2 * more)
            pairs = pairs.unionByName(alike(deep.where(F.col("n") <= self.leaf)))
            pairs = pairs.unionByName(deep.where((F.col("n") > self.leaf) & (F.col("a") < F.col("id"))).select("a", F.col("id").alias("b")))
        return cut_counted(pairs.distinct(), rows)

    def shingles(self, family: DataFrame, texts: DataFrame) -> DataFrame:
        """(family, id, shingles) of rows (family, id, doc_id, set_a, set_b), from the texts of their documents."""
        rows = texts.join(family.hint("shuffle_hash"), "doc_id").select("family", "id", "set_a", "set_b", "text")
        return rows.mapInArrow(_with_sets(self.width), "family long, id long, shingles binary")

    def resolved(self, cells: DataFrame) -> DataFrame:
        """Links of rows (cell, id, component, shingles): a forest in each cell."""
        return cells.select("cell", "id", "component", "shingles").repartition("cell").sortWithinPartitions("cell").mapInArrow(_exact(self.percent), PAIRS)

    def large_families(self, family: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, component) of the members of families larger than a cell, of rows (family, id, n_shingles, sketch, doc_id, set_a, set_b)."""
        spark = family.sparkSession
        sets = cut(self.shingles(family, texts).dropDuplicates(["id"]))
        turned = [F.concat(F.substring("sketch", k + 1, COORDINATES), F.substring("sketch", 1, k)) for k in range(0, COORDINATES, COORDINATES // TURNS + 1)]
        ranked = family.select("id", "family", F.posexplode(F.array(*turned)).alias("turn", "turned")).join(sets.select("id", "shingles"), "id")
        order = ["turn", "family", "turned", "id"]
        beside = ranked.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select(F.xxhash64("turn", "family").alias("family"), "id", "shingles").mapInArrow(_neighbours(self.percent), PAIRS)
        parts = None

        def joined(links: DataFrame) -> DataFrame:
            known = links if parts is None else links.unionByName(parts.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))
            return cut(components(known))

        def with_components(nodes: DataFrame) -> DataFrame:
            rows = nodes.select("node", "id").join(family.select("id", "n_shingles"), "id").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
            return _sized(rows, "node", "component")

        parts = joined(beside)
        nodes = family.select("id", F.explode(F.array(*[F.xxhash64("family", F.lit(tree)) for tree in range(self.trees)])).alias("node"))
        for _ in range(self.rounds):
            deep = nodes.join(family.select("id", "sketch"), "id").select("node", "id", "sketch").mapInArrow(_deeper(self.spare, 2), NODES)
            level = cut(with_components(deep))
            ready = level.where(self.fits).withColumnRenamed("node", "cell")
            parts = joined(self.resolved(ready.join(sets.select("id", "shingles"), "id")))
            nodes, left = cut_counted(level.where(f"not ({self.fits})").select("node", "id"))
            if not left:
                return parts
        return joined(self.resolved(self.blocks(cut(with_components(nodes))).join(sets.select("id", "shingles"), "id")))

    def blocks(self, level: DataFrame) -> DataFrame:
        """Rows (cell, id, component) that hold each member of a node (node, id, component, n, weight) outside of its largest component against all of the node."""
        shares = level.groupBy("node", "component").agg(F.count("*").alias("share"))
        largest = shares.groupBy("node").agg(F.max_by("component", F.struct("share", "component")).alias("largest"))
        rows = level.join(largest, "node").withColumn("n_blocks", F.ceil(2 * F.greatest(F.col("n") / self.cell, F.col("weight") / CELL_SHINGLES)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "n_blocks").cast("int"))
        outside = rows.where("component <> largest")
        probes = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(F.xxhash64("node", "own", "other").alias("cell"), "id", "component")
        # a member goes to as many cells as there are blocks with a member that has to meet it
        asking = outside.select("node", F.col("own").alias("block")).distinct()
        targets = rows.join(asking, "node").select(F.xxhash64("node", "block", "own").alias("cell"), "id", "component")
        return probes.unionByName(targets)


def _rated(docs: DataFrame, percent: int, width: int, trees: int, leaf: int, cell: int, rounds: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and the component's own number, root, of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    join = _Join(percent, width, trees, leaf, cell, rounds)
    same = ["n_shingles", "set_a", "set_b"]
    described = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, sketch binary, nodes array<bigint>"
    rows = cut(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_describe(width, trees, join.spare), described))
    first = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"))
    members = cut(first.withColumn("id", F.monotonically_increasing_id()))
    weak, n_weak = join.weak_links(members)
    named = members.select(*same, F.col("doc_id").alias("component_id"), F.col("id").alias("root"))
    if n_weak:
        texts = docs.where("doc_id is not null and text is not null")
        families = components(weak, n_weak).withColumnRenamed("component", "family")
        family = cut(_sized(families.join(members.drop("nodes"), "id"), "family"))
        stars = join.resolved(join.shingles(family.where(join.fits), texts).withColumnRenamed("family", "cell").withColumn("component", F.col("id")))
        parts = cut(stars.select(F.col("b").alias("id"), F.col("a").alias("component")))
        parts = parts.unionByName(parts.select(F.col("component").alias("id"), "component").distinct())
        large, n_large = cut_counted(family.where(f"not ({join.fits})"), n_weak)
        if n_large:
            parts = parts.unionByName(join.large_families(large, texts))
        owned = parts.join(family.select("id", "doc_id"), "id")
        moved = owned.join(owned.groupBy("component").agg(F.min("doc_id").alias("least")), "component").select("id", "component", "least")
        named = members.join(moved, "id", "left").select(*same, F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("component", "id").alias("root"))
    found = rows.select("doc_id", "text_key", *same).join(named, same, "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "text_key", "n_shingles", whole.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, trees: int = 10, leaf: int = 1024, cell: int = 4096, rounds: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text; other columns are ignored).

    A-Z are lower-cased; words lie between spaces and \\x09-\\x0D; shingles are `width` words, or the whole text if it has fewer.
    Rows are linked if 100 * intersection >= percent * union of their sets. component_id is the smallest doc_id reachable.

    Null or wordless texts have no shingles, link with nothing and are kept. A row with a null doc_id cannot be named by a component: its component_id is null and
    it is kept; it links no others. Rows that repeat a doc_id are rated each by its own text. Texts of any length are taken whole: a cell of two holds two sets at most, a larger one
    CELL_SHINGLES shingles. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _rated(docs, percent, width, trees, leaf, cell, rounds)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs without the near duplicates: of each component one row of its smallest doc_id stays. All columns are kept.
    Rows without a doc_id or without a word stay; of rows that repeat a doc_id and its text one stays, repeats with other texts are rated by their own.
    """
    settings = {"percent": 80, "width": 5, "trees": 10, "leaf": 1024, "cell": 4096, "rounds": 4} | settings
    found = _rated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), **settings)
    kept = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).select(F.col("row.doc_id").alias("kept_id"), F.col("row.text_key").alias("kept_key"))
    alone = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    own_id, own_key = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    once = docs.where(~alone).join(kept, (own_id == kept["kept_id"]) & (own_key == kept["kept_key"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(docs.where(alone))
