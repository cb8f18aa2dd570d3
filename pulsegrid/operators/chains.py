"""Chains of rows in which each row names the next one, marked by pointer doubling over pieces of the rows, whatever key they are of."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.operators import scan
from pulsegrid.shared import cut


def following(rows: DataFrame, keys: list[str], node: str, place: Column, wanted: Column, *, beyond: bool) -> DataFrame:
    """(keys, node, after): for each row the smallest node among those rows of its key whose place is at least `wanted` (beyond it, if `beyond`); null if there is none.

    Places must not fall as nodes rise. Both sides are united and swept from the largest place down, so no row meets another one.
    """
    own = [F.col(k) for k in keys]
    asked = rows.select(*own, F.col(node).alias("node"), wanted.alias("_at"), F.lit(False).alias("_mark"))
    marks = rows.select(*own, F.col(node).alias("node"), place.alias("_at"), F.lit(True).alias("_mark"))
    both = asked.unionByName(marks)
    first = F.col("_mark").asc() if beyond else F.col("_mark").desc()
    swept = scan.scanned(both, keys, [F.col("_at").desc(), first, F.col("node").desc()], scan.Carried("_mark", {"node": "after"}, both.schema))
    return swept.where("not _mark").select(*keys, "node", "after")


def _contracted(keys: list[str]):
    """Adds _piece, the number of the run of rows of one key that came in one batch, and _exit, the first node beyond its piece on the chain from each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for batch in batches:
            pieces, exits = [], []
            for i, j, _, _ in scan.runs(batch, keys):
                within, after = _inside(batch.column("node").slice(i, j - i), batch.column("after").slice(i, j - i))
                out = after[:]
                for k in range(len(out) - 1, -1, -1):
                    if within[k] >= 0:
                        out[k] = out[within[k]]
                pieces += [piece] * len(out)
                exits += out
                piece += 1
            if pieces:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64()), pa.array(exits, pa.int64())], names=[*batch.schema.names, "_piece", "_exit"])

    return run


def _inside(node: pa.Array, after: pa.Array) -> tuple[list[int], list[int | None]]:
    """For each row of a piece the place in it of the next node, -1 where that lies beyond it or is none; and the next nodes."""
    nodes, wanted = node.to_numpy(zero_copy_only=False), after.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
    return np.where(nodes[at] == wanted, at, -1).tolist(), after.to_pylist()


def _walked(keys: list[str]):
    """The rows of the pieces that lie on the chains from the marked rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in scan.whole_groups(batches, [scan.PART, "_piece"]):
            within, _ = _inside(piece.column("node"), piece.column("after"))
            on = np.zeros(len(within), bool)
            for k in np.flatnonzero(piece.column("_entry").to_numpy(zero_copy_only=False)).tolist():
                while k >= 0 and not on[k]:
                    on[k] = True
                    k = within[k]
            yield piece.filter(pa.array(on)).select([*keys, "node"])

    return run


def _reached(links: DataFrame, heads: DataFrame) -> DataFrame:
    """The points on the chains from heads (at) over links (from, to), each linked to one other at most, by pointer doubling."""
    jumps, new = cut(links), cut(heads)
    marked = new
    while new.take(1):
        new = cut(marked.join(jumps, F.col("at") == F.col("from")).select(F.col("to").alias("at")))
        marked = marked.unionByName(new)
        jumps = cut(jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.from")).select("a.from", "b.to"))
    return marked


def chained(links: DataFrame, keys: list[str], heads: DataFrame) -> DataFrame:
    """(keys, node): the nodes, whole numbers, on the chains that begin at heads (keys, node) and follow links (keys, node, after): a row for each node, after is null or the node of a later row.

    Rows are sorted, and each piece of them, a batch of one key at most, is contracted first: its rows point to the first node beyond it on their chain. The chains over pieces are marked by pointer
    doubling (after round i the first 2^i pieces of each; a pointer leads 2^i pieces on), and each piece then walks from where a chain enters it. Equal nodes of other keys are other
    nodes, null keys are keys.
    """
    point = lambda name: F.struct(*keys, F.col(name).alias("node"))
    parts = scan.ordered(links.select(*keys, F.col("node").cast("long").alias("node"), F.col("after").cast("long").alias("after")), keys, ["node"])
    schema = StructType([*parts.schema.fields, *StructType.fromDDL("_piece long, _exit long").fields])
    pieces = cut(parts.mapInArrow(_contracted(keys), schema))
    entries = _reached(pieces.where("_exit is not null").select(point("node").alias("from"), point("_exit").alias("to")), heads.select(*keys, F.col("node").cast("long").alias("node")).select(point("node").alias("at")))
    marked = pieces.join(entries, point("node") == F.col("at"), "left").withColumn("_entry", F.col("at").isNotNull()).drop("at", "_exit")
    dealt = marked.repartition(scan.PART, "_piece").sortWithinPartitions(scan.PART, "_piece", "node")
    return dealt.mapInArrow(_walked(keys), StructType([pieces.schema[k] for k in [*keys, "node"]]))
