"""Centroid clustering of integer vectors, each vector's nearest centroid by annulus search.

Centroids are sorted by norm. A vector's distance to the centroid whose norm is next to its own bounds the distance to its nearest one from above, and
a centroid whose norm differs by more than that bound can't be nearer: binary search finds the others, and these are compared exactly, in
integers, ties included. A round is one narrow pass over the vectors; a task hands on the sums of each cluster, and nothing else moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkit
from pulsegrid.llm.support import cut, small_batches

CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Pairs of a vector and a candidate that are compared at once.
PAIRS = 1 << 16


def largest(width: int) -> int:
    """The bound of components under which squared distances of so many components fit in 64 bits."""
    return int((2**61 / width) ** 0.5)


def _integers(batch: pa.RecordBatch, width: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """The ids and integer components of the batch's vectors that have width components, all of them finite numbers."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), width), False)
    rows = batch.filter(whole)
    flat = rows.column(1).flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(flat).all(axis=1)
    scaled = np.floor(flat[finite] * scale)
    if len(scaled) and np.abs(scaled).max() > largest(width):
        raise ValueError(f"components times {scale} beyond {largest(width)}: their squared distances don't fit in 64 bits")
    return rows.column(0).filter(pa.array(finite)), scaled.astype(np.int64)


class Annuli:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids * centroids).sum(axis=1).astype(np.float64))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.number], centroids[self.number]

    def _squared(self, vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
        gaps = vectors - self.centroids[places]
        return np.einsum("ij,ij->i", gaps, gaps)

    def candidates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the first and the last place but one, in the order of norms, of the centroids that may be nearest."""
        norms = np.sqrt((vectors * vectors).sum(axis=1).astype(np.float64))
        above = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        beside = np.where(norms - self.norms[below] < self.norms[above] - norms, below, above)
        bound = np.sqrt(self._squared(vectors, beside).astype(np.float64))
        bound += 1e-9 * (bound + norms) + 1e-9  # roots are rounded: what lies on the annulus stays in
        return np.searchsorted(self.norms, norms - bound, "left"), np.searchsorted(self.norms, norms + bound, "right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid, of equally near ones that with the smallest number, and the squared distance."""
        number, distance = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        lows, highs = self.candidates(vectors) if len(vectors) else (number, number)
        sums = np.cumsum(highs - lows)
        first = 0
        while first < len(vectors):
            before = sums[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(sums, before + PAIRS, "right")))
            counts = (highs - lows)[first:stop]
            places = textkit.ragged(lows[first:stop], counts)
            squared = self._squared(np.repeat(vectors[first:stop], counts, axis=0), places)
            starts = np.cumsum(counts) - counts
            least = np.minimum.reduceat(squared, starts)
            ties = np.where(squared == np.repeat(least, counts), self.number[places], len(self.number))
            number[first:stop], distance[first:stop] = np.minimum.reduceat(ties, starts), least
            first = stop
        return number, distance


def _points(width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, points = _integers(batch, width, scale)
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(points), pa.list_(pa.int64()))], names=["vec_id", "point"])

    return run


def _sums(centroids: np.ndarray, width: int, scale: int):
    """A task's count and component sums of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, counts, sums = Annuli(centroids), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            _, points = _integers(batch, width, scale)
            number, _ = annuli.nearest(points)
            counts += np.bincount(number, minlength=len(centroids))
            np.add.at(sums, number, points)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(full))), pa.array(np.repeat(counts[full], width)), pa.array(sums[full].ravel())],
            names=["cluster", "place", "n", "total"],
        )

    return run


def _assigned(centroids: np.ndarray, width: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batches:
            ids, points = _integers(batch, width, scale)
            number, distance = annuli.nearest(points)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, *, width: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """The columns of CLUSTERED for each row of vectors (vec_id, embedding; other columns are ignored) that has `width` components, all finite numbers.

    A component x counts as floor(scale * x). Centroids start as the vectors with the smallest sha256 of `seed:vec_id`, fewer if there are fewer vectors; a null id comes after all
    others, repeated ids in the order of their components. Each round assigns every vector and moves each non-empty centroid to the floors of its vectors' means; then vectors are assigned once more.

    Rows with a null, shorter or longer vector, or with a null or non-finite component, are left out; null ids and repeated rows are kept, each for itself. No vectors, no rows. A component too large for
    distances of 64 bits is an error (see `largest`). What goes through the driver are the centroids: clusters times width numbers a round.
    """
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.mapInArrow(_points(width, scale), "vec_id long, point array<long>").orderBy(drawn.asc_nulls_last(), "point").limit(clusters).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], CLUSTERED)
    centroids = np.array([row.point for row in first], np.int64)
    for _ in range(rounds):
        parts = rows.mapInArrow(_sums(centroids, width, scale), "cluster int, place int, n long, total long")
        whole = parts.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        for row in whole:
            centroids[row.cluster, row.place] = int(row.total) // int(row.n)
    assigned = cut(rows.mapInArrow(_assigned(centroids, width, scale), "vec_id long, cluster int, distance long"))
    inertia = {row.cluster: int(row.own) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(k, own, sum(inertia.values()), digests[k]) for k, own in sorted(inertia.items())]
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, k, d FROM (SELECT rid, k, d, row_number() OVER (PARTITION BY rid ORDER BY d, k) AS n FROM
(SELECT p.rid, c.k, sum((p.x - c.x) * (p.x - c.x)) AS d FROM parts p JOIN c{r} c ON c.i = p.i GROUP BY p.rid, c.k) t) u WHERE n = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{r} c LEFT JOIN
(SELECT a.k, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN parts p ON p.rid = a.rid GROUP BY a.k, p.i) m ON m.k = c.k AND m.i = c.i)""")
    return ",\n".join(steps)


#: The same rounds over all pairs of vectors and centroids, for tables of up to some thousands of vectors.
ORACLE_SQL = f"""WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS MATERIALIZED (SELECT rid, unnest(v) AS x, unnest(range(64)) AS i FROM kept),
c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS k, v FROM kept) t WHERE k < 16),
{_rounds(3)},
own AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY k),
names AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY k)
SELECT kept.vec_id, CAST(a3.k AS INTEGER) AS cluster, CAST(a3.d AS BIGINT) AS distance, own.cluster_inertia, CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia, names.centroid_sha256
FROM kept JOIN a3 ON a3.rid = kept.rid JOIN own ON own.k = a3.k JOIN names ON names.k = a3.k"""
