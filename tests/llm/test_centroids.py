"""Annulus search against all pairs, the rounds against DuckDB SQL, and rows that are left out."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import centroids as c
from tests.llm.conftest import SF


def test_candidates_hold_the_nearest_and_all_ties():
    rng = np.random.default_rng(3)
    for spread in (2, 50, 4000):
        centres, points = rng.integers(-spread, spread + 1, (16, 8)), rng.integers(-spread, spread + 1, (400, 8))
        centres[5] = centres[2]
        squared = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        number, distance = c.Annuli(centres).nearest(points)
        assert (number == squared.argmin(axis=1)).all() and (distance == squared.min(axis=1)).all()


def test_annulus_leaves_far_norms_out():
    centres = np.outer(np.arange(1, 41) * 100, [1, 0, 0])
    lows, highs = c.Annuli(centres).candidates(np.outer(np.arange(1, 41) * 100 + 3, [1, 0, 0]))
    assert (highs - lows).max() <= 2


def test_large_components_are_exact():
    far = c.largest(64)
    centres, points = np.full((3, 64), -far), np.full((2, 64), far)
    centres[1, 0] += 1
    centres[2, 0] += 1
    number, distance = c.Annuli(centres).nearest(points)
    assert number.tolist() == [1, 1] and distance.tolist() == [63 * (2 * far) ** 2 + (2 * far - 1) ** 2] * 2


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, inertia string").repartition(3)


def test_against_sql(spark):
    got = c.cluster(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.sql(c.ORACLE_SQL).df()
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want[got.columns].astype(str).values)) and len(got) > 100


def test_odd_rows_repeats_and_ties(spark):
    rng = np.random.default_rng(5)
    good = [(k % 40 if k % 9 else None, rng.integers(-3, 4, 64).astype(float).tolist(), 1, "x") for k in range(60)]
    good += good[:7]
    odd = [(100, None, 1, ""), (101, [], 1, ""), (102, [1.0] * 63, 1, ""), (103, [1.0] * 65, 1, ""), (104, [1.0] * 63 + [None], 1, ""), (105, [1.0] * 63 + [float("nan")], 1, ""), (106, [1.0] * 63 + [float("-inf")], 1, "")]
    got = c.cluster(_frame(spark, good + odd)).toPandas()
    assert len(got) == len(good) and got.vec_id.isna().sum() == sum(r[0] is None for r in good)
    assert (got.groupby("cluster").distance.sum() == got.groupby("cluster").cluster_inertia.first()).all() and (got.inertia == got.distance.sum()).all()
    again = c.cluster(_frame(spark, odd + good[::-1])).toPandas()
    assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, again.values.tolist()))


def test_few_vectors_and_none(spark):
    assert c.cluster(_frame(spark, [(1, [0.5] * 64, 0, ""), (2, [-0.5] * 64, 0, "")])).select("vec_id", "distance").distinct().count() == 2
    assert c.cluster(_frame(spark, [(1, [0.5], 0, "")])).count() == 0


def test_components_out_of_bounds_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        c.cluster(_frame(spark, [(1, [3e30] * 64, 0, "")])).count()
