"""Moving statistics as scans: many parts of a key, against the same in Spark's windows, which they were before."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators import moving, scan


def over(last):
    return Window.partitionBy("k").orderBy("n").rowsBetween(-8, last)


KINDS = {
    "average": lambda w: F.avg("x").over(w), "geometric_average": lambda w: F.exp(F.avg(F.ln(F.when(F.col("x") > 0, F.col("x")))).over(w)), "harmonic_average": lambda w: 1.0 / F.avg(1.0 / F.when(F.col("x") != 0, F.col("x"))).over(w),
    "variance": lambda w: F.var_pop("x").over(w), "skewness": lambda w: F.skewness("x").over(w), "kurtosis": lambda w: F.kurtosis("x").over(w),
}


@pytest.fixture
def many_parts(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def frame(spark):
    """Two keys; nulls, a NaN, an infinity, runs of equal values, values below zero, a third feature that is the sum of the others for a while."""
    rng, rows = np.random.default_rng(4), []
    for key, n in (("hot", 500), ("few", 5), ("cold", 60)):
        for k in range(n):
            x = 0.1 if 100 <= k < 130 else float(rng.normal(30, 40))
            x = None if k in (50, 71) else float("nan") if k == 200 else float("inf") if k == 240 else -abs(x) if 150 <= k < 170 and x is not None else x
            y = None if k in (60, 300) else float(rng.normal())
            z = x + y if None not in (x, y) and 320 <= k < 360 else float(k % 7)
            rows.append((key, k, x, y, z))
    return spark.createDataFrame(rows, "k string, n long, x double, y double, z double").cache()


def alike(got, want, columns) -> None:
    got, want = (f.select("k", "n", *[F.struct(F.col(c).isNull().alias("none"), F.coalesce(F.col(c), F.lit(0.0)).alias("x")).alias(c) for c in columns]).orderBy("k", "n").collect() for f in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for c in columns:
            assert a[c].none == b[c].none and np.isclose(a[c].x, b[c].x, rtol=1e-9, atol=1e-9, equal_nan=True), (c, a, b)


@pytest.mark.parametrize("kind", list(KINDS))
def test_statistics_of_frames(spark, many_parts, kind):
    rows = frame(spark)
    want = rows.withColumn("statistic", F.when(F.count("x").over(over(-1)) == 8, KINDS[kind](over(-1))))
    got = moving.moving_scores(rows, ["k"], "n", "x", kind, 8)
    alike(got, want.withColumn("score", F.abs(F.col("x") - F.col("statistic"))), ["statistic", "score"])


@pytest.mark.parametrize("kind,bias", [("covariance", True), ("covariance", False), ("correlation_coefficient", True)])
def test_pairs_of_features(spark, many_parts, kind, bias):
    rows = frame(spark).where("(n < 100 or n > 138) and n <> 240")  # without spread Spark's corr is an error, and an infinite value has no covariance
    of = F.corr if kind == "correlation_coefficient" else F.covar_pop if bias else F.covar_samp
    full = F.count("x").over(over(-1)) == 8
    want = rows.withColumn("statistic", F.when(full, of("x", "y").over(over(-1)))).withColumn("score", F.abs(F.when(full, of("x", "y").over(over(0))) - F.col("statistic")))
    alike(moving.moving_pair_scores(rows, ["k"], "n", "x", "y", kind, 8, bias), want, ["statistic", "score"])


def test_distances_of_three_features(spark, many_parts):
    rows = frame(spark).where("not (n between 195 and 250)")
    got = moving.mahalanobis_scores(rows, ["k"], "n", ["x", "y", "z"], 8).toPandas().sort_values(["k", "n"])
    for _, own in got.groupby("k"):
        values = own[["x", "y", "z"]].to_numpy(float)
        for i, score in enumerate(own.score):
            past = values[max(0, i - 8) : i]
            if len(past) < 8 or np.isnan(past).any() or np.isnan(values[i]).any():
                continue
            cov = np.cov(past.T, bias=True)
            if np.linalg.matrix_rank(cov) < 3:
                assert pd.isna(score)
            else:
                gap = values[i] - past.mean(0)
                assert np.isclose(score, np.sqrt(gap @ np.linalg.inv(cov) @ gap), rtol=1e-5)
    assert got.score.notna().sum() > 300 and got[(got.n > 328) & (got.n < 360)].score.isna().all()


def test_one_key_is_read_by_many_tasks(spark, many_parts, monkeypatch):
    dealt, ordered = [], scan.ordered
    monkeypatch.setattr(scan, "ordered", lambda *a: dealt.append(ordered(*a)) or dealt[-1])
    rows = spark.range(900).select(F.lit("s").alias("k"), F.col("id").alias("n"), *[(F.col("id") * m % 101).cast("double").alias(c) for c, m in (("x", 37), ("y", 11), ("z", 29))])
    moving.moving_scores(rows, ["k"], "n", "x", "kurtosis", 8).count()
    moving.mahalanobis_scores(rows, ["k"], "n", ["x", "y", "z"], 8).count()
    assert [d.groupBy(scan.PART).count().count() >= 6 for d in dealt] == [True, True]
