"""Cross products of many columns against plain sums, and the scans that they take."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import encode, gram, stats


def wide(spark, columns=60, rows=400):
    rng = np.random.default_rng(7)
    x = rng.integers(-4, 9, (rows, columns)).astype(float) + 1e6 * (np.arange(columns) % 3 == 0)
    x[rng.random((rows, columns)) < 0.1] = np.nan
    x[:, 5] = 0.1
    names = [f"c.{i}" for i in range(columns)]
    data = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    return names, x, spark.createDataFrame(data, ", ".join(f"`{n}` double" for n in names)).repartition(7)


def scans(spark, action):
    """Jobs of an action: one for each shuffle of its plan, and one for its result."""
    tracker, group = spark.sparkContext.statusTracker(), f"scans-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "")
    action()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_correlations_over_complete_pairs(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK", 16)
    names, x, df = wide(spark, 40)
    got = {(r["a"], r["b"]): r["r"] for r in stats.correlation_matrix(df, names).collect()}
    assert len(got) == 40 * 40
    for i in range(0, 40, 3):
        for j in range(40):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 5 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_sixty_numerics_take_no_more_scans_than_a_few(spark):
    names, x, df = wide(spark)
    df = df.withColumn("y", (F.col("`c.1`") > 2).cast("int"))
    for action in (
        lambda some: encode.Ratios.fit(df, some),
        lambda some: gram.cross_correlations(df, some, ["y"]).collect(),
        lambda some: stats.correlation_matrix(df, some).collect(),
    ):
        assert scans(spark, lambda: action(names)) == scans(spark, lambda: action(names[:3]))


def test_ratio_means_are_those_of_finite_quotients(spark):
    names, x, df = wide(spark)
    fills = encode.Ratios.fit(df, names).fills
    assert len(fills) == 60 * 59 // 2
    for i, j in ((0, 1), (1, 2), (7, 30), (5, 8)):
        with np.errstate(all="ignore"):
            quotient = x[:, i] / x[:, j]
        assert fills[names[i], names[j]] == pytest.approx(quotient[np.isfinite(quotient)].mean())


def test_nothing_to_pair(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 0.0)], "a double, b double")
    assert encode.Ratios.fit(df, ["a", "b"]).fills == {}
    rows = gram.cross_correlations(df, ["a", "b"], ["b"]).collect()
    assert {(r["i"], r["j"], r["n"], r["r"]) for r in rows if r["i"] == 0} == {(0, 0, 0, None)}
