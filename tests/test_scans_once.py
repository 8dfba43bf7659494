"""Inputs that are dear to compute are computed once, whatever reads them afterwards."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from scoreloom.operators import boosting, models, stats
from scoreloom.params import ScoringParams
from scoreloom.plans import prepare
from scoreloom.queries import aggregates, statistics
from scoreloom.queries.frame import NUMERIC_FEATURES
from scoreloom.session import materialize

N = 300


@pytest.fixture
def counted(spark):
    """Rows of a frame and the number of rows computed so far."""
    computed = spark.sparkContext.accumulator(0)

    def seen(x):
        computed.add(1)
        return x

    # as one that is not deterministic it stays below filters
    seen = F.udf(seen, "long").asNondeterministic()
    rows = spark.range(0, N, 1, 3).select(seen(F.col("id")).alias("id"))
    rows = rows.select(
        "*",
        *[(F.col("id") * (i + 3) % 41).alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
        (F.col("id") % 41 > 20).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, "t1").otherwise("train").alias("dataset"),
        F.col("id").cast("string").alias("l_returnflag"),
    )
    return rows, computed


@pytest.mark.parametrize("kind", ["dt", "rf"])
def test_a_fit_computes_its_rows_once(counted, kind):
    rows, computed = counted
    settings = models.forest(numTrees=3) if kind == "rf" else models.single_tree()
    model = models.fit_model(rows, ["qty", "p_size"], "y", kind, settings)
    assert computed.value == N
    assert sum(model.importances.values()) == pytest.approx(1)


def test_a_forest_gets_its_rows_dealt_evenly(spark):
    rows = spark.range(0, 600_000, 1, 1).select(F.xxhash64("id").cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    lopsided = rows.union(rows.filter("x is null"))
    with models._vectors(lopsided, ["x"], "y", models._vector(["f0"]), even=True) as even:
        sizes = even.rdd.glom().map(len).collect()
    assert sum(sizes) == 600_000 and max(sizes) < 400_000 and len(sizes) <= 8


def test_bands_and_stumps_compute_their_rows_once(counted):
    rows, computed = counted
    banded = models.tree_bands(rows, "qty", "y", "band")
    assert computed.value == N
    assert banded.count() == N
    before = computed.value
    out = stats.stump_feature(rows, ["id", "qty", "l_tax"], "y")
    assert computed.value - before == N
    assert len(out.columns) > len(rows.columns)


@pytest.mark.parametrize("module, name", [(statistics, "data_drift"), (aggregates, "eda_compare")])
def test_queries_compute_their_frame_once(spark, counted, monkeypatch, module, name):
    rows, computed = counted
    monkeypatch.setattr(module, "frame", lambda *_: rows)
    assert getattr(module, name)(spark, "").collect()
    assert computed.value == N


@pytest.mark.parametrize("name", ["labelled_union", "union_splits"])
def test_unions_of_splits_compute_their_frame_once(spark, counted, monkeypatch, name):
    rows, computed = counted
    split = F.when(F.col("id") % 3 == 0, "test").otherwise("train")
    rows = rows.withColumns({"l_orderkey": F.col("id"), "score": F.col("id") / N, "dataset": split})
    monkeypatch.setattr(aggregates, "frame", lambda *_: rows)
    assert len(getattr(aggregates, name)(spark, "").collect()) == N
    assert computed.value == N


@pytest.mark.parametrize("classes", [2, 3])
def test_an_elimination_reads_its_rows_once_a_step(spark, monkeypatch, classes):
    """Held-out rows are tested where the fit has stored them, and are dealt out once for all steps."""
    rows = spark.range(N).select("id", *[(F.col("id") * (i + 3) % 41).alias(c) for i, c in enumerate(NUMERIC_FEATURES)])
    rows = materialize(rows.withColumn("y", F.col("qty") % classes))
    read, dealt = [], []
    doubles, hint = boosting.doubles, type(rows).hint
    monkeypatch.setattr(boosting, "doubles", lambda *a, **k: read.append(1) or doubles(*a, **k))
    monkeypatch.setattr(type(rows), "hint", lambda self, name, *a: dealt.append(name) or hint(self, name, *a))
    fold = F.xxhash64("id")
    steps = models.recursive_elimination(rows, NUMERIC_FEATURES, "y", fold, keep=3, folds=3, rounds=2, classes=classes).collect()
    assert len(read) == len(steps) == 2 and dealt == ["rebalance"]
    monkeypatch.undo()
    settings = models.boosted(rounds=2)
    narrow = rows.select(F.pmod(fold, F.lit(3)).cast("int").alias("_fold"), F.col("y").alias("_target"), *NUMERIC_FEATURES)
    *held_out, _ = boosting.fit(narrow, NUMERIC_FEATURES, "_target", classes, settings, F.col("_fold"), 3)
    counts = np.zeros((classes, classes), dtype=int)
    for r in boosting.out_of_fold(narrow, held_out, "_target", F.col("_fold")).collect():
        counts[r["y"], r["predicted"]] = r["n"]
    assert counts.sum() == N
    assert steps[0]["f1_macro"] == models._macro_f1(counts)


def test_preparation_stores_its_wide_frames_with_code_that_the_jvm_compiles(spark, monkeypatch):
    limit = "spark.sql.codegen.hugeMethodLimit"
    used = {}

    def noted(df, name="stage"):
        used[name] = int(spark.conf.get(limit))
        return materialize(df, name)

    monkeypatch.setattr(prepare, "materialize", noted)
    rows = spark.range(1500).select(
        "id", ((F.col("id") * 7) % 90).alias("a"), ((F.col("id") * 11) % 40 + 1).alias("b"), F.lit("2020-01").alias("obs"),
        ((F.col("id") * 7) % 90 + F.pmod(F.hash("id"), F.lit(300)) > 190).cast("int").alias("y"),
    )
    params = ScoringParams(criterion_column="y", observation_date_column="obs", columns_to_exclude=["obs"])
    before = spark.conf.get(limit)
    prepared = prepare.prepare(rows, params, ["id"], bucket=F.col("id") * 7919)
    assert prepared.features and used["prepared"] == used["clean"] == 8000
    assert spark.conf.get(limit) == before


@pytest.mark.parametrize("kind", ["dt", "rf"])
def test_a_model_scores_in_a_session_that_has_observed_a_query(spark, kind):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 3
    rows = spark.range(N).select((F.col("id") % 41).cast("double").alias("x"), (F.col("id") % 41 > 20).cast("int").alias("y"))
    settings = models.forest(numTrees=3) if kind == "rf" else models.single_tree()
    model = models.fit_model(rows, ["x"], "y", kind, settings)
    assert model.score(rows).filter(F.col("y") == F.col(f"{kind}_y_pred")).count() == N
