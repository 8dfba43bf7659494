"""The forest grown by bounds is that of Spark ML."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scoreloom.operators import forest, models

NAMES = ["a", "b.c", "d", "e", "one"]


def _rows(spark, n):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double") for i, m in enumerate((7, 50, 1000, 100_000))]
    noise = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(40))
    rows = spark.range(0, n, 1, 4).select("id", *[c.alias(name) for c, name in zip(x, NAMES)], F.lit(3.0).alias("one"))
    return rows.withColumn("y", (F.col("a") * 4 + F.col("`b.c`") + F.col("d") / 40 + noise > 95).cast("int"))


def _nodes(node):
    if node.getClass().getSimpleName() != "InternalNode":
        return None
    return [node.split().featureIndex(), node.split().threshold(), _nodes(node.leftChild()), _nodes(node.rightChild())]


def _own(node, cuts):
    return [node[0], cuts[node[0]][node[1]], *(_own(n, cuts) for n in node[2:])] if isinstance(node, list) else None


@pytest.mark.parametrize("n, trees", [(500, 3), (500, 1), (30_000, 40)])
def test_trees_are_those_of_spark(spark, n, trees):
    settings = models.forest(numTrees=trees)
    stored = models._even_rows(_rows(spark, n), NAMES, "y")
    found, weights = forest.fit(stored, NAMES, models.LABEL, settings)
    assembled = models._vector([f"f{i}" for i in range(len(NAMES))]).transform(stored)
    theirs = settings.fit(assembled.select(models.VECTOR, models.LABEL))
    for i in range(trees):
        assert _own(found.trees[i], found.cuts) == _nodes(theirs._java_obj.trees()[i].rootNode())
    assert list(weights.values()) == pytest.approx(theirs.featureImportances.toArray().tolist(), abs=1e-12)
    named = assembled.select("*", *[F.col(f"f{i}").alias(c) for i, c in enumerate(NAMES)])
    both = theirs.transform(found.score(named, {1: "own"})).select("own", vector_to_array("probability")[1].alias("theirs"))
    assert both.filter(F.abs(F.col("own") - F.col("theirs")) > 1e-12).count() == 0


def test_nodes_of_the_same_bounds_are_counted_once(spark, monkeypatch):
    counted, asked = forest._ways, []
    monkeypatch.setattr(forest, "_ways", lambda boxes, wanted: asked.append(len(wanted)) or counted(boxes, wanted))
    models.fit_model(_rows(spark, 2000), NAMES, "y", "rf", models.forest(numTrees=200))
    assert asked[0] == 1 and asked[1] <= 2 * len(NAMES) and asked[2] <= 50


def test_a_forest_is_stored_and_scores_as_before(spark, tmp_path):
    rows = _rows(spark, 2000)
    model = models.fit_model(rows, NAMES, "y", "rf", models.forest(numTrees=5))
    model.save(str(tmp_path / "model"))
    loaded = models.FittedModel.load(spark, str(tmp_path / "model"))
    scores = [np.array(m.score(rows).orderBy("id").select("rf_y_pred_prob").toArrow()[0]) for m in (model, loaded)]
    assert (scores[0] == scores[1]).all() and len(np.unique(scores[0])) > 5


def test_a_forest_that_draws_rows_is_left_to_spark(spark):
    model = models.fit_model(_rows(spark, 500), NAMES, "y", "rf", models.forest(numTrees=3, bootstrap=True))
    assert model.trees is None and len(model.models) == 1


def test_a_forest_takes_no_missing_values(spark):
    rows = _rows(spark, 500).withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    with pytest.raises(Exception, match="missing values"):
        models.fit_model(rows, NAMES, "y", "rf", models.forest(numTrees=3))
