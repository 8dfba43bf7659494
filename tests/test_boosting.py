"""Joint boosting against a plain grower, its passes, and what is read from staged scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import boosting, models
from scoreloom.operators.vectors import Summary, cuts_of, quantile_cuts

PLAIN = boosting.Settings(rounds=3, depth=2, rate=0.3, row_share=1.1, column_share=1.0)


def table(n=300, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 20, n).astype(float), rng.integers(0, 9, n).astype(float), rng.normal(size=n).round(1)
    a[rng.random(n) < 0.1] = np.nan
    level = (np.nan_to_num(a, nan=15) + 2 * b + rng.normal(0, 4, n) > 18).astype(int) + (c > 0.5)
    return np.stack([a, b, c]), level


def frame(spark, x, y):
    rows = [(i, *(None if np.isnan(v) else float(v) for v in x[:, i]), int(y[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(5)


def plain_margins(x, y, classes, settings):
    """Trees grown by trying every value of every column at every node."""
    outputs = 1 if classes == 2 else classes
    margins = np.zeros((outputs, len(y)))

    def score(g, h):
        return g.sum() ** 2 / (h.sum() + settings.penalty)

    def grow(rows, g, h, depth, out):
        out[rows] = -settings.rate * g[rows].sum() / (h[rows].sum() + settings.penalty)
        best = (1e-6, None)
        for column in x if depth < settings.depth else ():
            for cut in np.unique(column[~np.isnan(column)])[:-1]:
                for missing_left in (False, True):
                    left = np.where(np.isnan(column[rows]), missing_left, column[rows] <= cut)
                    i, j = rows[left], rows[~left]
                    if h[i].sum() < settings.least_weight or h[j].sum() < settings.least_weight:
                        continue
                    gain = score(g[i], h[i]) + score(g[j], h[j]) - score(g[rows], h[rows])
                    if gain > best[0] + 1e-9:
                        best = (gain, (i, j))
        if best[1] is not None:
            for part in best[1]:
                grow(part, g, h, depth + 1, out)

    for _ in range(settings.rounds):
        e = np.exp(margins)
        p = 1 / (1 + np.exp(-margins)) if outputs == 1 else e / e.sum(axis=0)
        step = np.zeros_like(margins)
        for k in range(outputs):
            hit = y == (1 if outputs == 1 else k)
            g, h = p[k] - hit, p[k] * (1 - p[k]) * (1 if outputs == 1 else 2)
            grow(np.arange(len(y)), g, h, 0, step[k])
        margins = margins + step
    return margins


@pytest.mark.parametrize("classes", [2, 3])
def test_trees_equal_a_plain_grower(spark, classes):
    x, y = table()
    y = np.minimum(y, classes - 1)
    model = boosting.fit(frame(spark, x, y), ["a", "b", "c"], "y", classes, PLAIN)[-1]
    got = boosting.probabilities(plain_margins(x, y, classes, PLAIN))
    assert np.allclose(model.probabilities(x), got, atol=1e-9)
    names = [f"p{i}" for i in range(classes)]
    scored = model.score(frame(spark, x, y), dict(enumerate(names))).orderBy("id").select(*names).collect()
    assert np.allclose(np.array(scored).T, got, atol=1e-9)
    assert boosting.Boosted.from_json(model.to_json()).to_json() == model.to_json()
    assert sum(model.importances().values()) == pytest.approx(1)


def test_a_level_is_one_pass_whatever_the_classes(spark, monkeypatch):
    x, y = table()
    passes = []
    level = boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a: passes.append(1) or level(*a))
    for classes, folds in ((2, 0), (3, 0), (3, 2)):
        passes.clear()
        fold = F.col("id") % 2 if folds else None
        boosting.fit(frame(spark, x, np.minimum(y, classes - 1)), ["a", "b", "c"], "y", classes, PLAIN, fold, folds)
        assert len(passes) == PLAIN.rounds * PLAIN.depth


@pytest.mark.parametrize("classes", [2, 3])
def test_a_tree_of_one_column_takes_one_pass(spark, classes):
    x, y = table()
    y = np.minimum(y, classes - 1)
    deep = boosting.Settings(rounds=3, depth=4, rate=0.3, row_share=1.1, column_share=0.1)
    df = frame(spark, x, y).select("id", "a", "y")
    cuts = boosting.feature_cuts(df, ["a"])
    spark.sparkContext.setJobGroup(f"one-column-{classes}", "boosting")
    model = boosting.fit(df, ["a"], "y", classes, deep, cuts=cuts)[-1]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"one-column-{classes}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < deep.rounds * deep.depth  # three jobs prepare the rows
    want = boosting.probabilities(plain_margins(x[:1], y, classes, deep))
    assert np.allclose(model.probabilities(x[:1]), want, atol=1e-9)


def test_trees_of_one_column_store_no_margins(spark, monkeypatch):
    x, y = table()
    one = boosting.Settings(rounds=12, depth=3, rate=0.3, row_share=1.1, column_share=0.1)
    stored = []
    advance = boosting._with_margins
    monkeypatch.setattr(boosting, "_with_margins", lambda *a: stored.append(1) or advance(*a))
    df = frame(spark, x, y)
    cuts = boosting.feature_cuts(df, ["a", "b", "c"])
    *held_out, whole = boosting.fit(df, ["a", "b", "c"], "y", 3, one, F.col("id") % 2, 2, cuts)
    assert not stored
    *_, staged = whole.staged(x)
    assert np.allclose(whole.probabilities(x), boosting.probabilities(staged), atol=1e-12)
    # the model of a fold is the one fitted on the other rows
    for k, model in enumerate(held_out):
        (rest,) = boosting.fit(df.filter(F.col("id") % 2 != k), ["a", "b", "c"], "y", 3, one, cuts=cuts)
        assert np.allclose(model.probabilities(x), rest.probabilities(x), atol=1e-9)


def test_scans_by_a_model_deal_their_rows(spark):
    x, y = table()
    df = frame(spark, x, y).withColumn("d", F.lit("train"))
    model = boosting.fit(df, ["a", "b", "c"], "y", 3, PLAIN)[-1]
    for scan in (boosting.staged_losses(df, model, "y", "d"), boosting.out_of_fold(df, [model], "y", F.lit(0))):
        assert "RebalancePartitions" in scan._jdf.queryExecution().optimizedPlan().toString()


def test_stored_margins_change_nothing(spark, monkeypatch):
    x, y = table()
    df = frame(spark, x, y).repartition(1).sortWithinPartitions("id")
    once = boosting.fit(df, ["a", "b", "c"], "y", 3, PLAIN)[-1].probabilities(x)
    monkeypatch.setattr(boosting, "STORED_EVERY", 1)
    assert np.allclose(boosting.fit(df, ["a", "b", "c"], "y", 3, PLAIN)[-1].probabilities(x), once, atol=1e-9)


def test_models_without_a_fold_have_not_seen_it(spark):
    x, y = table()
    df = frame(spark, x, y)
    fold = (F.col("id") % 3).cast("int")
    models_ = boosting.fit(df, ["a", "b", "c"], "y", 3, PLAIN, fold, 3, boosting.feature_cuts(df, ["a", "b", "c"]))
    for k in range(3):
        rest = np.arange(len(y)) % 3 != k
        want = boosting.probabilities(plain_margins(x[:, rest], y[rest], 3, PLAIN))
        assert np.allclose(models_[k].probabilities(x[:, rest]), want, atol=1e-9)
    counts = {(r["y"], r["predicted"]): r["n"] for r in boosting.out_of_fold(df, models_[:3], "y", fold).collect()}
    guess = np.array([models_[i % 3].probabilities(x[:, i : i + 1]).argmax() for i in range(len(y))])
    assert counts == {(a, b): n for a in range(3) for b in range(3) if (n := int(((y == a) & (guess == b)).sum()))}


def test_loss_falls_and_ends_at_the_scores(spark):
    x, y = table()
    df = frame(spark, x, y).withColumn("d", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    model = boosting.fit(df.filter("d = 'train'"), ["a", "b", "c"], "y", 3, PLAIN)[-1]
    curve = {(r["dataset"], r["round"]): r for r in boosting.staged_losses(df, model, "y", "d").collect()}
    assert set(curve) == {(d, r) for d in ("test", "train") for r in (1, 2, 3)}
    assert curve["train", 3]["loss"] < curve["train", 1]["loss"] < np.log(3)
    p, own = model.probabilities(x), np.arange(len(y)) % 4 == 0
    assert curve["test", 3]["loss"] == pytest.approx(-np.log(p[y, np.arange(len(y))][own]).mean())
    assert curve["test", 3]["error"] == pytest.approx((p.argmax(axis=0) != y)[own].mean())


def test_elimination_of_three_classes_returns_its_best_step(spark):
    x, y = table(600)
    df = frame(spark, x, y).withColumns({f"noise{i}": F.pmod(F.xxhash64("id", F.lit(i)), F.lit(7)) for i in range(5)})
    features = ["a", "b", "c", *[f"noise{i}" for i in range(5)]]
    steps = models.recursive_elimination(df, features, "y", F.xxhash64("id"), keep=2, folds=3, rounds=3, classes=3)
    rows = steps.orderBy("step").collect()
    assert [r["nb_features"] for r in rows] == [8, 4, 2]
    best = [r for r in rows if r["best"]]
    assert len(best) == 1 and best[0]["f1_macro"] == max(r["f1_macro"] for r in rows)
    assert models.best_features(steps) == best[0]["features"]


def test_cuts_are_near_quantiles(spark):
    values = np.random.default_rng(4).normal(size=200_000)
    summary = Summary()
    for part in np.array_split(values, 97):
        summary.add(part)
    packed = summary.packed()
    cuts = cuts_of(packed[: len(packed) // 2], packed[len(packed) // 2 :], 10)
    ranks = np.searchsorted(np.sort(values), cuts) / len(values)
    assert np.abs(ranks - np.arange(1, 10) / 10).max() < 0.005
    df = spark.createDataFrame([(float(i % 5) if i % 3 else None, None) for i in range(100)], "x double, y double")
    assert quantile_cuts(df, ["x", "y"], 9) == {"x": [0.0, 1.0, 2.0, 3.0], "y": []}


def test_nodes_are_those_of_the_cuts_one_by_one():
    random = np.random.default_rng(3)
    tree = boosting.Tree(np.full(15, -1), random.integers(1, 6, 15), random.random(15) < 0.5, random.random(15))
    tree.column[[0, 1, 2, 4, 5]] = [2, 0, 1, 1, 2]
    groups = random.integers(0, 8, (3, 200)).astype(np.uint8)
    for levels in range(4):
        expected = []
        for row in groups.T.tolist():
            at = 0
            for _ in range(levels):
                if tree.column[at] >= 0:
                    group = row[tree.column[at]]
                    at = 2 * at + 2 - int(tree.missing_left[at] if group == 0 else group <= tree.group[at])
            expected.append(at)
        assert tree.nodes(groups, levels).tolist() == expected


def test_a_model_of_one_column_scores(spark):
    rows = spark.range(400).select((F.col("id") % 9).cast("double").alias("x"), (F.col("id") % 9 > 4).cast("int").alias("y"))
    (model,) = boosting.fit(rows, ["x"], "y", 2, boosting.Settings(rounds=3, depth=2, rate=0.5))
    scored = model.score(rows, {1: "p"})
    assert scored.filter((F.col("p") > 0.5) != (F.col("y") == 1)).count() == 0
    assert model.score(rows, {0: "n", 1: "p"}).filter(F.abs(F.col("n") + F.col("p") - 1) > 1e-12).count() == 0
