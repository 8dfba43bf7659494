from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import binning, metrics, models, prebins, stats
from scoreloom.params import ScoringParams
from scoreloom.plans import predict, prepare, report, train


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 3000
    a, b, c = rng.integers(0, 60, n), rng.integers(1, 40, n), rng.normal(size=n).round(3)
    y = (a + 2 * b + rng.normal(0, 25, n) > 90).astype(int)
    data = [
        (i, int(a[i]), int(b[i]), float(c[i]), "uvw"[i % 3], f"2020-{1 + i % 6:02d}", int(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id long, a int, b int, c double, s string, obs string, y int").cache()


# -- statistics --------------------------------------------------------------------------------


def test_correlation_ignores_nulls_and_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 1, 5), (2.0, 0, 5), (None, 1, 5), (4.0, 0, 5)], "x double, y int, one int"
    )
    got = {r["feature"]: r["r"] for r in stats.corr_with_target(df, ["x", "one"], "y").collect()}
    assert got["one"] is None
    assert got["x"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 0, 0])[0, 1])


def test_wide_and_narrow_correlations_agree(spark):
    cols = [f"c{i}" for i in range(15)]
    df = spark.range(50).select(
        *[((F.col("id") * (i + 7)) % 13).alias(c) for i, c in enumerate(cols)], (F.col("id") % 3).alias("y")
    )
    wide = {r["feature"]: r["r"] for r in stats.corr_with_target(df, cols, "y").collect()}
    narrow = {r["feature"]: r["r"] for r in stats.corr_with_target(df, cols[:5], "y").collect()}
    for c in cols[:5]:
        assert wide[c] == pytest.approx(narrow[c], abs=1e-12)


def test_limits_themselves_are_outside(spark):
    table = spark.createDataFrame(
        [("low", 0.05), ("in", -0.2), ("high", 0.4), ("gone", None)], "feature string, r double"
    )
    assert [r["feature"] for r in stats.correlation_filter(table).collect()] == ["in"]
    kept = {r["feature"] for r in stats.correlation_filter(table, ["high_div_ratio_low"]).collect()}
    assert kept == {"in", "high", "low"}


def test_single_class_metrics_are_zero(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 1, 0, 0.2), ("b", 1, 1, 0.8), ("b", 0, 0, 0.8)],
                               "d string, y int, p int, s double")
    got = {r["d"]: r for r in metrics.binary_metrics(df, "y", "p", "s", ["d"]).collect()}
    assert got["a"]["auc"] == 0 and got["a"]["volume"] == 0
    assert got["b"]["auc"] == 0.5 and got["b"]["accuracy"] == 1.0


def test_auc_equals_all_pairs(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 9, 80) / 10, rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y == 1] for n in s[y == 0]]
    assert metrics.auc(df, "y", "s").first()["auc"] == pytest.approx(np.mean(pairs))


def test_stump_equals_exhaustive_search(spark, rows):
    data = [(r["a"], r["y"]) for r in rows.select("a", "y").collect()]
    split = stats.stump_split(rows, "a", "y")

    def gini(part):
        p = sum(part) / len(part)
        return 2 * p * (1 - p) * len(part)

    cuts = sorted({x for x, _ in data})
    best = min(
        ((lo + hi) / 2 for lo, hi in zip(cuts, cuts[1:])),
        key=lambda cut: gini([y for x, y in data if x <= cut]) + gini([y for x, y in data if x > cut]),
    )
    assert split["cut"] == best


# -- binning -----------------------------------------------------------------------------------


def _trend(rates):
    up = [b > a for a, b in zip(rates, rates[1:])]
    if any(a == b for a, b in zip(rates, rates[1:])):
        return None
    if all(up) or not any(up):
        return "ascending" if up[0] else "descending"
    if sum(a != b for a, b in zip(up, up[1:])) == 1:
        return "peak" if up[0] else "valley"
    return None


@pytest.mark.parametrize("trend", ["ascending", "descending", "peak", "valley", "auto"])
@pytest.mark.parametrize("classes", [2, 3])
def test_best_grouping_equals_brute_force(trend, classes):
    rng = np.random.default_rng(5)
    hits = 0
    for _ in range(20):
        counts = rng.integers(5, 60, size=(8, classes)).astype(float)
        best = 0.0
        for k in range(1, 4):
            for inner in combinations(range(1, 8), k):
                cells = np.array([part.sum(axis=0) for part in np.split(counts, inner)])
                size = cells.sum(axis=1)
                judged = [1] if classes == 2 else range(classes)
                trends = [_trend((cells[:, c] / size).tolist()) for c in judged]
                if (size < 0.1 * counts.sum()).any() or any(t is None or trend not in ("auto", t) for t in trends):
                    continue
                value = 0.0
                for c in [0] if classes == 2 else range(classes):
                    inside, outside = cells[:, c] / cells[:, c].sum(), (size - cells[:, c]) / (size - cells[:, c]).sum()
                    value += ((outside - inside) * np.log(outside / inside)).sum()
                best = max(best, value)
        assert binning.best_grouping(counts, trend=trend)[1] == pytest.approx(best)
        hits += best > 0
    assert hits > 5 or classes == 3 and trend != "auto"


def _gini(part):
    return len(part) - sum(n * n for n in np.unique(part, return_counts=True)[1]) / len(part)


def test_prebins_are_the_leaves_of_a_plain_tree(spark):
    rng = np.random.default_rng(9)
    x, z = rng.integers(0, 40, 500).astype(float), rng.normal(size=500).round(2)
    y = (x > 12).astype(int) + ((x > 25) & (rng.random(500) > 0.3))
    rows = [(None if i % 50 == 0 else float(x[i]), float(z[i]), int(y[i])) for i in range(500)]
    df = spark.createDataFrame(rows, "x double, z double, y int").repartition(5)
    found = prebins.supervised_prebins(df, ["x", "z"], "y", [0, 1, 2], leaves=6, leaf_share=0.05)
    for name, values in (("x", x[np.arange(500) % 50 != 0]), ("z", z)):
        target = y[np.arange(500) % 50 != 0] if name == "x" else y
        leaves, cuts = [np.arange(len(values))], []
        while len(leaves) < 6:
            options = []
            for n, rows_ in enumerate(leaves):
                distinct = np.unique(values[rows_])
                for low, high in zip(distinct, distinct[1:]):
                    left, right = rows_[values[rows_] <= low], rows_[values[rows_] > low]
                    fall = _gini(target[rows_]) - _gini(target[left]) - _gini(target[right])
                    if min(len(left), len(right)) >= 0.05 * len(values) and fall > 1e-9:
                        options.append((fall, -n, (low + high) / 2, left, right))
            if not options:
                break
            top = max(o[0] for o in options)
            _, n, cut, left, right = next(o for o in options if o[0] > top - 1e-9)
            cuts.append(cut)
            leaves[-n : -n + 1] = [left, right]
        assert found[name].cuts == pytest.approx(sorted(cuts))
        index = np.searchsorted(sorted(cuts), values, "right")
        want = np.zeros((len(cuts) + 1, 3))
        np.add.at(want, (index, target), 1)
        assert (found[name].counts == want).all()


def test_prebins_of_awkward_columns(spark):
    df = spark.createDataFrame([(None, 1.0, 0), (None, 1.0, 1), (None, float("inf"), 1), (None, float("nan"), None)], "a double, b double, y int")
    assert {c: p.cuts for c, p in prebins.supervised_prebins(df, ["a", "b"], "y", [0, 1]).items() if c == "b"} == {"b": []}
    assert binning.OptimalBins.fit(df, ["a", "b"], "y").splits == {}
    assert binning.OptimalBins.fit(df.filter("y = 1"), ["a", "b"], "y").splits == {}


def test_bins_cover_every_row_once(rows):
    bins = binning.OptimalBins.fit(rows, ["a", "b", "c"], "y")
    assert "a" in bins.splits and 1 <= len(bins.splits["a"]) <= 3
    flags = binning.bin_dummy_names("a", bins.splits["a"])
    out = bins.transform(rows).select(sum(F.col(f"`{c}`") for c in flags).alias("n"))
    assert {r["n"] for r in out.distinct().collect()} == {1}


def test_gaps_are_null_or_the_mean(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (6.0,), (None,)], "x double")
    name = binning.bin_dummy_names("x", [3.0])[1]
    plain = [r[name] for r in binning.apply_bins(df, {"x": [3.0]}).collect()]
    filled = [r[name] for r in binning.apply_bins(df, {"x": [3.0]}, fill_gaps=True).collect()]
    assert plain == [0, 1, 1, None]
    assert filled == pytest.approx([0, 1, 1, 2 / 3])


# -- models ------------------------------------------------------------------------------------


def test_tree_learns_and_survives_storage(spark, rows, tmp_path):
    model = models.fit_model(rows, ["a", "b", "c"], "y", "dt")
    assert sum(model.importances.values()) == pytest.approx(1.0)
    scored = model.score(rows)
    assert metrics.auc(scored, "y", "dt_y_pred_prob").first()["auc"] > 0.7
    model.save(str(tmp_path / "m"))
    again = models.FittedModel.load(spark, str(tmp_path / "m"))
    assert again.score(rows).exceptAll(scored).count() == 0


def test_missing_feature_scores_zero(rows):
    model = models.fit_model(rows, ["a", "b"], "y", "dt")
    out = models.batch_predict(rows.drop("b"), [model])
    assert {r["predict_dt"] for r in out.select("predict_dt").distinct().collect()} == {0.0}


def test_logistic_drops_noise(rows):
    model = models.fit_logistic(rows, ["a", "b", "c"], "y")
    assert model.features == ["a", "b"]
    assert {r["feature"] for r in model.coefficients} == {"a", "b", "const"}


def test_multiclass_probabilities_sum_to_one(rows):
    three = rows.withColumn("k", F.when(F.col("y") == 0, 0).when(F.col("a") < 40, 1).otherwise(2))
    model = models.fit_multiclass(three, ["a", "b"], "k", ["n", "s", "l"], models.boosted(rounds=3, rate=0.3, depth=4, column_share=1.0))
    scored = model.score_multiclass(three)
    total = sum(F.col(c) for c in model.probability_columns().values())
    assert scored.filter(F.abs(total - 1) > 1e-9).count() == 0
    assert scored.filter(F.col("k") == F.col("xgb_y_pred")).count() > 0.6 * three.count()
    names = {f"predict_xgb_{c}": p for c, p in zip("nsl", model.probability_columns().values())}
    batch = models.batch_predict(three, [model], digits=12)
    joined = batch.join(scored.select("id", *names.values(), "xgb_y_pred"), "id")
    same = F.col("predict_xgb") == F.col("xgb_y_pred")
    for name, p in names.items():
        same = same & (F.abs(F.col(name) - F.col(p)) < 1e-9)
    assert joined.filter(same).count() == three.count()
    assert models.batch_predict(three.drop("b"), [model]).filter("predict_xgb_n = 0 and predict_xgb = 0").count() == three.count()
    with pytest.raises(ValueError):
        model.score(three)


# -- flows -------------------------------------------------------------------------------------


def test_flow_from_raw_rows_to_report(spark, rows):
    params = ScoringParams.from_dict(
        {
            "criterion_column": "y",
            "observation_date_column": "obs",
            "t1df": "2020-04", "t2df": "2020-05", "t3df": "2020-06",
            "columns_to_exclude": ["obs"],
            "columns_to_include": ["a_div_ratio_b"],
            "under_sampling": 1,
            "cut_offs": {"dt": [0, 0.3, 0.6, 1]},
        }
    )
    bucket = F.col("id") * 7919
    prepared = prepare.prepare(rows, params, ["id"], bucket=bucket)
    assert "a_div_ratio_b" in prepared.features
    counts = {r["y"]: r["count"] for r in prepared.working.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    trained = train.train(prepared.full, prepared.features, params, bucket, ["dt"], prepared.working)
    table = {r["dataset"]: r for r in trained.metrics.collect()}
    assert set(table) == {"train", "test", "t1", "t2", "t3"} and table["t1"]["auc"] > 0.7
    model = trained.models["dt"]
    result = predict.predict(rows, prepared.plan, [model], params, trained.labelled, {"tp": 1}, "obs", 1)
    assert result.predictions.select("obs").distinct().count() == 5
    assert result.predictions.filter("predict_dt > 0").count() > 0
    splits = models.banded(model.score(trained.labelled), "dt", "y", params.cut_offs["dt"])
    tables = report.model_report(splits, model, params)
    assert report.stacked(tables).select("report").distinct().count() >= 18


@pytest.mark.parametrize("treatment", ["median", "column_mean"])
def test_stored_plan_gives_a_row_the_same_features_in_any_batch(spark, rows, tmp_path, treatment):
    gaps = rows.select("id", F.when(F.col("id") % 7 != 0, F.col("a")).alias("a"), "b", "c", "s", "obs", "y")
    params = ScoringParams.from_dict(
        {
            "criterion_column": "y", "observation_date_column": "obs", "columns_to_exclude": ["obs"],
            "t1df": "2020-04", "t2df": "2020-05", "t3df": "2020-06", "missing_treatment": treatment,
        }
    )
    assert params.missing_treatment == treatment
    prepared = prepare.prepare(gaps, params, ["id"], bucket=F.col("id") * 7919)
    prepared.plan.save(spark, str(tmp_path / "plan"))
    plan = prepare.PreparationPlan.load(spark, str(tmp_path / "plan"))
    assert plan == prepared.plan and plan.fills["a"] > 0
    new = gaps.withColumn("s", F.when(F.col("id") != 14, F.col("s")))
    batch = plan.transform(new.filter("id < 40"))
    alone = plan.transform(new.filter("id = 14"))
    assert batch.count() == 40 and alone.count() == 1
    inputs = [F.col(f"`{c}`") for c in ("a", "b", "c", *plan.features) if c in alone.columns]
    assert batch.filter("id = 14").select(inputs).collect() == alone.select(inputs).collect()


def test_a_row_scores_alike_alone_in_a_batch_and_on_a_stream(spark, rows, tmp_path):
    params = ScoringParams.from_dict(
        {
            "criterion_column": "y", "observation_date_column": "obs", "columns_to_exclude": ["obs"], "t1df": "2020-04", "t2df": "2020-05",
            "t3df": "2020-06", "missing_treatment": "median", "symbol": "p", "signal_trade": {"col1_name": "predict_xgb", "col1_value": 0.4},
        }
    )
    prepared = prepare.prepare(rows, params, ["id"], bucket=F.col("id") * 7919)
    assert "blank" in prepared.plan.outliers.action.values()  # c is normal: some values are beyond three deviations
    features = prepared.features
    fitted = [
        models.fit_model(prepared.working, features, "y", "xgb", models.boosted(rounds=3, rate=0.3)),
        models.fit_model(prepared.working, features, "y", "dt"),
    ]
    new = rows.filter("id < 600")
    batch = predict.scored_rows(new, prepared.plan, fitted, params).drop("y")
    alone = predict.scored_rows(new.filter("id = 77"), prepared.plan, fitted, params).drop("y")
    assert batch.filter("id = 77").collect() == alone.collect()
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (new.filter("id < 250"), new.filter("id >= 250")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(new.schema).parquet(source)
        predict.score_stream(stream, prepared.plan, fitted, params, sink, str(tmp_path / "checkpoint")).awaitTermination()
    streamed = spark.read.parquet(sink)
    assert streamed.count() == 600
    order = lambda df: sorted(map(str, df.select(*[F.col(f"`{c}`") for c in batch.columns]).collect()))
    assert order(streamed) == order(batch)
