import datetime as dt

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import names
from scoreloom.functions.exprs import nan_to_null
from scoreloom.operators import cleaning, encode, filters, projection, sampling
from scoreloom.sources import readers, sinks


def column(df, name):
    return [r[name] for r in df.collect()]


# -- names -------------------------------------------------------------------------------------


def test_sanitize_and_raw_inputs():
    assert names.sanitize("x_binned_dummie_[1.5, 3)") == "x_binned_dummie_from_incl_1.5_to_3_excl_"
    features = ["a_div_ratio_b_binned_dummie_1", "c_binned_dummie_2", "a", "d_mult_ratio_c", "e_dummie_x"]
    assert names.raw_inputs(features) == ["a", "b", "c", "d", "e_dummie_x"]


def test_band_labels():
    assert names.right_closed_labels([0, 0.2, 0.35, 0.5, 1]) == [
        "(-0.001, 0.2]", "(0.2, 0.35]", "(0.35, 0.5]", "(0.5, 1.0]",
    ]
    assert names.left_closed_labels([1.5, 3]) == ["(-inf, 1.50)", "[1.50, 3.00)", "[3.00, inf)"]


# -- projections and filters -------------------------------------------------------------------


def test_roles_skip_bytes_and_booleans(spark):
    df = spark.createDataFrame([], "i int, d double, s string, b byte, f boolean, t timestamp, day date")
    roles = projection.roles_of(df.schema, ["d"])
    assert (roles.numerical, roles.object, roles.dates) == (("i",), ("s",), ("t", "day"))


def test_reconcile_brings_back_named_parts_and_stops_when_empty():
    got = projection.reconcile_features(["a"], ["a", "b", "c"], ["b_div_ratio_x"])
    assert got == ["a", "b"]
    with pytest.raises(ValueError):
        projection.reconcile_features(["z"], ["a"], [])


def test_finalize_features_drops_absent_and_repeats(spark):
    one, two = spark.createDataFrame([], "a int, b int"), spark.createDataFrame([], "a int")
    assert projection.finalize_features(["a", "b", "a"], ["c"], one) == ["a", "b"]
    assert projection.finalize_features(["a", "b"], [], one, two) == ["a"]


def test_missing_period_is_kept_by_exclusion_and_empty_holdout_fails(spark):
    df = spark.createDataFrame([("2020-01",), ("2020-02",), (None,)], "obs string")
    assert set(column(filters.exclude_periods(df, "obs", ["2020-01"]), "obs")) == {"2020-02", None}
    assert filters.exclude_periods(df, "obs", []).count() == 3
    labels = {r["obs"]: r["dataset"] for r in filters.temporal_holdout(df, "obs", ["2020-02"]).collect()}
    assert labels == {"2020-01": "rest", "2020-02": "t1", None: "rest"}
    with pytest.raises(ValueError):
        filters.temporal_holdout(df, "obs", ["2020-02", "2031-01"])


def test_constant_and_sparse_columns(spark):
    rows = [(1, 1, None if i else 5, i) for i in range(10)]
    df = spark.createDataFrame(rows, "one int, same int, sparse int, i int")
    assert filters.constant_columns(df, ["one", "sparse", "i"]) == ["one", "sparse"]
    assert filters.drop_sparse_columns(df).columns == ["one", "same", "i"]


def test_immature_rows_are_the_newest_times(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c"), (2, "d"), (None, "e")], "t int, k string")
    assert set(column(filters.drop_immature_rows(df, "t", 2), "k")) == {"a", "e"}


# -- features ----------------------------------------------------------------------------------


def test_dates_are_parsed_only_when_every_value_parses(spark):
    df = spark.createDataFrame(
        [("2020-01", "31012020", "2020-01-05", "x"), ("2020-02", "01022020", None, "2020-01-01")],
        "m string, dmy string, iso string, bad string",
    )
    out = encode.parse_dates(df, df.columns)
    assert out.columns[4:] == ["m_date", "dmy_date", "iso_date"]
    first = out.collect()[0]
    assert first["m_date"] == dt.datetime(2020, 1, 1) and first["dmy_date"] == dt.datetime(2020, 1, 31)


def test_date_differences_both_ways_and_one_row_rule(spark):
    rows = [(dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2, 12)), (dt.datetime(2020, 1, 6), None)]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    out = encode.date_diff_hours(df, ["a", "b"])
    assert column(out, "a_diff_hours_b") == column(out, "b_diff_hours_a") == [36.0, None]
    assert encode.date_diff_hours(df.limit(1), ["a", "b"]).columns == ["a", "b"]
    assert column(encode.date_parts(df, ["a"]), "a_WeekDay_NB") == [2, 0]


def test_exactly_twenty_values_trip_neither_rule(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("n"), (F.col("id") % 20).cast("string").alias("s"))
    assert encode.numeric_to_categorical(df, ["n"]) == []
    assert encode.high_cardinality_filter(df, ["s"]) == ["s"]
    with_null = df.unionByName(spark.createDataFrame([(None, None)], "n long, s string"))
    assert encode.high_cardinality_filter(with_null, ["s"]) == []


def test_one_hot_drops_first_level_and_flags_nulls(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 10.0), (None, None)], "s string, n double")
    out = encode.one_hot(df, ["s", "n"])
    assert out.columns == ["s", "n", "s_dummie_b", "s_dummie_nan", "n_dummie_10.0", "n_dummie_nan"]
    assert column(out, "s_dummie_b") == [1, 0, 0] and column(out, "s_dummie_nan") == [0, 0, 1]
    assert projection.roles_of(out.schema).numerical == ("n",)
    assert len(encode.OneHot.fit(spark.range(500), ["id"]).names()) == 500


def test_ratio_uses_mean_of_finite_quotients(spark):
    df = spark.createDataFrame([(4.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 3.0), (8.0, 2.0)], "a double, b double")
    assert column(encode.pairwise_ratios(df, ["a", "b"]), "a_div_ratio_b") == [2.0, 3.0, 3.0, 3.0, 4.0]
    kept = encode.pairwise_ratios(df, ["a", "b"], ["a"]).columns
    assert kept == ["a", "b", "a_div_ratio_a"]


def test_many_ratios_agree_with_few(spark):
    cols = [f"c{i}" for i in range(7)]
    df = spark.range(1, 30).select(*[((F.col("id") * (i + 3)) % 11).alias(c) for i, c in enumerate(cols)])
    wide = encode.Ratios.fit(df, cols).fills
    for a, b in (("c0", "c1"), ("c5", "c6")):
        assert wide[a, b] == pytest.approx(encode.Ratios.fit(df, [a, b]).fills[a, b])


def test_rules_treat_null_as_no(spark):
    df = spark.createDataFrame([(5,), (None,)], "x int")
    rules = {"r": {"type": "between_left_incl", "raw_col": "x", "cutpoint": [5, 9]}}
    assert column(encode.rule_predictors(df, rules), "r") == [1, 0]
    with pytest.raises(ValueError):
        encode.rule_predictors(df, {"r": {"type": "odd", "raw_col": "x", "cutpoint": 1}})


def test_bands_are_right_closed_and_outside_is_nan(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.21,), (1.0,), (1.2,), (None,)], "p double")
    got = column(encode.score_bands(df, "p", [0, 0.2, 0.35, 1], "b"), "b")
    assert got == ["(-0.001, 0.2]", "(-0.001, 0.2]", "(0.2, 0.35]", "(0.35, 1.0]", "nan", "nan"]


def test_codes_and_coercion(spark):
    df = spark.createDataFrame([("b", "1"), ("a", "x"), (None, None)], "s string, n string")
    assert sorted(map(tuple, encode.category_codes(df, "s").select("s", "s_cat").collect()), key=str) == [
        ("a", 0), ("b", 1), (None, -1),
    ]
    assert sorted(column(encode.coerce_numeric(df, "n"), "n"), key=str) == [1.0, None, None]


# -- cleaning ----------------------------------------------------------------------------------


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None)], "x double, i int")
    assert column(nan_to_null(df), "x") == [None, 2.0]


def test_outliers_blank_or_constant_and_nulls_ignored(spark):
    rows = [(0.0, 1.0)] * 60 + [(1.0, 1.0)] * 39 + [(100.0, None)]
    df = spark.createDataFrame(rows, "x double, same double")
    rule = cleaning.OutlierRule.fit(df, ["x", "same"])
    assert rule.action == {"x": "blank", "same": "keep"}
    assert rule.transform(df).filter("x is null").count() == 1
    forced = cleaning.OutlierRule({"x": "constant"}).transform(df)
    assert set(column(forced, "x")) == {1.0}


def test_missing_treatments(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "c"), (8.0, "d")], "x double, s string")
    assert cleaning.treat_missing(df, "delete").count() == 2
    assert sorted(column(cleaning.treat_missing(df, "column_mean"), "x")) == [1.0, 4.0, 8.0]
    assert sorted(column(cleaning.treat_missing(df, "median"), "x")) == [1.0, 3.0, 8.0]
    filled = cleaning.treat_missing(df, {"x": -1}).collect()
    assert filled[1]["s"] == "MissingInformation" and filled[2]["x"] == -1.0


def test_inspector_counts_and_raises(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b int")
    found = {r["column_name"]: r["null_rows"] for r in cleaning.nan_inspector(df, ["a", ["b"]]).collect()}
    assert found == {"any": 2, "a": 1, "b": 2}
    with pytest.raises(ValueError):
        cleaning.nan_inspector(df, ["a"], raise_on_null=True)


def test_undersampling_sizes(spark):
    df = spark.range(300).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("c"))
    half = sampling.undersample_binary(df, "y", ["id"], 1.0).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in half} == {0: 100, 1: 100}
    loose = sampling.undersample_binary(df, "y", ["id"], 0.8).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in loose} == {0: 125, 1: 100}


# -- files -------------------------------------------------------------------------------------


def test_separator_fallback(spark, tmp_path):
    for sep, name in ((",", "a.csv"), (";", "b.csv")):
        (tmp_path / name).write_text(f"A{sep}B\n1{sep}4\n2{sep}5\n")
        assert readers.csv_auto(spark, str(tmp_path / name)).columns == ["A", "B"]
    (tmp_path / "c.csv").write_text("A\n1\n")
    with pytest.raises(ValueError):
        readers.csv_auto(spark, str(tmp_path / "c.csv"))


def test_dated_folders_stay_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "2023-06-30")], "x int, obs string")
    sinks.write_prepared(df, str(tmp_path / "p"), "obs")
    again = sinks.read_prepared(spark, str(tmp_path / "p"), schema=df.schema)
    assert again.collect() == df.collect()
