"""Nothing is capped, dropped or decided otherwise because a table is wide, large, or holds odd values."""

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import encode, metrics, ordering, profile, report


def test_crosstabs_keep_300_bands(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("band"), F.lit("p1").alias("obs"), F.lit("train").alias("dataset"), (F.col("id") % 2).alias("y")
    )
    rows = report.crosstab_margins_long(df, ["dataset", "y"], "band").collect()
    assert next(r.n for r in rows if r.dataset == "All" and r.band == "All") == 300
    assert sum(r.n for r in rows if r.dataset == "All" and r.band != "All") == 300
    assert sum(r.n for r in rows if r.dataset == "train" and r.band == "All") == 300
    assert report.crosstab_values_long(df, "obs", "band", "y").count() == 300


@pytest.mark.parametrize("rows_per_range", [9, 10**9])
def test_quantiles_with_infinities_and_nan(spark, rows_per_range):
    values = [-math.inf] * 5 + [float(i) for i in range(50)] + [math.inf] * 5 + [None]
    df = spark.createDataFrame([(v, 1.0) for v in values], "x double, c double")
    got = ordering.exact_quantiles(df, ["x", "c"], [0.0, 0.25, 0.5, 1.0], rows_per_range)
    assert got["x"][0] == -math.inf and got["x"][-1] == math.inf
    assert got["x"][1:3] == [9.75, 24.5] and got["c"] == [1.0] * 4
    assert len(ordering.exact_quantiles(df.withColumn("x", F.lit(math.nan)), ["x"], [0.5], rows_per_range)["x"]) == 1


def test_job_count_does_not_follow_the_columns(spark):
    def jobs(n):
        df = spark.range(200).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(n)])
        spark.sparkContext.setJobGroup(f"columns-{n}", "quantiles")
        ordering.exact_quantiles(df, df.columns, [0.1, 0.5], 50)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"columns-{n}"))

    assert jobs(2) == jobs(20)


def test_null_groups_keep_their_rows(spark):
    rows = [("a", 0, 0.1), ("a", 1, 0.9), (None, 0, 0.2), (None, 1, 0.8)]
    df = spark.createDataFrame(rows, "dataset string, y int, score double")
    areas = metrics.auc(df, "y", "score", ["dataset"]).collect()
    assert {r["dataset"] for r in areas} == {"a", None}


def test_exact_cardinality_near_any_limit(spark):
    df = spark.range(9500).select((F.col("id") % 950).cast("string").alias("s"), (F.col("id") % 950).alias("n"))
    assert encode.high_cardinality_filter(df, ["s"], 960) == ["s"]
    assert encode.high_cardinality_filter(df, ["s"], 949) == []
    assert encode.numeric_to_categorical(df, ["n"], 951) == ["n"]
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert profile.cardinality(zeros, ["x"]).first()["n_distinct"] == 1


def test_codes_of_many_values_in_order(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id")).alias("s"))
    codes = {r.label: r.code for r in encode.code_table(df, "s", "code", "label").collect()}
    assert codes == {s: i for i, s in enumerate(sorted(f"v{i}" for i in range(3000)))}


def test_deciles_of_more_datasets_than_columns_could_hold(spark):
    rows = [(f"d{d}" if d else None, float((i * 7 + d) % 23) if i % 9 else None, i % 2) for d in range(151) for i in range(40)]
    df = spark.createDataFrame(rows, "d string, x double, y int")
    got = {(r["d"], r["decile"]): (r["volume"], r["rate"]) for r in report.decile_rates(df, "x", "y", "d").collect()}
    assert {d for d, _ in got} == {f"d{d}" for d in range(1, 151)}
    for name in ("d1", "d77", "d150"):
        alone = {r["decile"]: (r["volume"], r["rate"]) for r in report.decile_rates(df.filter(F.col("d") == name), "x", "y").collect()}
        assert {k: v for (d, k), v in got.items() if d == name} == alone


def test_bins_of_several_columns_equal_those_of_one(spark):
    df = spark.range(300).select("id", (F.col("id") * 37 % 101).alias("a"), F.lit(None).cast("double").alias("b"))
    both = ordering.several_quantile_bins(df, {"a": (10, "p"), "b": (4, "z")})
    assert both.select("id", "p").exceptAll(ordering.quantile_bins(df, "a", 10, "p").select("id", "p")).count() == 0
    assert both.filter("z is not null").count() == 0
