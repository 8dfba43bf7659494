import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import ordering


@pytest.fixture(scope="module")
def values(spark):
    # half of the rows share one value; the rest are spread and partly tied
    rng = np.random.default_rng(1)
    x = np.concatenate([np.full(3000, 5.0), np.round(rng.normal(0, 10, 3000), 1)])
    y = (rng.random(6000) < 0.3).astype(int)
    rows = [(i, float(v), int(t), "hot" if i % 3 else f"k{i % 50}") for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x double, y int, k string").cache(), rows


PROBABILITIES = [i / 10 for i in range(11)]


@pytest.mark.parametrize("small_rows", [7, 10**9])
def test_quantiles_equal_numpy_on_both_paths(values, small_rows):
    df, rows = values
    want = np.quantile([r[1] for r in rows], PROBABILITIES)
    got = ordering.exact_quantiles(df, ["x"], PROBABILITIES, small_rows)["x"]
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_quantile_of_nulls_only_and_of_one_row(spark):
    df = spark.createDataFrame([(None, 3.0), (None, None)], "a double, b double")
    got = ordering.exact_quantiles(df, ["a", "b"], [0.0, 0.5])
    assert got == {"a": [], "b": [3.0, 3.0]}


def test_select_ranks_reports_rows_below(values):
    df, rows = values
    x = sorted(r[1] for r in rows)
    for rank, (value, below, equal) in ordering.select_ranks(df, "x", [0, 2999, 5999], 6000, 7).items():
        assert value == x[rank]
        assert below == sum(v < value for v in x)
        assert equal == x.count(value)


def test_quantile_bins_keep_ties_together_and_edges_right_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]], "x double")
    got = {r["x"]: r["b"] for r in ordering.quantile_bins(df, "x", 4, "b").collect()}
    edges = sorted(set(np.quantile([1, 1, 1, 1, 2, 3, 4, 5, 6, 7], [0, 0.25, 0.5, 0.75, 1])))
    for x, b in got.items():
        assert b == max(1, sum(e < x for e in edges)) - 1


def test_constant_column_has_no_bins(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["b"] for r in ordering.quantile_bins(df, "x", 10, "b").collect()] == [None, None]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_one_pass(values, descending):
    df, rows = values
    got = ordering.running_totals(df, "x", {"n": F.count("*"), "p": F.sum("y")}, ["k"], descending, ranges=8, one_range=0)
    groups: dict = {}
    for _, x, y, k in rows:
        groups.setdefault(k, {}).setdefault(x, [0, 0])
        groups[k][x][0] += 1
        groups[k][x][1] += y
    want = {}
    for k, cells in groups.items():
        n = p = 0
        for x in sorted(cells, reverse=descending):
            n, p = n + cells[x][0], p + cells[x][1]
            want[k, x] = (n, p)
    assert {(r["k"], r["x"]): (r["cum_n"], r["cum_p"]) for r in got.collect()} == want


def test_row_numbers_of_a_hot_group_and_null_keys(spark):
    rows = [(i, "hot" if i < 500 else "cold", (i * 37) % 500) for i in range(700)] + [(999, None, 1)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = {r["id"]: (r["RN1"], r["RN_1"]) for r in ordering.row_number_both(df, ["k"], ["t", "id"], ranges=8).collect()}
    for key in ("hot", "cold"):
        ordered = sorted((t, i) for i, k, t in rows if k == key)
        for place, (_, i) in enumerate(ordered, start=1):
            assert got[i] == (place, len(ordered) - place + 1)
    assert got[999] == (None, None)


def test_one_key_and_one_date_are_numbered_by_many_tasks(spark):
    df = spark.range(8000).select(F.lit("k").alias("k"), F.lit("2024-01-01").alias("t"), (F.col("id") * 7919 % 8009).alias("id"))
    dealt = ordering._dealt_by_range(df, ["k", "t", "id"], 8).groupBy("_range").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) <= 2000
    got = ordering.row_number_both(df, ["k"], ["t", "id"], ranges=8).orderBy("id").collect()
    assert [(r["RN1"], r["RN_1"]) for r in got] == [(i + 1, 8000 - i) for i in range(8000)]


@pytest.mark.parametrize("small_rows", [7, 10**9])
def test_first_rows_takes_exactly_n(values, small_rows):
    df, rows = values
    for n in (0, 1, 2500, 4100, 6000):
        want = {r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))[:n]}
        got = df.filter(ordering.first_rows(df, ["x", "id"], n, small_rows))
        assert {r["id"] for r in got.collect()} == want


def test_first_rows_needs_identifying_columns(values):
    with pytest.raises(ValueError):
        ordering.first_rows(values[0], ["x"], 2500)
