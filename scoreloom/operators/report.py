"""Grouped tables used to judge a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q, ratio
from scoreloom.operators.ordering import quantile_bin, quantile_edges, running_totals
from scoreloom.operators.profile import long_form, with_total
from scoreloom.session import materialize


def union_splits(*splits: DataFrame) -> DataFrame:
    out = splits[0]
    for split in splits[1:]:
        out = out.unionByName(split, allowMissingColumns=True)
    return out


def labelled_union(splits: Mapping[str, DataFrame], out: str = "Dataset") -> DataFrame:
    return union_splits(*[df.withColumn(out, F.lit(name)) for name, df in splits.items()])


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def criterion_by_period(df: DataFrame, obs: str, y: str) -> DataFrame:
    """Mean, sum and count of the target per period; a missing period is no group."""
    return (
        df.filter(q(obs).isNotNull())
        .groupBy(obs)
        .agg(F.avg(q(y)).alias("rate"), F.sum(q(y)).alias("positives"), F.count(q(y)).alias("volume"))
    )


def class_share_by_period(df: DataFrame, obs: str, y: str) -> DataFrame:
    """Rows per (period, class) with the period total and the share."""
    return period_totals(
        df.filter(q(obs).isNotNull() & q(y).isNotNull()).groupBy(obs, y).agg(F.count("*").alias("counts")), obs
    )


def period_totals(counts: DataFrame, obs: str, n: str = "counts") -> DataFrame:
    """Bring each period's total to its class rows; the input has one row per period and class."""
    total = F.sum(n).over(Window.partitionBy(obs))
    return counts.select("*", total.alias("total"), (F.col(n) / total).alias("percentage"))


def crosstab_margins(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence, label: str = "All"
) -> DataFrame:
    """Counts of row keys against the listed column values with an ``All`` row and column.

    Missing keys are left out. Listing the values spares a pass to find them.
    """
    known = q(column).isNotNull()
    for r in rows:
        known = known & q(r).isNotNull()
    counts = df.filter(known & q(column).isin(list(values)))
    cells = [F.count_if(q(column) == F.lit(v)).alias(str(v)) for v in values]
    whole = F.count("*").alias(label)
    keyed = counts.select(*[q(r).cast("string").alias(r) for r in rows], q(column).alias(column))
    grouped = keyed.groupingSets([[F.col(r) for r in rows], []], *[F.col(r) for r in rows])
    table = grouped.agg(F.grouping_id().alias("_g"), *cells, whole)
    return table.select(
        *[
            F.when(F.col("_g") > 0, label if i == 0 else "").otherwise(q(r)).alias(r)
            for i, r in enumerate(rows)
        ],
        *[q(str(v)) for v in values],
        label,
    )


def crosstab_long(df: DataFrame, row: str, column: str, label: str = "All") -> DataFrame:
    """(row, column, n) with margins from one cube."""
    known = df.filter(q(row).isNotNull() & q(column).isNotNull())
    texts = known.select(q(row).cast("string").alias(row), q(column).cast("string").alias(column))
    cells = texts.cube(row, column).agg(
        F.count("*").alias("n"), F.grouping(row).alias("_a"), F.grouping(column).alias("_b")
    )
    return cells.select(
        F.when(F.col("_a") == 1, label).otherwise(q(row)).alias(row),
        F.when(F.col("_b") == 1, label).otherwise(q(column)).alias(column),
        "n",
    )


def crosstab_normalized(df: DataFrame, row: str, column: str, by: str = "all") -> DataFrame:
    """(row, column, n, share) with shares of the grand total (``all``) or of the row (``index``)."""
    known = df.filter(q(row).isNotNull() & q(column).isNotNull())
    counts = known.groupBy(row, column).agg(F.count("*").alias("n"))
    totals = with_total(counts, "n", [row] if by == "index" else [])
    return totals.select(*counts.columns, (F.col("n") / F.col("_total")).alias("share"))


def crosstab_margins_long(df: DataFrame, rows: Sequence[str], column: str, label: str = "All") -> DataFrame:
    """(row keys, column, n) with margins, for any number of column values; missing keys are left out."""
    known = reduce(Column.__and__, [q(c).isNotNull() for c in (*rows, column)])
    texts = df.filter(known).select(*[q(c).cast("string").alias(c) for c in (*rows, column)])
    keys = [F.col(f"`{r}`") for r in rows]
    sets = [[*keys, q(column)], keys, [q(column)], []]
    cells = texts.groupingSets(sets, *keys, q(column)).agg(
        F.count("*").alias("n"), F.grouping(rows[0]).alias("_a"), F.grouping(column).alias("_b")
    )
    return cells.select(
        *[F.when(F.col("_a") == 1, label if i == 0 else "").otherwise(q(r)).alias(r) for i, r in enumerate(rows)],
        F.when(F.col("_b") == 1, label).otherwise(q(column)).alias(column),
        "n",
    )


def crosstab_values_long(df: DataFrame, row: str, column: str, y: str) -> DataFrame:
    """(row, column, mean, count, sum) of y, for any number of column values."""
    known = df.filter(q(row).isNotNull() & q(column).isNotNull())
    return known.groupBy(row, column).agg(F.avg(q(y)).alias("mean"), F.count(q(y)).alias("count"), F.sum(q(y)).alias("sum"))


def crosstab_values(df: DataFrame, row: str, column: str, values: Sequence, y: str) -> DataFrame:
    """Mean, count and sum of y per row key, one column triple per listed value."""
    known = df.filter(q(row).isNotNull())
    aggs: list[Column] = []
    for v in values:
        cell = F.when(q(column) == F.lit(v), q(y))
        aggs += [
            F.avg(cell).alias(f"{v}_mean"),
            F.count(cell).alias(f"{v}_count"),
            F.sum(cell).alias(f"{v}_sum"),
        ]
    return known.groupBy(row).agg(*aggs)


def predictor_grid(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Per feature value: negatives, positives, total, share of all rows, target rate.

    All features go through one aggregation.
    """
    rows = long_form(df.filter(q(y).isNotNull()), features, [q(y).alias("_y")]).filter("value is not null")
    counts = rows.groupBy("feature", "value").agg(
        F.count_if(F.col("_y") == 0).alias("Nb_negative_cases"),
        F.count_if(F.col("_y") == 1).alias("Nb_positive_cases"),
        F.count("*").alias("total_cases"),
    )
    rate = F.try_divide(
        F.col("Nb_positive_cases"), F.col("Nb_negative_cases") + F.col("Nb_positive_cases")
    )
    return with_total(counts, "total_cases", ["feature"]).select(
        *counts.columns,
        F.round(F.col("total_cases") / F.col("_total"), 2).alias("share"),
        F.round(rate, 2).alias("criterion_rate"),
    ).orderBy("feature", "criterion_rate", "value")


def coefficient_join(grid: DataFrame, coefficients: DataFrame) -> DataFrame:
    return grid.join(coefficients, "feature", "inner")


def describe_features(df: DataFrame, name: str, dictionary: DataFrame) -> DataFrame:
    """Add ``Description``: looked up, or both sides of ``a / b`` looked up and joined.

    ``dictionary`` has columns Variable and Description.
    """
    missing = F.lit("Missing description")
    known = dictionary.groupBy("Variable").agg(F.min("Description").alias("_text"))
    left = known.select(F.col("Variable").alias("_va"), F.col("_text").alias("_ta"))
    right = known.select(F.col("Variable").alias("_vb"), F.col("_text").alias("_tb"))
    text = q(name)
    slash = text.contains("/")
    head = F.substring_index(text, "/", 1)
    tail = F.when(slash, text.substr(F.length(head) + 2, F.length(text)))
    keyed = df.select(
        "*",
        F.when(slash, F.replace(head, F.lit(" "), F.lit(""))).otherwise(text).alias("_ka"),
        F.replace(tail, F.lit(" "), F.lit("")).alias("_kb"),
    )
    joined = keyed.join(left, F.col("_ka") == F.col("_va"), "left").join(
        right, F.col("_kb") == F.col("_vb"), "left"
    )
    one, two = F.coalesce("_ta", missing), F.coalesce("_tb", missing)
    described = (
        F.when(text.contains("const"), "").when(slash, F.concat(one, F.lit(" / "), two)).otherwise(one)
    )
    return joined.select(*df.columns, described.alias("Description"))


def band_rates(df: DataFrame, band: str, y: str) -> DataFrame:
    """Target rate and rows per score band."""
    return (
        df.filter(q(band).isNotNull())
        .groupBy(band)
        .agg(F.avg(q(y)).alias("rate"), F.count(q(y)).alias("volume"))
    )


def secondary_rate(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Mean of the per-row ratio a / b per group (not the ratio of sums)."""
    return (
        df.filter(q(group).isNotNull()).groupBy(group).agg(F.avg(ratio(a, b)).alias("secondary_rate"))
    )


def decile_rates(df: DataFrame, x: str, y: str, by: str | None = None, bins: int = 10) -> DataFrame:
    """Rows and target rate per quantile bin; with ``by`` each listed dataset has its own edges."""
    if by is not None:
        return _decile_rates_by(df, x, y, by, bins)
    narrow = materialize(df.select(q(x).cast("double").alias("x"), q(y).alias("y")), "deciles")  # edges and rates both read it
    edges = quantile_edges(narrow, ["x"], bins, stored=True)["x"]
    binned = narrow.select(quantile_bin("x", edges).alias("decile"), "y")
    return (
        binned.filter("decile is not null")
        .groupBy("decile")
        .agg(F.count("y").alias("volume"), F.avg("y").alias("rate"))
    )


def _decile_rates_by(df: DataFrame, x: str, y: str, by: str, bins: int) -> DataFrame:
    """Edges and rates of any number of datasets, both from one table of counts by (dataset, value)."""
    rows = df.filter(q(by).isNotNull()).select(q(by).alias("by"), (q(x).cast("double") + F.lit(0.0)).alias("x"), q(y).cast("double").alias("y"))
    sums = {"n": F.count("*"), "volume": F.count("y"), "hits": F.sum("y")}
    values = materialize(running_totals(rows, "x", sums, ["by"], cumulate=["n"]), "values")
    # ranks on both sides of each quantile, and the value that stands at each
    places = [F.lit(i / bins) * (F.col("all_n") - 1) for i in range(bins + 1)]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.least(F.floor(p) + 1, F.col("all_n") - 1)) for p in places])))
    here = F.filter(ranks, lambda r: (r >= F.col("cum_n") - F.col("n")) & (r < F.col("cum_n")))
    at = values.select("by", "x", "all_n", F.explode(here).alias("rank"))
    found = at.groupBy("by").agg(F.max("all_n").alias("all_n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def quantile(place: Column) -> Column:
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.least(F.floor(place) + 1, F.col("all_n") - 1))
        part = place - F.floor(place)
        return F.when((part == 0) | (low == high), low).otherwise((1 - part) * low + part * high)

    edges = found.select(F.col("by").alias("of"), F.array_sort(F.array_distinct(F.array(*[quantile(p) for p in places]))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    inside = (F.size("edges") > 1) & (F.col("x") >= F.element_at("edges", 1)) & (F.col("x") <= F.element_at("edges", -1))
    decile = F.when(inside, F.size(F.filter(inner, lambda e: F.col("x") > e)))
    binned = values.join(edges, F.col("by") == F.col("of")).select("by", decile.alias("decile"), "volume", "hits").filter("decile is not null")
    return (
        binned.groupBy(F.col("by").alias(by), "decile")
        .agg(F.sum("volume").alias("volume"), F.sum("hits").alias("hits"))
        .select(by, "decile", "volume", (F.try_divide("hits", F.col("volume"))).alias("rate"))
    )


def accumulation_points(df: DataFrame, score: str, top: int = 5) -> DataFrame:
    """Most frequent scores (3 decimals) with their share of all rows (2 decimals)."""
    counts = (
        df.filter(q(score).isNotNull()).groupBy(F.round(q(score), 3).alias("score")).agg(F.count("*").alias("n"))
    )
    share = F.round(F.col("n") / F.col("_total"), 2)
    return with_total(counts, "n").select("score", "n", share.alias("share")).orderBy(F.desc("n"), "score").limit(top)


def predictor_band_profile(df: DataFrame, features: Sequence[str], band: str) -> DataFrame:
    """Of the rows on which a 0/1 feature is 1: share of each band, per feature."""
    rows = long_form(df.filter(q(band).isNotNull()), features, [band], as_type="int").filter("value = 1")
    counts = rows.groupBy("feature", band).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("feature"))
    return counts.select("feature", band, "n", share.alias("share"))


def ratio_profile(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Three tables in one: mean ratio per decile of a and of b, target by 20-quantile of a / b.

    A quotient that is not finite because of a zero denominator counts as 0.
    """
    x1, x2 = q(a).cast("double"), q(b).cast("double")
    base = df.select(
        x1.alias("a"),
        x2.alias("b"),
        F.when((x2 == 0) & (x1 != 0), 0.0).otherwise(F.try_divide(x1, x2)).alias("ratio"),
        q(y).alias("y"),
    )
    base = materialize(base, "ratio")  # edges and profile both read it
    tenths = quantile_edges(base, ["a", "b"], 10, stored=True)
    twentieths = quantile_edges(base, ["ratio"], 20, stored=True)["ratio"]
    parts = [
        ("by_left", quantile_bin("a", tenths["a"])),
        ("by_right", quantile_bin("b", tenths["b"])),
        ("by_ratio", quantile_bin("ratio", twentieths)),
    ]
    rows = F.array(*[F.struct(F.lit(t).alias("part"), c.alias("bin")) for t, c in parts])
    return (
        base.select("ratio", "y", F.inline(rows))
        .filter("bin is not null")
        .groupBy("part", "bin")
        .agg(
            F.avg("ratio").alias("mean_ratio"),
            F.avg("y").alias("rate"),
            F.count("y").alias("volume"),
        )
    )


def modality_evolution(df: DataFrame, obs: str, features: Sequence[str], y: str) -> DataFrame:
    """Per feature and period: share of each value and the target rate at it."""
    rows = long_form(df.filter(q(obs).isNotNull()), features, [obs, q(y).alias("_y")]).filter("value is not null")
    counts = rows.groupBy("feature", obs, "value").agg(
        F.count("*").alias("n"), F.sum("_y").alias("_s"), F.count("_y").alias("_c")
    )
    share = F.col("n") / F.col("_total")
    return with_total(counts, "n", ["feature", obs]).select(
        "feature", obs, "value", "n", share.alias("share"), F.try_divide("_s", "_c").alias("rate")
    )


def scope_summary(df: DataFrame, dataset: str, obs: str, y: str, score: str | None = None) -> DataFrame:
    """Per dataset: first and last period, rows, target rate (3 decimals), distinct scores."""
    aggs = [
        F.min(q(obs)).alias("min_obs"),
        F.max(q(obs)).alias("max_obs"),
        F.count("*").alias("volume"),
        F.round(F.avg(q(y)), 3).alias("criterion_rate"),
    ]
    summary = df.groupBy(dataset).agg(*aggs)
    if score is None:
        return summary
    # counted from grouped pairs, so no dataset's scores meet in one task
    scores = df.filter(q(score).isNotNull()).select(dataset, score).distinct()
    bands = scores.groupBy(dataset).agg(F.count("*").alias("nb_of_bands"))
    return summary.join(bands, dataset, "left").fillna(0, ["nb_of_bands"])
