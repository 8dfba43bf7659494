"""What a frame looks like: missing shares, distinct counts, distributions, target rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.exprs import NUMERIC, q
from scoreloom.operators.ordering import exact_quantiles, quantile_bin, quantile_edges


def long_form(
    df: DataFrame,
    columns: Sequence[str],
    carry: Sequence[str | Column] = (),
    as_type: str = "string",
    feature: str = "feature",
    value: str = "value",
) -> DataFrame:
    """One row per (row, column): the shape in which all columns share one aggregation."""
    carried = [q(c).alias(c) if isinstance(c, str) else c for c in carry]
    fractions = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}
    # adding 0 makes -0.0 and 0.0 one value
    values = [(q(c) + F.lit(0.0) if c in fractions else q(c)).cast(as_type) for c in columns]
    picked = df.select(*carried, *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    kept = picked.columns[: len(carried)]
    pairs = [
        F.struct(F.lit(c).alias(feature), F.col(f"_v{i}").alias(value)) for i, c in enumerate(columns)
    ]
    return picked.select(*[q(c) for c in kept], F.inline(F.array(*pairs)))


def per_item(
    df: DataFrame, items: Sequence[Sequence[Column]], aggs: Sequence[Column], carry: Sequence[Column] = ()
) -> DataFrame:
    """One row per item ``i`` with aggregates over its columns ``x0``, ``x1``, ...

    Hundreds of statistics share a few aggregates grouped by item number, combined map-side,
    instead of an aggregate list as wide as the items.
    """
    structs = [
        F.struct(F.lit(i).alias("i"), *[c.cast("double").alias(f"x{k}") for k, c in enumerate(item)])
        for i, item in enumerate(items)
    ]
    return df.select(*carry, F.inline(F.array(*structs))).groupBy("i").agg(*aggs)


def label_items(stats: DataFrame, labels: Sequence[str], name: str) -> DataFrame:
    """Replace the item number of ``per_item`` by its label."""
    texts = F.array(*[F.lit(t) for t in labels])
    rest = [c for c in stats.columns if c != "i"]
    return stats.select(F.element_at(texts, F.col("i") + 1).alias(name), *rest)


def missing_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, percent_missing), one aggregate pass over the frame."""
    columns = list(columns or df.columns)
    flags = [(F.when(q(c).isNull(), 100.0).otherwise(0.0),) for c in columns]
    return label_items(per_item(df, flags, [F.avg("x0").alias("percent_missing")]), columns, "column_name")


def missing_report(table: DataFrame, limit: int = 100) -> DataFrame:
    """Columns with anything missing, worst first."""
    return (
        table.filter(F.col("percent_missing") > 0)
        .orderBy(F.desc("percent_missing"), "column_name")
        .limit(limit)
    )


def with_total(counts: DataFrame, n: str, keys: Sequence[str] = (), total: str = "_total") -> DataFrame:
    """Add the sum of ``n`` over each group of keys (null is a group), or over everything.

    Totals are aggregated map-side and joined, so no task holds all rows of a group.
    """
    sums = counts.groupBy(*keys).agg(F.sum(n).alias(total))
    if not keys:
        return counts.join(F.broadcast(sums), F.lit(True))  # one row
    sums = sums.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(Column.__and__, [q(k).eqNullSafe(q(f"_of_{k}")) for k in keys])
    return counts.join(sums, same).drop(*[f"_of_{k}" for k in keys])


def class_distribution(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and share of each target value, nulls included, optionally within groups."""
    counts = with_total(df.groupBy(*by, target).agg(F.count("*").alias("rows")), "rows", by)
    return counts.select(*by, target, "rows", (F.col("rows") / F.col("_total")).alias("share"))


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct count per column, with null counted as one value.

    Values are combined map-side and counted per (column, value); nothing is gathered.
    """
    return (
        long_form(df, columns)
        .groupBy("feature", "value")
        .agg(F.count("*").alias("_rows"))
        .groupBy("feature")
        .agg(F.count("*").alias("n_distinct"))
    )


def eda_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Per column: type, counts, distinct, moments, quartiles and the most frequent values."""
    columns = list(columns or df.columns)
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NUMERIC)]
    counted = long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("rows"))
    basics = counted.groupBy("feature").agg(
        F.sum("rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
    )
    best = Window.partitionBy("feature").orderBy(F.desc("rows"), "value")
    ranked = counted.filter("value is not null").withColumn("place", F.row_number().over(best))
    frequent = (
        ranked.filter(F.col("place") <= top)
        .groupBy("feature")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value", "rows"))).alias("_top"))
        .select(
            "feature",
            F.array_join(
                F.transform("_top", lambda t: F.concat_ws("=", t["value"], t["rows"])), "; "
            ).alias("top_values"),
        )
    )
    out = basics.join(frequent, "feature", "left")
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    if numeric:
        out = out.join(_moments(df, numeric), "feature", "left")
    else:
        nothing = F.lit(None).cast("double")
        out = out.select("*", *[nothing.alias(m) for m in ("min", "q1", "median", "q3", "max", "mean", "std")])
    return out.select(
        F.col("feature").alias("column_name"),
        types[F.col("feature")].alias("data_type"),
        "n_rows",
        "n_missing",
        "n_distinct",
        "min",
        "q1",
        "median",
        "q3",
        "max",
        "mean",
        "std",
        "top_values",
    )


def _moments(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(numeric):
        x = q(c).cast("double")
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"m{i}")]
        aggs.append(F.stddev_samp(x).alias(f"s{i}"))
    rows = []
    for i, c in enumerate(numeric):
        q1, median, q3 = quartiles[c] or (None, None, None)
        rows.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"a{i}").alias("min"),
                F.lit(q1).cast("double").alias("q1"),
                F.lit(median).cast("double").alias("median"),
                F.lit(q3).cast("double").alias("q3"),
                F.col(f"b{i}").alias("max"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"s{i}").alias("std"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def eda_compare(
    left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, top: int = 5
) -> DataFrame:
    """Profiles of two frames side by side, columns of either."""
    a = eda_profile(left, columns and [c for c in columns if c in left.columns], top)
    b = eda_profile(right, columns and [c for c in columns if c in right.columns], top)
    rename = [c for c in a.columns if c != "column_name"]
    a = a.select("column_name", *[F.col(c).alias(f"processed_{c}") for c in rename])
    b = b.select("column_name", *[F.col(c).alias(f"full_{c}") for c in rename])
    return a.join(b, "column_name", "full")


def eda_vs_target(
    df: DataFrame, target: str, columns: Sequence[str], bins: int = 10
) -> DataFrame:
    """Rows and target rate per value of each column; numeric columns go by quantile bin."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NUMERIC)]
    edges = quantile_edges(df, numeric, bins) if numeric else {}
    groups = [
        (quantile_bin(c, edges[c]) if c in edges else q(c)).cast("string").alias(f"_b{i}")
        for i, c in enumerate(columns)
    ]
    binned = df.select(q(target).cast("double").alias("_y"), *groups)
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_b{i}").alias("bin")) for i, c in enumerate(columns)
    ]
    return (
        binned.select("_y", F.inline(F.array(*pairs)))
        .groupBy("column_name", "bin")
        .agg(F.count("*").alias("rows"), F.avg("_y").alias("target_rate"))
    )
