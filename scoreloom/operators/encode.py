"""Row-level feature engineering: dates, categories, ratios, rules, bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, product
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import names
from scoreloom.session import materialize
from scoreloom.functions.exprs import (
    DATES,
    NUMERIC,
    by_index,
    flag,
    hours_between,
    q,
    ratio,
    right_closed_index,
)
from scoreloom.operators.gram import ratio_means

MAX_CATEGORIES = 20

# Accepted date texts, tried in this order (shape of the text, then its pattern).
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$", None),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
    (r"^\d{6}$", "yyyyMM"),
    (r"^\d{8}$", "ddMMyyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
)


# -- dates -------------------------------------------------------------------------------------


def _parsed(column: str, shape: str, pattern: str | None) -> Column:
    text = q(column)
    if pattern is None:
        value = text.try_cast("timestamp")
    else:
        value = F.try_to_timestamp(text, F.lit(pattern))
    return F.when(text.rlike(shape), value)


def date_formats_of(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Columns whose every value parses -> the first format that reads them all. One pass."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.count(q(c)).alias(f"n{i}"))
        for j, (shape, pattern) in enumerate(DATE_FORMATS):
            aggs.append(F.count(_parsed(c, shape, pattern)).alias(f"n{i}_{j}"))
    row = df.agg(*aggs).first()
    found = {}
    for i, c in enumerate(columns):
        whole = [j for j in range(len(DATE_FORMATS)) if row[f"n{i}_{j}"] == row[f"n{i}"] > 0]
        if whole:
            found[c] = whole[0]
    return found


def add_parsed_dates(df: DataFrame, formats: Mapping[str, int], suffix: str = "_date") -> DataFrame:
    return df.select(
        "*", *[_parsed(c, *DATE_FORMATS[j]).alias(f"{c}{suffix}") for c, j in formats.items()]
    )


def parse_dates(df: DataFrame, columns: Sequence[str], suffix: str = "_date") -> DataFrame:
    """Add ``<col>_date`` for each string column that is wholly readable as dates."""
    return add_parsed_dates(df, date_formats_of(df, columns), suffix)


def has_single_row(df: DataFrame) -> bool:
    return df.limit(2).count() == 1


def date_diff_hours(df: DataFrame, dates: Sequence[str], always: bool = False) -> DataFrame:
    """Absolute hours between every ordered pair of date columns.

    On its own a one-row frame gets none; a fitted plan adds them ``always``, as its features do not depend on the batch.
    """
    if len(dates) < 2 or not always and has_single_row(df):
        return df
    pairs = [(a, b) for a in dates for b in dates if a != b]
    return df.select("*", *[hours_between(a, b).alias(f"{a}_diff_hours_{b}") for a, b in pairs])


def date_parts(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Day of month and weekday (Monday is 0) of each date column."""
    parts = []
    for c in dates:
        parts.append(F.dayofmonth(q(c)).alias(f"{c}_MonthDay_NB"))
        parts.append(F.weekday(q(c)).alias(f"{c}_WeekDay_NB"))
    return df.select("*", *parts)


# -- categories --------------------------------------------------------------------------------


def cardinalities(df: DataFrame, columns: Sequence[str], limit: int = 200) -> dict[str, int]:
    """Distinct values per column with null counted as a value.

    A bounded sketch screens first. Its deviation is 5 %, so a column that it puts above twice the caller's ``limit`` is
    above that limit for certain and keeps the estimate; all others are counted exactly.
    """
    if not columns:
        return {}
    screen = df.agg(
        *[
            (F.approx_count_distinct(q(c), 0.05) + F.max(F.when(q(c).isNull(), 1).otherwise(0))).alias(
                f"c{i}"
            )
            for i, c in enumerate(columns)
        ]
    ).first()
    counts = {c: screen[i] or 0 for i, c in enumerate(columns)}
    close = [c for c in columns if counts[c] <= 2 * limit + 100]
    if close:
        exact = _value_counts(df, close).groupBy("feature").agg(F.count("*").alias("n")).collect()
        counts.update({r["feature"]: r["n"] for r in exact})
    return counts


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, rows), values as text: one map-side combined shuffle for all columns."""
    from scoreloom.operators.profile import long_form

    return long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("rows"))


def high_cardinality_filter(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES
) -> list[str]:
    """Columns with at most ``limit`` distinct values."""
    counts = cardinalities(df, columns, limit)
    return [c for c in columns if counts[c] <= limit]


def numeric_to_categorical(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES
) -> list[str]:
    """Numeric columns with fewer than ``limit`` distinct values: they act as categories."""
    counts = cardinalities(df, columns, limit)
    return [c for c in columns if counts[c] < limit]


@dataclass(frozen=True)
class OneHot:
    """Levels of each column, first level left out; apply to any frame for the same columns."""

    levels: dict[str, list[str]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], max_levels: int = 10_000) -> "OneHot":
        if not columns:
            return cls({})
        bound = len(columns) * (max_levels + 1)
        seen = _value_counts(df, columns).select("feature", "value").limit(bound + 1).collect()
        levels: dict[str, list[str]] = {c: [] for c in columns}
        for row in seen:
            if row["value"] is not None:
                levels[row["feature"]].append(row["value"])
        too_many = [c for c in columns if len(levels[c]) > max_levels]
        if too_many or len(seen) > bound:
            raise ValueError(f"too many levels for dummies: {too_many or list(columns)}")
        for c in columns:
            numeric = isinstance(df.schema[c].dataType, NUMERIC)
            levels[c].sort(key=float if numeric else str)
        return cls(levels)

    def names(self) -> list[str]:
        return [name for name, _ in self._flags()]

    def _flags(self) -> list[tuple[str, Column]]:
        flags = []
        for c, values in self.levels.items():
            if not values:
                continue
            text = q(c).cast("string")
            flags += [(f"{c}{names.DUMMY}{v}", flag(text == F.lit(v))) for v in values[1:]]
            flags.append((f"{c}{names.DUMMY}nan", flag(q(c).isNull())))
        return flags

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[column.alias(name) for name, column in self._flags()])


def one_hot(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return OneHot.fit(df if fit_on is None else fit_on, columns).transform(df)


def code_table(df: DataFrame, column: str, code: str, label: str) -> DataFrame:
    """Distinct values numbered from 0 in sorted order.

    Values are cut into sorted ranges; each range is numbered by itself and shifted by the sizes of those before it.
    """
    values = df.select(q(column).alias(label)).filter(q(label).isNotNull()).distinct()
    ranged = materialize(
        values.repartitionByRange(q(label)).withColumn("_range", F.spark_partition_id()), "codes"
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(label))
    numbered = ranged.withColumn("_rn", inside).join(F.broadcast(offsets), "_range")
    return numbered.select((F.col("_off") + F.col("_rn") - 1).cast("int").alias(code), label)


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Add ``<col>_cat``: position of the value among the sorted values, -1 for null."""
    codes = code_table(df, column, "_code", "_label")
    joined = df.join(codes, q(column) == F.col("_label"), "left")
    return joined.select(*df.columns, F.coalesce(F.col("_code"), F.lit(-1)).alias(f"{column}_cat"))


def label_encode(
    df: DataFrame, column: str, out: str | None = None, fit_on: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Target as 0..k-1 in sorted order, with the mapping (class_encoded_as, class_label)."""
    mapping = code_table(df if fit_on is None else fit_on, column, "class_encoded_as", "class_label")
    joined = df.join(mapping, q(column) == F.col("class_label"), "left")
    encoded = joined.select(
        *[q(c) for c in df.columns if c != (out or column)],
        F.col("class_encoded_as").alias(out or column),
    )
    return encoded, mapping


def decode_labels(df: DataFrame, code: str, mapping: DataFrame, out: str = "class_label") -> DataFrame:
    """Class label of each code; the mapping holds one row per class."""
    known = mapping.select(
        F.col("class_encoded_as").alias("_code"), F.col("class_label").alias("_label")
    )
    joined = df.join(known, q(code) == F.col("_code"), "left")
    return joined.select(*df.columns, F.col("_label").alias(out))


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """Make a column numeric by the first rule that fits its type and values."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.ShortType, T.ByteType)):
        return df
    if isinstance(kind, T.BooleanType):
        value = q(column).cast("int")
    elif isinstance(kind, DATES):
        value = F.unix_seconds(q(column).cast("timestamp"))
    elif isinstance(kind, T.StringType):
        number = q(column).try_cast("double")
        if df.filter(number.isNotNull()).limit(1).count() == 0:
            coded = category_codes(df, column)
            return coded.select(
                *[(q(f"{column}_cat") if c == column else q(c)).alias(c) for c in df.columns]
            )
        value = number
    else:
        value = q(column).cast("double")
    return df.select(*[(value if c == column else q(c)).alias(c) for c in df.columns])


# -- ratios ------------------------------------------------------------------------------------


def ratio_pairs(columns: Sequence[str], keep: Sequence[str] = ()) -> list[tuple[str, str]]:
    """Unordered pairs in column order; with kept names, all ordered pairs of what they name."""
    if not keep:
        return list(combinations(columns, 2))
    shortlist = [c for c in columns if names.kept_by(c, keep)]
    return list(product(shortlist, shortlist))


@dataclass(frozen=True)
class Ratios:
    """Ratio columns with the mean that stands in where a quotient is not finite."""

    fills: dict[tuple[str, str], float | None]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> "Ratios":
        """Means over finite quotients, in one scan for all pairs; a pair without any is left out."""
        pairs = ratio_pairs(columns, keep)
        used = names.unique([c for pair in pairs for c in pair])
        means = ratio_means(df, used, pairs)
        return cls({pair: means[pair] for pair in pairs if pair in means})

    def names(self) -> list[str]:
        return [f"{a}{names.DIV_RATIO}{b}" for a, b in self.fills]

    def columns(self) -> list[Column]:
        return [
            F.coalesce(ratio(a, b), F.lit(mean)).alias(f"{a}{names.DIV_RATIO}{b}")
            for (a, b), mean in self.fills.items()
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self.columns())


def pairwise_ratios(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return Ratios.fit(df, columns, keep).transform(df)


# -- rules, bands, flags -----------------------------------------------------------------------


def _rule(spec: Mapping[str, Any]) -> Column:
    kind = spec["type"]
    if kind == "ratio":
        return ratio(spec["raw_col_left"], spec["raw_col_right"])
    x, cut = q(spec["raw_col"]), spec["cutpoint"]
    low, high = cut if isinstance(cut, (list, tuple)) else (cut, cut)
    # Names of the rule types.
    conditions = {
        "single": x == F.lit(low),
        "less_than": x < F.lit(low),
        "greater_than": x > F.lit(low),
        "less_eq_to": x <= F.lit(low),
        "greater_eq_to": x >= F.lit(low),
        "between_left_incl": (x >= F.lit(low)) & (x < F.lit(high)),
        "between_right_incl": (x > F.lit(low)) & (x <= F.lit(high)),
        "between_both_incl": (x >= F.lit(low)) & (x <= F.lit(high)),
        "between": (x > F.lit(low)) & (x < F.lit(high)),
    }
    if kind not in conditions:
        raise ValueError(f"unknown rule type {kind}")
    return F.when(conditions[kind], 1).otherwise(0)


def rule_predictors(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Add one predictor per rule: a 0/1 test of a raw column, or a ratio of two."""
    return df.select("*", *[_rule(spec).alias(name) for name, spec in rules.items()])


def score_bands(df: DataFrame, score: str, cut_offs: Sequence[float], out: str) -> DataFrame:
    """Right-closed band of a score as text; outside every band, or missing, is ``nan``."""
    labels = names.right_closed_labels(cut_offs)
    index = right_closed_index(q(score), [float(c) for c in cut_offs])
    return df.withColumn(out, by_index(index, labels, default="nan"))


def feature_labels(df: DataFrame, feature: str) -> DataFrame:
    """Add ``mouchard_name`` (readable raw name) and ``cut_off_value`` read off a feature name."""
    name = q(feature)
    tree = "_tree"

    def head(mark: str) -> Column:
        return F.substring_index(name, mark, 1)

    def tail(mark: str) -> Column:
        return F.expr(f"substring({_sql(feature)}, length(substring_index({_sql(feature)}, '{mark}', 1)) + {len(mark) + 1})")

    dummy, stump = name.contains("dummie_"), name.contains("tree")
    prefix = F.when(dummy, head(names.DUMMY)).when(stump, head(tree)).otherwise(name)
    suffix = F.when(dummy, tail(names.DUMMY)).when(stump, F.concat(F.lit("> "), tail(tree))).otherwise("")
    readable = F.replace(F.replace(prefix, F.lit(names.BINNED), F.lit("")), F.lit(names.DIV_RATIO), F.lit(" / "))
    # Names of the added columns.
    return df.select(
        "*",
        readable.alias("mouchard_name"),
        F.replace(suffix, F.lit("_"), F.lit(" ")).alias("cut_off_value"),
    )


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def signal_flag(
    df: DataFrame,
    col1: str,
    col1_value: float,
    col2: str | None = None,
    col2_value: float | None = None,
    direction: str = "up",
    out: str = "signal_trade",
) -> DataFrame:
    """1 when the score is high enough and the second measure lies on the wanted side."""
    passed = q(col1) >= F.lit(col1_value)
    if col2:
        scaled = q(col2) * 10000
        limit = F.lit(float(col2_value))
        passed = passed & (scaled > limit if "up" in direction else scaled <= limit)
    return df.withColumn(out, F.when(passed, 1).otherwise(0))


def add_run_constants(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in values.items()})

