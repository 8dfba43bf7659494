"""Row filters, hold-out labels and columns dropped by what they hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.exprs import as_column, q

BROADCAST_ROWS = 10_000


def in_periods(column: str | Column, periods: Sequence[str]) -> Column:
    """Two-valued membership: a missing period is simply not in the list."""
    if not periods:
        return F.lit(False)
    return F.coalesce(as_column(column).isin(list(periods)), F.lit(False))


def exclude_periods(df: DataFrame, obs: str, periods: Sequence[str]) -> DataFrame:
    return df.filter(~in_periods(obs, periods))


def period_in_list(df: DataFrame, obs: str, periods: Sequence[str], negate: bool = False) -> DataFrame:
    inside = in_periods(obs, periods)
    return df.filter(~inside if negate else inside)


def temporal_holdout(
    df: DataFrame, obs: str, periods: Sequence[str], out: str = "dataset", rest: str = "rest"
) -> DataFrame:
    """Label rows of each hold-out period t1, t2, ...; stop when a period has no rows."""
    counts = dict(df.filter(in_periods(obs, periods)).groupBy(obs).count().collect())
    empty = [p for p in periods if not counts.get(p)]
    if empty:
        raise ValueError(f"no rows for validation period(s) {empty}")
    return df.withColumn(out, holdout_label(obs, periods, F.lit(rest)))


def holdout_label(obs: str, periods: Sequence[str], otherwise: Column) -> Column:
    label = F.when(F.lit(False), "")
    for i, period in enumerate(periods, start=1):
        label = label.when(q(obs) == F.lit(period), f"t{i}")
    return label.otherwise(otherwise)


def train_test_label(bucket: str | Column, train_percent: int = 67) -> Column:
    """Train or test by a whole-number hash of the row key; the same row always lands alike."""
    return F.when(F.pmod(as_column(bucket), F.lit(100)) < train_percent, "train").otherwise("test")


def train_test_split(
    df: DataFrame, bucket: str | Column, train_percent: int = 67, out: str = "dataset"
) -> DataFrame:
    return df.withColumn(out, train_test_label(bucket, train_percent))


def label_splits(
    df: DataFrame,
    obs: str,
    periods: Sequence[str],
    bucket: str | Column,
    train_percent: int = 67,
    out: str = "dataset",
) -> DataFrame:
    """train / test / t1 / t2 / t3 in one column."""
    labelled = temporal_holdout(df, obs, periods, out)
    return labelled.withColumn(
        out, F.when(q(out) == "rest", train_test_label(bucket, train_percent)).otherwise(q(out))
    )


def null_shares(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(
        F.count("*").alias("n"), *[F.count(q(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: (1 - row[f"c{i}"] / row["n"]) if row["n"] else 0.0 for i, c in enumerate(columns)}


def drop_sparse_columns(
    df: DataFrame, threshold: float = 0.80, columns: Sequence[str] | None = None
) -> DataFrame:
    """Drop columns whose share of nulls exceeds the threshold."""
    shares = null_shares(df, columns or df.columns)
    return df.drop(*[c for c, share in shares.items() if share > threshold])


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with exactly one distinct value (nulls are not a value)."""
    if not columns:
        return []
    row = df.agg(
        *[(F.min(q(c)) == F.max(q(c))).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    return [c for i, c in enumerate(columns) if row[i]]


def drop_constant_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*constant_columns(df, columns))


def drop_immature_rows(df: DataFrame, time: str, periods: int) -> DataFrame:
    """Drop rows at the newest ``periods`` distinct times: their outcome is not known yet."""
    newest = df.select(time).distinct().orderBy(F.desc_nulls_last(time)).limit(periods)
    if periods <= BROADCAST_ROWS:
        newest = F.broadcast(newest)
    return df.join(newest, time, "left_anti")


def cutoff_filter(df: DataFrame, score: str, cutoff: float = 0.5) -> DataFrame:
    return df.filter(q(score) >= F.lit(cutoff))
