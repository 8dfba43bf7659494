"""Tables out: prepared data, feature lists, splits, metrics, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoreloom.functions.exprs import q


def _by_folder(df: DataFrame, column: str) -> DataFrameWriter:
    """A writer with one folder per value; rows are dealt anew so that a big value is split and small ones share a file each."""
    return df.hint("rebalance", F.col(f"`{column}`")).write.mode("overwrite").partitionBy(column)


def write_prepared(df: DataFrame, path: str, obs: str | None = None) -> None:
    """Prepared frame as Parquet, one folder per period so that hold-out reads prune."""
    _by_folder(df, obs).parquet(path) if obs else df.write.mode("overwrite").parquet(path)


def read_prepared(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """Give the schema when period folders would otherwise be read as dates or numbers."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df.select(*[q(c) for c in columns]) if columns else df


def write_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    rows = [(i, f) for i, f in enumerate(features)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode("overwrite").json(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.schema("position int, feature string").json(path)
    return [r["feature"] for r in rows.orderBy("position").collect()]


def write_splits(df: DataFrame, path: str, dataset: str = "dataset") -> None:
    _by_folder(df, dataset).parquet(path)


def read_split(spark: SparkSession, path: str, name: str, dataset: str = "dataset") -> DataFrame:
    """One split: only its folder is read."""
    return spark.read.parquet(path).filter(q(dataset) == name)


def write_report(df: DataFrame, path: str) -> None:
    """A report table (metrics, importances) as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The listed columns that exist, as CSV with a header."""
    present = [c for c in columns if c in df.columns]
    df.select(*[q(c) for c in present]).write.mode("overwrite").option("header", True).csv(path)
