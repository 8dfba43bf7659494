"""Tables in: CSV and Parquet, side tables, the data dictionary."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoreloom.functions.exprs import nan_to_null

log = logging.getLogger(__name__)

Hook = Callable[[DataFrame], DataFrame]


def csv_scan(
    spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ","
) -> DataFrame:
    """CSV with a header row. A given schema spares the pass that infers one."""
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def csv_separator(spark: SparkSession, path: str) -> str:
    """``,`` unless the header has none and splits on ``;``. Reads one line."""
    head = spark.read.text(path).limit(1).collect()
    header = head[0][0] if head else ""
    for sep in (",", ";"):
        if sep in header:
            return sep
    raise ValueError(f"{path} has a single column under either separator")


def csv_auto(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return csv_scan(spark, path, schema, csv_separator(spark, path))


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A path with ``.csv`` in it is CSV, anything else Parquet; NaN is read as missing."""
    df = csv_auto(spark, path, schema) if ".csv" in path else parquet_scan(spark, path)
    return nan_to_null(df)


def side_tables(
    spark: SparkSession,
    paths: Mapping[str, str],
    hook: Hook | None = None,
    schemas: Mapping[str, StructType] | None = None,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """Side tables by name, each passed through the hook.

    A hook written for the main table may not fit a side table: the table is then left as it is and the error logged, or
    raised with ``strict``. ``schemas`` by name spare CSV files the pass that infers one.
    """
    tables = {}
    for name, path in paths.items():
        df = load_table(spark, path, (schemas or {}).get(name))
        if hook is not None:
            try:
                df = df.transform(hook)
            except Exception as error:
                if strict:
                    raise
                log.warning("hook not applied to side table %s: %s", name, error)
        tables[name] = df
    return tables


def dictionary_scan(spark: SparkSession, path: str) -> DataFrame:
    """``Variable;Description`` with padding removed."""
    schema = "Variable string, Description string"
    rows = spark.read.option("header", True).option("sep", ";").schema(schema).csv(path)
    return rows.select(F.trim("Variable").alias("Variable"), F.trim("Description").alias("Description"))
