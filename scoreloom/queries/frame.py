"""The modelling frame that most queries share: order lines with order, part and customer.

``y`` is a noisy 0/1 target, ``sc`` the integer behind it, ``score`` the same inside (0, 1),
``obs`` the order month, ``bucket`` a hash of the row key for splits and ``rowid`` one for ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.filters import holdout_label, train_test_label

PERIODS = ("2001-05", "2001-06", "2001-07")
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
NUMERIC_FEATURES = ("qty", "disc100", "p_size", "l_tax", "l_extendedprice", "p_retailprice", "o_totalprice")

SQL_FRAME = """frame AS (
  SELECT *,
    2*qty + 4*disc100 + 2*p_size AS sc,
    (2*qty + 4*disc100 + 2*p_size) / CAST(241 AS DOUBLE) AS score,
    CAST(2*qty + 4*disc100 + 2*p_size
         + ((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 100) > 210 AS INTEGER) AS y,
    (l_orderkey*31 + l_linenumber*7 + l_partkey*13 + l_suppkey*17) % 100 AS bucket,
    CASE WHEN obs = '2001-05' THEN 't1' WHEN obs = '2001-06' THEN 't2' WHEN obs = '2001-07' THEN 't3'
         WHEN (l_orderkey*31 + l_linenumber*7 + l_partkey*13 + l_suppkey*17) % 100 < 67 THEN 'train'
         ELSE 'test' END AS dataset
  FROM (
    SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
      p.p_brand, p.p_type, p.p_size, p.p_retailprice,
      strftime(o.o_orderdate, '%Y-%m') AS obs,
      CAST(l.l_quantity AS INTEGER) AS qty,
      CAST(round(l.l_discount*100) AS INTEGER) AS disc100
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN part p ON l.l_partkey = p.p_partkey
  )
)"""


def with_frame(sql: str) -> str:
    """SQL that may use ``frame``; further common tables can follow, starting with a comma."""
    return f"WITH {SQL_FRAME}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def frame(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders, parts = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(
        orders.select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
        ),
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).join(
        parts.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    base = joined.drop("o_orderkey", "p_partkey").select(
        "*",
        F.date_format("o_orderdate", "yyyy-MM").alias("obs"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc100"),
    )
    sc = 2 * F.col("qty") + 4 * F.col("disc100") + 2 * F.col("p_size")
    noise = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 100
    bucket = (
        F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7 + F.col("l_partkey") * 13 + F.col("l_suppkey") * 17
    ) % 100
    return base.select(
        "*",
        sc.alias("sc"),
        (sc / F.lit(241.0)).alias("score"),
        (sc + noise > 210).cast("int").alias("y"),
        bucket.alias("bucket"),
        holdout_label("obs", PERIODS, train_test_label(bucket)).alias("dataset"),
    )


def r6(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named columns to six decimals, as the SQL does on its side."""
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
