"""Exact duplicates with heavy hitters split off.

Digests that very many rows share are found by mergeable Misra-Gries summaries, verified by exact counts, and their
winners are broadcast: rows of such groups are judged where they are read. All other groups go through
an ordinary shuffle by digest; the summary guarantees that none of them exceeds
7 / capacity of all rows.

Defined cases: a null text counts as empty; of equal texts the row with the largest key stays, a null key
being smallest; of rows equal in both exactly one stays; other columns are not compared; columns of the
input that clash with added ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import materialize

#: Counters of a summary. A digest that holds more than 7 / CAPACITY of all rows is surely found.
CAPACITY = 4096
#: Summaries are merged in so many groups first, so no task merges those of all input tasks.
MERGE_GROUPS = 64


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def frequent(digests: DataFrame, capacity: int = CAPACITY, least: int = 16) -> DataFrame:
    """Candidates ``short`` (a number for ``digest``): at most ``capacity`` rows, every digest of more than
    7 / capacity of all rows among them."""
    short = digests.select(F.xxhash64("digest").alias("short"), F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g"))
    merged = (
        short.groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(short, {capacity})").alias("s"))
        .groupBy(F.lit("all"))  # with a key, tasks without rows send no summary, which could not be merged
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {capacity}), {capacity})").alias("top"))
    )
    return merged.select(F.explode("top").alias("t")).select(F.col("t.item").alias("short"), F.col("t.count").alias("n")).filter(
        (F.col("n") >= least) & F.col("short").isNotNull()
    )


def winners(digests: DataFrame, capacity: int = CAPACITY, least: int = 16) -> DataFrame:
    """Verified frequent digests: ``digest``, ``group_size``, ``best`` (key and tag of the row that stays); at most a few
    thousand rows, so they may be broadcast."""
    candidates = frequent(digests, capacity, least).select("short")
    return (
        digests.withColumn("short", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "short", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("key", "tag")).alias("best"))
        .filter(F.col("group_size") >= least)
    )


def mark_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, least: int = 16
) -> DataFrame:
    """One row per input row: key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Only the key, a row number and 32 bytes of digest are stored and shuffled. Groups of fewer than
    ``least`` rows are never split off.
    """
    digests = materialize(
        docs.select(
            F.col(key).alias("key"), F.monotonically_increasing_id().alias("tag"), digest(F.col(text)).alias("digest")
        ),
        "digests",
    )
    # read twice below: stored so that the summary is not merged again
    heavy = materialize(winners(digests, capacity, least), "heavy-digests")
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    in_group = Window.partitionBy("digest")
    rest = (
        digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(in_group))
        .withColumn("best", F.max(F.struct("key", "tag")).over(in_group))
    )
    judged = marked.filter(F.col("group_size").isNotNull()).unionByName(rest)
    return judged.select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, least: int = 16
) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows of heavy groups that lose are removed where they are read; what remains, one row for each heavy
    group, is shuffled once by digest.
    """
    columns = docs.columns
    named = docs.withColumn("__digest", digest(F.col(text)))
    narrow = named.select(F.col(key).alias("key"), F.lit(0).alias("tag"), F.col("__digest").alias("digest"))
    heavy = materialize(winners(narrow, capacity, least), "heavy-digests").select(
        F.col("digest").alias("__digest"), F.col("best.key").alias("__best"), F.lit(True).alias("__heavy")
    )
    in_group = Window.partitionBy("__digest").orderBy(F.col(key).desc_nulls_last())
    return (
        named.join(F.broadcast(heavy), "__digest", "left")
        .filter(F.col("__heavy").isNull() | F.col(key).eqNullSafe(F.col("__best")))
        .withColumn("__place", F.row_number().over(in_group))
        .filter(F.col("__place") == 1)
        .select(*[F.col(f"`{c}`") for c in columns])
    )
