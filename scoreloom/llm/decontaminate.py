"""Benchmark passages in documents, by a broadcast set of hashed n-grams.

Benchmark and documents are cut into the same normalised words. Every window of ``n`` words of an item is
hashed; document windows are hashed as they are scanned and looked up in that set, which is broadcast if the benchmark has
at most ``most_windows`` distinct windows and shuffled against otherwise. A looked-up window is compared word by word
before it counts, so no result rests on a hash.

Defined cases: null texts have no words; an item with fewer words than ``n`` is one window of its own length, an
item without words none; equal items and windows that several items share count for each item; repeated
document rows are reported row by row; a document without hits has 0 hits and items and the hash of the empty
text; an empty table of documents gives an empty result, an empty benchmark no hits; null item ids are not items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import materialize

# The letters of words after lower-casing A-Z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct benchmark windows that may be broadcast, at about 300 bytes each.
MOST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    """Normalised words of a text, in order."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def window_at(array: Column, start: Column, length: int | Column) -> Column:
    """The words of a window as one text; ``start`` counts from 0."""
    return F.array_join(F.slice(array, start + 1, length), " ")


def window_hashes(array: Column, length: int) -> Column:
    """Hash of every window of so many words, in order; empty for shorter texts."""
    starts = F.when(F.size(array) >= length, F.sequence(F.lit(0), F.size(array) - length)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(F.slice(array, i + 1, length)))


def benchmark_windows(benchmark: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``length``, ``hash``, ``window`` (words joined by spaces), ``items`` (ids as texts); stored."""
    cut = (
        benchmark.filter(F.col(item).isNotNull())
        .select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w"))
        .filter(F.size("w") > 0)
        .withColumn("length", F.least(F.size("w"), F.lit(n)))
    )
    windows = cut.select(
        "item",
        "w",
        "length",
        F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("i"),
    ).select("item", "length", window_at(F.col("w"), F.col("i"), F.col("length")).alias("window"))
    grouped = windows.groupBy("length", "window").agg(F.collect_set("item").alias("items"))
    return materialize(
        grouped.select("length", F.xxhash64(F.split("window", " ")).alias("hash"), "window", "items"), "windows"
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """One row per document: key, ``text_hash``, ``n_words``, ``hit`` (positions of hit words, distinct) and ``items`` (ids as texts).

    Every document also sends one row past the join, so that the result needs no second look at the texts
    and no join: rows are grouped by document, and only hits are shuffled besides.
    """
    windows = benchmark_windows(benchmark, n, item, item_text)
    sizes = windows.groupBy("length").count().collect()  # one row per length, n at most
    bounded = sum(r["count"] for r in sizes) <= most_windows
    cut = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), words(F.col(text)).alias("w"))
    id_columns = ["key", "text_hash", F.size("w").alias("n_words")]
    found = []
    if not bounded or not sizes:
        found = [
            cut.select(
                *id_columns, F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("int").alias("i"), F.lit(0).alias("length")
            )
        ]
    for r in sizes:
        length = r["length"]
        looked_up = windows.filter(F.col("length") == length).select("hash", "window", "items")
        hashes = window_hashes(F.col("w"), length)
        own = window_at(F.col("w"), F.col("i"), length)
        if bounded:
            first = not found
            # one entry without hash in front stands for the document itself
            entries = F.array_insert(hashes, 1, F.lit(None).cast("long")) if first else hashes
            cells = cut.select("key", "text_hash", "w", F.posexplode(entries).alias("p", "hash"))
            hits = (
                cells.withColumn("i", F.col("p") - int(first))
                .join(F.broadcast(looked_up), "hash", "left" if first else "inner")
                .filter((F.col("i") < 0) | (F.col("window") == own))
            )
            at = F.when(F.col("i") >= 0, F.col("i"))
            found.append(hits.select(*id_columns, "items", at.alias("i"), F.lit(length).alias("length")))
        else:
            cells = cut.select("key", "text_hash", "w", F.posexplode(hashes).alias("i", "hash"))
            cells = cells.select(*id_columns, "i", "hash", own.alias("own"))
            hits = cells.join(looked_up, "hash").filter(F.col("window") == F.col("own"))
            found.append(hits.select("key", "text_hash", "n_words", "items", "i", F.lit(length).alias("length")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    own = F.col("items").isNull()
    grouped = rows.groupBy("key", "text_hash", "n_words").agg(
        F.count_if(own).alias("copies"),
        F.collect_set(F.when(~own, F.struct("i", "length"))).alias("at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    hit = F.array_distinct(
        F.flatten(F.transform("at", lambda a: F.sequence(a["i"], a["i"] + a["length"] - 1)))
    )
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return grouped.select("key", "text_hash", "n_words", hit.alias("hit"), "items", each.alias("copy")).drop("copy").withColumnRenamed("key", key)


def contamination(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of ``find_hits``: counts, hash of the sorted item ids, and whether anything was hit."""
    return found.select(
        key,
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    most_windows: int = MOST_WINDOWS,
    most_ids: int = 1_000_000,
) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    found = find_hits(docs, benchmark, n, key, text, item, item_text, most_windows).filter(F.size("hit") > 0)
    lost = materialize(found.select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "lost")
    few = lost.count() <= most_ids
    same = (F.xxhash64(F.col(text)) == F.col("__hash")) & F.col(key).eqNullSafe(F.col("__key"))
    return docs.join(F.broadcast(lost) if few else lost, same, "left_anti")
