"""Near-duplicate documents by a forest of sorted signature orders.

A document is its set of distinct word shingles; equal sets are one class from the start. A class has a MinHash signature that is
read as several orders (trees): in each, classes are sorted by the values that belong to the tree, and
neighbours with a long common prefix are candidates. How long is settled region by region: a region is all
classes that share the first values of a tree, at depth 4 first. In a region of at most ``CROWD`` classes the members
are compared with one another, but for those that links to the region's first member have
already brought together. A larger region is a crowd; there and in the crowds that more values leave of it,
classes are first linked to the pivot of the crowd (of the classes on the most trodden path below it the one that is on such
paths in most trees, which is the middle of a crowd of variants) and to their neighbours in the sorted order. Then all classes
that are in a crowd of any tree are joined on their rarest shingles (``prefix_join``), which proposes every pair at the limit that
the first links left apart.

Signatures only propose. A proposed pair whose signatures agree so little that a similarity at the limit is out of
the question (four deviations) is put aside; all others are confirmed on the full shingle sets. Links make
components. A link is missed only where no tree brings its classes into one region of depth 4, or by the four deviations: below
2 in 10,000 for a pair at the limit, in crowds or not.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; a null key belongs to its component without ever naming it, and names none of its own; rows of equal key and text
are one document; keys that occur with several texts are judged text by text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.components import components
from scoreloom.llm.prefix_join import pairs_across
from scoreloom.llm.shingles import Shingler, least_values, random_factors, shared_count
from scoreloom.session import materialize

TREES, DEPTH = 16, 8
#: Depths at which regions are looked at.
LEVELS = (4, 6, 8)
#: Classes that are compared with one another in a region.
CROWD = 64
#: Rows of ids and hashes that may be broadcast, at some 60 bytes each.
MOST_IDS = 100_000
_FACTORS, _SHIFTS = random_factors(TREES * DEPTH, 20240228)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a set, 16 bits each."""
    return (least_values(shingles, _FACTORS, _SHIFTS) >> np.uint64(48)).astype(">u2")


def _sketch(text: Column, width: int) -> Column:
    @F.pandas_udf("n int, digest binary, signature binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for texts in batches:
            rows = []
            for text in texts:
                s = shingler.of_text(text)
                if len(s):
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()))
                else:
                    rows.append((0, None, None))
            yield pd.DataFrame(rows, columns=["n", "digest", "signature"])

    return sketch(text)


def _full_sets(text: Column, width: int) -> Column:
    @F.pandas_udf("binary")
    def full(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(width)
        for texts in batches:
            yield pd.Series([shingler.packed(shingler.of_text(t)) for t in texts], dtype=object)

    return full(text)


def _agreement(a: Column, b: Column) -> Column:
    """How many values of two signatures agree."""

    @F.pandas_udf("int")
    def agree(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype="int32")
        x, y = (np.frombuffer(b"".join(s), dtype=">u2").reshape(len(s), -1) for s in (left, right))
        return pd.Series((x == y).sum(axis=1).astype("int32"))

    return agree(a, b)


def _labels(classes: DataFrame) -> DataFrame:
    """One row per class and tree: ``id``, ``tree``, its values ``path``, and the region at the first depth, ``p4``."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = classes.select("id", "signature", tree.alias("tree"))
    rows = rows.select("id", "tree", F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("path"))
    return rows.withColumn("p4", _region("tree", "path", LEVELS[0]))


def _region(tree: str, path: str, depth: int) -> Column:
    return F.xxhash64(tree, F.substring(path, 1, 2 * depth))


def _small(stored: DataFrame) -> DataFrame:
    """A stored table, to be broadcast where it is small."""
    return F.broadcast(stored) if stored.count() <= MOST_IDS else stored


def _in_order(rows: DataFrame) -> DataFrame:
    """Pairs of ids that are neighbours when each tree's classes are sorted by the values of the tree.

    Rows are dealt out by ranges; the last row of a range and the first of the next come together apart.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ends = None, []

        def out(pairs: list, edges: list) -> pa.RecordBatch:
            columns = zip(*pairs, *((None, None, *e) for e in edges))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))],
                ["u", "v", "tree", "path", "id"],
            )

        for batch in batches:
            pairs = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if before is None:
                    ends.append(row)
                elif before[0] == row[0]:
                    pairs.append((before[2], row[2], None, None, None))
                before = row
            if pairs:
                yield out(pairs, [])
        if before is not None:
            yield out([], [*ends, before])

    by = ["tree", "path", "id"]
    dealt = rows.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    found = materialize(dealt.mapInArrow(neighbours, "u long, v long, tree int, path binary, id long"), "neighbours")
    # two rows of each range
    order = Window.partitionBy("tree").orderBy("path", "id")
    edges = found.filter("u is null").select(F.lag("id").over(order).alias("u"), F.col("id").alias("v")).filter("u is not null")
    return found.filter("u is not null").select("u", "v").unionByName(edges)


def _stars(crowd: DataFrame) -> DataFrame:
    """Pairs of the ids of each crowd, at every depth, with the crowd's pivot.

    Crowds are found on the number of classes by path; a class comes up once for each crowd it is in.
    """
    paths = materialize(crowd.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("n")), "crowd-paths")
    levels = [paths.select("tree", "path", "n", F.lit(d).alias("depth"), _region("tree", "path", d).alias("region")) for d in LEVELS]
    by_region = reduce(DataFrame.unionByName, levels).groupBy("depth", "region")
    crowds = by_region.agg(F.sum("n").alias("size"), F.max_by(F.struct("tree", "path"), F.struct("n", "path")).alias("most"))
    crowds = materialize(crowds.filter(F.col("size") > CROWD).select("depth", "region", "most.*"), "crowds")
    on_path = crowd.select("tree", "path", "id").join(_small(crowds), ["tree", "path"]).select("depth", "region", "id")
    # the middle of a crowd keeps to the path in most trees, a variant leaves it in some
    trees = on_path.withColumn("trees", F.count_if(F.col("depth") == LEVELS[0]).over(Window.partitionBy("id")))
    pivots = materialize(trees.groupBy("depth", "region").agg(F.max_by("id", F.struct("trees", -F.col("id"))).alias("pivot")), "pivots")
    known = _small(pivots)
    stars = [
        crowd.select(_region("tree", "path", d).alias("region"), F.col("id").alias("v"))
        .join(known.filter(F.col("depth") == d), "region")
        .select(F.col("pivot").alias("u"), "v")
        for d in LEVELS
    ]
    return reduce(DataFrame.unionByName, stars)


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the forest proposes: distinct pairs ``u`` < ``v`` of class ids, at least one for every class that shares a region;
    ``region``, ``id`` of the regions in which all members are to be compared; and ``id`` of the classes in crowds. All are stored."""
    labels = _labels(classes)
    first = materialize(
        labels.groupBy("p4")
        .agg(F.count(F.lit(1)).alias("n4"), F.min("id").alias("u"), F.max("id").alias("v"))
        .filter("n4 > 1"),
        "regions",
    )
    shared = materialize(labels.join(first.filter("n4 > 2").select("p4", "n4", F.col("u").alias("low")), "p4"), "shared-regions")
    small, crowd = shared.filter(F.col("n4") <= CROWD), shared.filter(F.col("n4") > CROWD)
    pairs = [first.filter("n4 = 2").select("u", "v"), small.select(F.col("low").alias("u"), F.col("id").alias("v"))]
    ids = materialize(crowd.select("id").distinct(), "crowd-ids")
    if not ids.isEmpty():
        pairs += [_stars(crowd), _in_order(crowd)]
    found = reduce(DataFrame.unionByName, pairs).filter(F.col("u") != F.col("v"))
    found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return materialize(found, "candidates"), small.select(F.col("p4").alias("region"), "id"), ids


def _across(leaves: DataFrame, part: DataFrame) -> DataFrame:
    """Distinct pairs of ids that share a region and are not in one component already."""
    rows = leaves.join(part, "id", "left").select("region", "id", F.coalesce("component", "id").alias("part"))
    other = rows.select("region", F.col("id").alias("v"), F.col("part").alias("part_v"))
    both = rows.select("region", F.col("id").alias("u"), F.col("part").alias("part_u")).join(
        other, (rows["region"] == other["region"]) & (F.col("u") < F.col("v")) & (F.col("part_u") != F.col("part_v"))
    )
    return both.select("u", "v").distinct()


def _chosen(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """``id`` and text of the documents that stand for the classes in ``names``; broadcast where few enough."""
    ids = names.select(F.col("key").alias("__key"), F.col("text_hash").alias("__hash"), "id")
    few = names.count() <= MOST_IDS
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    same = (F.xxhash64("text") == F.col("__hash")) & F.col("key").eqNullSafe(F.col("__key"))
    return rows.join(F.broadcast(ids) if few else ids, same).select("id", "text")


def shingle_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """``id`` and packed ``set`` of the classes in ``ids``; stored."""
    chosen = _chosen(docs, classes.join(ids, "id").select("id", "key", "text_hash"), key, text)
    return materialize(chosen.dropDuplicates(["id"]).select("id", _full_sets(F.col("text"), width).alias("set")), "shingle-sets")


def confirmed(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, key: str, text: str
) -> DataFrame:
    """Pairs ``u``, ``v`` with 100 * shared >= percent * union on the full sets."""
    limit = percent / 100
    least = int(TREES * DEPTH * limit - 4 * (TREES * DEPTH * limit * (1 - limit)) ** 0.5)
    known = classes.select("id", "signature", "n")
    left = known.select(F.col("id").alias("u"), F.col("signature").alias("su"), F.col("n").alias("nu"))
    right = known.select(F.col("id").alias("v"), F.col("signature").alias("sv"), F.col("n").alias("nv"))
    sizes_allow = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    likely = materialize(
        pairs.join(left, "u")
        .join(right, "v")
        .filter(sizes_allow)
        .filter(_agreement(F.col("su"), F.col("sv")) >= least)
        .select("u", "v", "nu", "nv"),
        "likely-pairs",
    )
    named = likely.select(F.col("u").alias("id")).unionByName(likely.select(F.col("v").alias("id"))).distinct()
    sets = shingle_sets(docs, classes, named, width, key, text)
    both = likely.join(sets.select(F.col("id").alias("u"), F.col("set").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("set").alias("b")), "v"
    )
    counted = both.select("u", "v", (F.col("nu") + F.col("nv")).alias("sum"), shared_count(F.col("a"), F.col("b")).alias("shared"))
    return counted.filter(100 * F.col("shared") >= percent * (F.col("sum") - F.col("shared"))).select("u", "v")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, ``text_hash``, ``n_shingles``, ``component_id`` and ``kept``."""
    sketched = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), _sketch(F.col(text), width).alias("s")
    )
    rows = materialize(sketched.select("key", "text_hash", "s.*"), "sketches")
    classes = materialize(
        rows.filter(F.col("n") > 0)
        .groupBy("digest")
        .agg(
            F.min("key").alias("low"),
            F.min(F.struct("key", "text_hash")).alias("name"),
            F.first("signature").alias("signature"),
            F.first("n").alias("n"),
        )
        .select("digest", "low", "name.*", "signature", "n", F.monotonically_increasing_id().alias("id")),
        "classes",
    )
    first, leaves, crowd = candidates(classes)
    links = materialize(confirmed(docs, classes, first, width, percent, key, text), "links")
    # what the first links have brought together needs no more comparing; all other members of a region do
    part = components(links)
    rest = _across(leaves, part)
    if not crowd.isEmpty():
        rest = rest.unionByName(pairs_across(shingle_sets(docs, classes, crowd, width, key, text), part, percent)).distinct()
    rest = materialize(rest, "candidates")
    more = materialize(confirmed(docs, classes, rest, width, percent, key, text), "links")
    # what is known of components stands for its links; a component's smallest member is not listed as part of it
    part = components(part.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))
    grouped = classes.select("id", "digest", "low").join(part, "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    named = grouped.join(lows, "component").select("digest", "component_id")
    full = rows.select("key", "text_hash", F.col("n").cast("long").alias("n_shingles"), "digest")
    judged = full.join(named, "digest", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return judged.select(
        F.col("key").alias(key),
        "text_hash",
        "n_shingles",
        component_id.alias("component_id"),
        F.col("key").eqNullSafe(component_id).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    marked = near_duplicates(docs, width, percent, key, text)
    lost = materialize(marked.filter(~F.col("kept")).select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).distinct(), "lost")
    few = lost.count() <= MOST_IDS
    same = (F.xxhash64(F.col(text)) == F.col("__hash")) & F.col(key).eqNullSafe(F.col("__key"))
    return docs.join(F.broadcast(lost) if few else lost, same, "left_anti")
