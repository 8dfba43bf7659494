"""Pairs of sets that can reach a Jaccard similarity, all of them: a prefix join for crowds that banding cannot take apart.

Members of a set are put in one order, rare ones first. Two sets at the limit share one of the first members of both; how
many first members are enough depends on the size, and fewer are enough for the smaller set of a pair. So sets are joined on
their first members only, and a shared one counts if what is left behind it in both sets still suffices. The order comes from
counts in ``BUCKETS`` buckets; any order gives the same confirmed pairs, a good one gives few to confirm.

Pairs inside one component are not proposed. Of the sets with a member, those of the component that holds it most often are
never joined with one another, so a crowd that is already linked costs its size and not its square; sets of many components
that share a member are dealt out by salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shingles import KEPT_BYTES, unpacked
from scoreloom.session import materialize

BUCKETS = 1 << 18
#: Members that are counted or given out at a time.
STEP = 1 << 20
#: Sets of other components than the most frequent one, with one member, that one task joins.
SALTED = 1000


def _members(packed: bytes) -> np.ndarray:
    return (unpacked(packed) >> np.uint64(64 - 8 * KEPT_BYTES)).astype(np.int64)


def _bucket_counts(sets: DataFrame) -> np.ndarray:
    """How often members of each bucket occur."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for packed in batch["set"]:
                held.append(packed)
                size += len(packed) // KEPT_BYTES
                if size > STEP:
                    n += np.bincount(_members(b"".join(held)) % BUCKETS, minlength=BUCKETS)
                    held, size = [], 0
            n += np.bincount(_members(b"".join(held)) % BUCKETS, minlength=BUCKETS)
        used = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": used, "n": n[used]})

    rows = sets.select("set").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def _first_members(sets: DataFrame, percent: int) -> DataFrame:
    """One row per set and first member: ``id``, ``n``, ``member``, ``place``, and whether it is ``near`` enough to the start to
    count where the set is the smaller one."""
    often = _bucket_counts(sets)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for i, packed in zip(batch["id"], batch["set"], strict=True):
                members = np.unique(_members(packed))
                n = len(members)
                if not n:
                    continue
                larger = n - -(-percent * n // 100) + 1
                smaller = n - -(-2 * percent * n // (100 + percent)) + 1
                chosen = members[np.lexsort((members, often[members % BUCKETS]))[:larger]]
                place = np.arange(larger)
                held.append(pd.DataFrame({"id": i, "n": n, "member": chosen, "place": place, "near": place < smaller}))
                size += larger
                if size > STEP:
                    yield pd.concat(held)
                    held, size = [], 0
            if held:
                yield pd.concat(held)

    return sets.select("id", "set").mapInPandas(first, "id long, n long, member long, place long, near boolean")


def pairs_across(sets: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``u`` < ``v`` of ids that are not in one component of ``part`` (``id``, ``component``), among them every pair
    with 100 * shared >= percent * union. ``sets``: one row per id with its packed ``set``."""
    firsts = _first_members(sets, percent).join(part, "id", "left").withColumn("part", F.coalesce("component", "id"))
    firsts = materialize(firsts.drop("component"), "first-members")
    by_part = firsts.groupBy("member", "part").agg(F.count(F.lit(1)).alias("n"))
    met = by_part.groupBy("member").agg(
        F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("others")
    )
    met = met.filter("others > 0").withColumn("salts", F.ceil(F.col("others") / SALTED).cast("int"))
    rows = materialize(firsts.join(met, "member"), "shared-members")
    left = rows.filter("part != main").select(
        "member", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), *[F.col(c).alias(f"{c}_l") for c in ("id", "n", "place", "near", "part")]
    )
    right = rows.select(
        F.col("member").alias("member_r"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt_r"),
        (F.col("part") == F.col("main")).alias("in_main"),
        *[F.col(c).alias(f"{c}_r") for c in ("id", "n", "place", "near", "part")],
    )
    behind = F.least(F.col("n_l") - F.col("place_l"), F.col("n_r") - F.col("place_r"))
    left_is_smaller = F.struct("n_l", "id_l") < F.struct("n_r", "id_r")
    allowed = (
        (F.col("member") == F.col("member_r"))
        & (F.col("salt") == F.col("salt_r"))
        & (F.col("part_l") != F.col("part_r"))
        & (F.col("in_main") | (F.col("id_l") < F.col("id_r")))
        & (100 * F.least("n_l", "n_r") >= percent * F.greatest("n_l", "n_r"))
        & F.when(left_is_smaller, F.col("near_l")).otherwise(F.col("near_r"))
        & ((100 + percent) * behind >= percent * (F.col("n_l") + F.col("n_r")))
    )
    both = left.join(right, allowed)
    return both.select(F.least("id_l", "id_r").alias("u"), F.greatest("id_l", "id_r").alias("v")).distinct()
