"""Secrets in texts, judged by who owns them across the corpus.

Three fixed patterns give the base spans of a text; a broader pattern adds candidates that look random. Every
candidate value is hashed in the scan and nothing but the hash leaves it. Across the corpus a value is counted by
distinct repositories and distinct owners: what many owners share, or a great many repositories, is an example that
was copied; what few hold and looks random is live.

Defined cases: a null text counts as empty and has no spans; a null owner or repository is an owner of its own; repeated
rows are reported row by row and count once as repository; an empty table gives an empty result; input
columns beyond the key, owner, repository and text are not read. Hot values are counted by distinct
(value, owner, repository) first, so no task sees all rows of one value.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import materialize

# The kinds and patterns of the base spans.
KINDS = ("assign", "access", "hex", "bare")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

#: Candidates that the method adds: unbroken strings of this alphabet with digits and both cases.
BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
BARE_MIXED = re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", re.DOTALL)

SPANS = "array<struct<start:int,kind:int,end:int,value:string,random:boolean>>"


def bits_per_letter(value: str) -> float:
    """Entropy of the letters of a value."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str, least_length: int, least_bits: float) -> bool:
    return len(value) >= least_length and bits_per_letter(value) >= least_bits


def find_spans(text: str, least_length: int = 16, least_bits: float = 3.0) -> list[dict]:
    """Base spans and added candidates of one text by start and kind; offsets are code points, end exclusive."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    taken = [(s, e) for s, _, e, _ in found]
    for m in BARE.finditer(text):
        if BARE_MIXED.match(m[0]) and not any(s < m.end() and m.start() < e for s, e in taken):
            found.append((m.start(), 3, m.end(), m[0]))
    return [
        {"start": s, "kind": k, "end": e, "value": v, "random": looks_random(v, least_length, least_bits)}
        for s, k, e, v in sorted(found)
    ]


def _spans(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def scan_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([find_spans(t) if t else [] for t in texts], dtype=object)

    return scan_texts(F.coalesce(text, F.lit("")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in its order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, key: str, owner: str, repository: str, text: str) -> DataFrame:
    """One row per input row: ``tag`` (its number), key, owner, repository and ``found`` with hashed values; stored."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("tag"),
        F.col(key).alias("key"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"),
        _spans(F.col(text)).alias("found"),
    )
    hidden = F.transform(
        "found",
        lambda s: F.struct(
            s["start"].alias("start"),
            s["kind"].alias("kind"),
            s["end"].alias("end"),
            F.unhex(F.sha2(s["value"], 256)).alias("hash"),
            s["random"].alias("random"),
        ),
    )
    return materialize(rows.withColumn("found", hidden), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """Distinct owners and repositories of every candidate value: ``hash``, ``n_owners``, ``n_repositories``."""
    places = scanned.filter(F.size("found") > 0).select("owner", "repository", F.explode("found.hash").alias("hash"))
    by_owner = (
        places.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    )
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    owner: str = "source",
    repository: str = "doc_id",
    text: str = "text",
    copied_owners: int = 3,
    copied_repositories: int = 20,
) -> DataFrame:
    """One row per document with its spans and verdicts.

    ``found``: base spans and those candidates that ownership confirms, each with owners, repositories and
    verdict: ``example`` (held by ``copied_owners`` owners or more, or by ``copied_repositories`` repositories of fewer owners),
    ``live`` (held by fewer, and random), ``weak`` (by fewer, not random). A ``bare`` candidate is a span only where it is live.
    """
    scanned = scan(docs, key, owner, repository, text)
    verdict = (
        F.when((F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories), "example").when(F.col("s.random"), "live").otherwise("weak")
    )
    judged = (
        scanned.filter(F.size("found") > 0)
        .select("tag", "key", F.explode("found").alias("s"))
        .withColumn("hash", F.col("s.hash"))
        .join(ownership(scanned), "hash")
        .withColumn("verdict", verdict)
        .filter((F.col("s.kind") != KINDS.index("bare")) | (F.col("verdict") == "live"))
        .groupBy("tag", "key")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("s.start", "s.kind", "s.end", "verdict", "n_owners", "n_repositories", "hash"))
            ).alias("found")
        )
    )
    # documents all of whose candidates were turned down come back with none
    shape = judged.schema["found"].dataType
    rest = scanned.filter(F.size("found") == 0).select("tag", "key", F.array().cast(shape).alias("found"))
    lost = (
        scanned.filter((F.size("found") > 0) & F.forall("found.kind", lambda k: k == KINDS.index("bare")))
        .join(judged.select("tag"), "tag", "left_anti")
        .select("tag", "key", F.array().cast(shape).alias("found"))
    )
    return judged.unionByName(rest).unionByName(lost).drop("tag")


def secret_report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns per document: counts of base spans, their hash, all spans, and spans by verdict."""
    base = F.filter("found", lambda s: s["kind"] < KINDS.index("bare"))

    def of_kind(number: int):
        return lambda s: s["kind"] == number

    def count(condition) -> Column:
        return F.size(F.filter("found", condition)).cast("long")

    return found.select(
        F.col("key").alias(key),
        *[count(of_kind(i)).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"),
    )
