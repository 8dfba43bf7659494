"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent and normalised; the exponent is bisected until the entropy of
the weights or the largest repetition of a source meets its target. Weights are realised as budgeted block
permutations: a source is read in whole passes, each in its own order of blocks and of documents inside a block, and a
last pass stops where the source's token budget is met.

The order of a source is that of a hash of the document key, so where the last pass stops is one value per source:
token totals of hash blocks find the block, a running sum inside that block alone finds the document. No window covers a
whole source.

Defined cases: a null source is a source of its own; a null text has 0 tokens; a source without tokens has weight
0 and is read once where sources are covered, and not at all under a fixed budget; rows with equal source and key are
taken or left together; input columns that clash with added ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.session import materialize

#: Hexadecimal digits of the hash that name a block: 4,096 blocks in a source.
BLOCK_DIGITS = 3
#: Levels of bisection that one job evaluates, and jobs: the exponent is found to 2 ** -(LEVELS * JOBS).
LEVELS, JOBS = 5, 8
#: Sources whose one-row plans may be broadcast, at some 200 bytes each.
MOST_SOURCES = 200_000
#: Copies of a plan beyond that, so that one source's rows spread over so many join keys.
SALTS = 64


@dataclass(frozen=True)
class Target:
    """``entropy``: share of the largest possible entropy to reach, or ``repetitions``: passes no source may exceed.

    ``budget``: tokens to read in all; by default as many as let the least repeated source be read once in full.
    """

    repetitions: float | None = None
    entropy: float | None = None
    budget: int | None = None
    seed: int = 0


def token_count(text: Column) -> Column:
    """Tokens of a text: its runs of other than blank, tab or line end."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def place(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))


def block_totals(docs: DataFrame, key: str, source: str, tokens: Column, seed: int) -> DataFrame:
    """Tokens by source and block of its order; at most 4,096 rows for a source; stored."""
    block = F.substring(place(F.col(key), seed), 1, BLOCK_DIGITS)
    rows = docs.select(F.col(source).alias("source"), block.alias("block"), tokens.alias("n"))
    totals = rows.groupBy("source", "block").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    return materialize(totals, "mix-blocks")


def _measures(shares: DataFrame, exponents: list[float]) -> list[dict[str, float]]:
    """Entropy, and largest and smallest weight by share, at each exponent; one row of numbers comes to the driver."""
    p = F.col("p")
    columns = [F.count(F.lit(1)).alias("k")]
    for i, a in enumerate(exponents):
        columns += [
            F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"),
            F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}"),
            F.max(F.pow(p, F.lit(a - 1))).alias(f"most{i}"),
            F.min(F.pow(p, F.lit(a - 1))).alias(f"least{i}"),
        ]
    r = shares.agg(*columns).first()
    return [
        {
            "k": r["k"],
            "z": r[f"z{i}"],
            "entropy": math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"],
            "most": r[f"most{i}"] / r[f"z{i}"],
            "least": r[f"least{i}"] / r[f"z{i}"],
        }
        for i, a in enumerate(exponents)
    ]


def find_exponent(shares: DataFrame, target: Target, total: int) -> float:
    """Exponent in 0 to 1, to six decimals.

    For a repetition limit the smallest (flattest) that keeps it, for an entropy the largest that reaches it. Where 0 or
    1 already decide, these.
    """

    def flat_enough(m: dict[str, float]) -> bool:
        # true below the exponent that is sought, false above it
        if target.entropy is not None:
            return m["entropy"] >= target.entropy * math.log(m["k"])
        budget = target.budget / total if target.budget else 1 / m["least"]
        return m["most"] * budget > target.repetitions

    low, high = 0.0, 1.0
    at_low, at_high = _measures(shares, [low, high])
    if not flat_enough(at_low):
        return low
    if flat_enough(at_high):
        return high
    points = 2**LEVELS
    for _ in range(JOBS):
        grid = [low + (high - low) * i / points for i in range(1, points)]
        reached = sum(map(flat_enough, _measures(shares, grid)))  # monotone: the first so many
        edges = [low, *grid, high]
        low, high = edges[reached], edges[reached + 1]
    return round(high if target.entropy is None else low, 6)


def source_plan(blocks: DataFrame, target: Target) -> DataFrame:
    """One row per source: ``tokens``, ``weight``, whole ``passes`` and the tokens ``rest`` of the last pass; stored."""
    sources = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        passes = 0 if target.budget else 1
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(passes).cast("long").alias("passes"), F.lit(0).cast("long").alias("rest"))
    shares = materialize(sources.withColumn("p", F.col("tokens") / F.lit(float(total))), "mix-sources")
    positive = shares.filter(F.col("p") > 0)
    exponent = find_exponent(positive, target, total)
    m = _measures(positive, [exponent])[0]
    budget = float(target.budget) if target.budget else total / m["least"]
    weight = F.when(F.col("p") > 0, F.pow(F.col("p"), F.lit(exponent)) / F.lit(m["z"])).otherwise(0.0)
    own = F.floor(F.col("weight") * F.lit(budget) + 0.5).cast("long")
    covered = F.lit(0 if target.budget else 1).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("own") / F.greatest(F.col("tokens"), F.lit(1))).cast("long"))
    return (
        shares.withColumn("weight", weight)
        .withColumn("own", own)
        .withColumn("passes", F.coalesce(passes, covered))
        .select("source", "tokens", "weight", "passes",
                F.when(F.col("tokens") > 0, F.col("own") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"))
    )


def with_cuts(
    docs: DataFrame, key: str, source: str, tokens: Column, blocks: DataFrame, plan: DataFrame, seed: int
) -> DataFrame:
    """The plan with ``last``: hash and key of the last document of the last pass, null where that pass is empty; stored."""
    in_order = Window.partitionBy("source").orderBy("block")
    before = F.coalesce(
        F.sum("tokens").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    reached = (
        blocks.withColumn("before", before)
        .join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("rest") > 0) & (F.col("before") < F.col("rest")))
    )
    # the last block that is entered is the only one whose documents must be added up
    edge = reached.groupBy("source").agg(F.max_by(F.struct("block", "before", "rest"), "block").alias("e")).select(
        F.col("source").alias("s"), "e.*"
    )
    rows = docs.select(
        F.col(source).alias("source"), F.col(key).cast("string").alias("key"), place(F.col(key), seed).alias("place"), tokens.alias("n")
    )
    inside = rows.join(
        edge,
        F.col("source").eqNullSafe(F.col("s")) & (F.substring("place", 1, BLOCK_DIGITS) == F.col("block")),
    )
    running = Window.partitionBy("s", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("sum", F.sum("n").over(running)).filter(F.col("before") + F.col("sum") <= F.col("rest"))
    cuts = fits.groupBy("s").agg(F.max("place").alias("inside"))
    # where not even the first document of that block fits, the pass ends with the block before
    ends = edge.join(cuts.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left").select(
        "s", F.coalesce(F.col("inside"), F.col("block")).alias("last")
    )
    return materialize(
        plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan"
    )


def mix(docs: DataFrame, target: Target, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per reading of a document: all columns, ``n_tokens``, ``source_weight``, ``epoch`` (from 1) and
    ``read_order``, by which an epoch of a source is read: its blocks in an order of the epoch's own, and so inside them."""
    tokens = token_count(F.col(text))
    blocks = block_totals(docs, key, source, tokens, target.seed)
    plan = source_plan(blocks, target)
    cuts = with_cuts(docs, key, source, tokens, blocks, plan, target.seed)
    n_sources = cuts.count()
    spot = place(F.col(key), target.seed)
    steps = cuts.select(
        F.col("source").alias("__source"), F.col("weight").alias("__weight"), F.col("passes").alias("__passes"), F.col("last").alias("__last")
    )
    added = ("n_tokens", "source_weight", "epoch", "read_order")
    rows = docs.drop(*added).withColumn("__place", spot)
    same = F.col(source).eqNullSafe(F.col("__source"))
    if n_sources <= MOST_SOURCES:
        joined = rows.join(F.broadcast(steps), same)
    else:
        salted = steps.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = F.pmod(F.xxhash64("__place"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("__own", own).join(salted, same & (F.col("__own") == F.col("__salt")))
    epochs = F.col("__passes") + F.when(F.col("__place") <= F.col("__last"), 1).otherwise(0)
    block = F.substring("__place", 1, BLOCK_DIGITS)
    in_epoch = F.concat_ws(
        ":", F.substring(F.md5(F.concat_ws(":", block, "epoch")), 1, 8), F.md5(F.concat_ws(":", "__place", "epoch"))
    )
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return (
        joined.filter(epochs > 0)
        .withColumn("n_tokens", tokens)
        .withColumn("source_weight", F.round("__weight", 9))
        .withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), epochs)))
        .withColumn("read_order", in_epoch)
        .select(*columns, *added)
    )
