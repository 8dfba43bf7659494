"""Connected components of link tables too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from scoreloom.session import materialize


def _at_home(edges: DataFrame) -> DataFrame:
    """Distinct edges with all of one ``u`` in one place, so that neither ``distinct`` nor a window over ``u`` moves them again."""
    return edges.repartition("u").groupBy("u", "v").agg(F.max("moved").alias("moved"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v", "moved"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "moved"))))
    near = _at_home(both).withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))).filter(F.col("v") > F.col("u"))
    return near.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("m") != F.col("u"))).alias("moved"))


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge runs from its larger end to its smaller one
    near = _at_home(edges).withColumn("m", F.min("v").over(Window.partitionBy("u")))
    own = F.struct("u", F.col("m").alias("v"), "moved")
    hung = F.struct(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
    # the edge to the smallest stays, each other one hangs its end below that
    return near.select(F.inline(F.array(F.when(F.col("v") == F.col("m"), own).otherwise(hung))))


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest reachable id) for every id in ``links`` (whole numbers ``u``, ``v``) but those that are
    the smallest of theirs.

    Rounds of large and small stars: each hangs every id below the smallest of its neighbours, so chains shrink by
    about half in a round and hubs cost no more than their links. A round is two shuffles; its links are stored with whether
    they moved, which is summed as they are written, so a lost executor costs that round at most. Self-links and repeated
    links do no harm.
    """
    edges = links.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(False).alias("moved")
    )
    while True:
        seen = Observation()
        starred = _small_star(_large_star(edges)).observe(seen, F.sum(F.col("moved").cast("long")).alias("moved"))
        stored = materialize(starred, "links")
        if not seen.get["moved"]:
            return stored.select(F.col("u").alias("id"), F.col("v").alias("component"))
        edges = stored.withColumn("moved", F.lit(False))
