"""Lines that only fill in a template, found by a tree of fixed depth and dropped where they recur.

A line is cut into tokens; tokens with a digit are variable fields. The tree has one level for the number of tokens and one
for each of the first ``depth`` tokens; its leaves hold lines of one shape. In a leaf a token is constant at its position if
enough lines hold it there, any other token is a variable field; a line with its variable fields generalised is a template, so
a leaf may have several, whatever else it holds. Templates of enough documents and with enough constants recur, and their lines are
dropped.

Defined cases: a null text has no lines; blank lines are kept and belong to no template; lines shorter than the tree is deep
are their own leaf; repeated rows of equal key and text are one document; a line that occurs often in one document counts
once for it; an empty table gives an empty result; input columns that clash with added ones are replaced.
Hot leaves are counted by distinct (leaf, document) and (leaf, line) first, so no task holds a leaf; lines meet their
template by the hash of the line, broadcast where templates are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import materialize

VARIABLE = "<*>"
# Fixed patterns: what ends a token, and a token with a digit.
TOKEN = r"[^ \t\r]+"
WITH_DIGIT = r"[^ \t\r]*[0-9][^ \t\r]*"
#: Rows of hashes that may be broadcast, at some 50 bytes each.
MOST_ROWS = 100_000


def lines_of(text: Column) -> Column:
    """The lines of a text, in order; none for a null text."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def tokens_of(line: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(line, WITH_DIGIT, VARIABLE), F.lit(TOKEN), 0)


def leaf_of(line: Column, depth: int) -> Column:
    """Number of tokens and leading tokens of a line as one text; no more of the line is taken apart."""
    head = F.regexp_extract(line, rf"^[ \t\r]*(?:{TOKEN}[ \t\r]*){{1,{depth}}}", 0)
    return F.concat_ws(" ", F.regexp_count(line, F.lit(TOKEN)), F.array_join(tokens_of(head), " "))


def _lines(docs: DataFrame, depth: int, key: str, text: str) -> DataFrame:
    """One row per line that is not blank: ``key``, ``text_hash``, ``i`` (from 0), ``line``, ``leaf``."""
    exploded = docs.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.posexplode(lines_of(F.col(text))).alias("i", "line")
    )
    return exploded.filter(F.col("line").rlike(TOKEN)).withColumn("leaf", leaf_of(F.col("line"), depth))


def _small(stored: DataFrame) -> DataFrame:
    """A stored table, to be broadcast where it is small."""
    return F.broadcast(stored) if stored.count() <= MOST_ROWS else stored


def crowded_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """``key``, ``text_hash``, ``i``, ``leaf``, ``tokens`` and their hash ``shape`` of lines whose leaf is met in enough
    documents; stored."""
    lines = lines.withColumn("leaf_hash", F.xxhash64("leaf"))
    crowded = (
        lines.groupBy("leaf_hash", "key", "text_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy("leaf_hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_documents)
        .select("leaf_hash")
    )
    inside = lines.join(_small(materialize(crowded, "leaves")), "leaf_hash", "left_semi")
    tokens = inside.select("key", "text_hash", "i", F.col("leaf_hash").alias("leaf"), tokens_of(F.col("line")).alias("tokens"))
    return materialize(tokens.withColumn("shape", F.xxhash64("leaf", "tokens")), "crowded-lines")


def templates(lines: DataFrame, least_lines: int, least_constant: float) -> DataFrame:
    """``shape`` of each distinct line whose template has enough constants, with its ``template`` (a hash) and ``text``; stored."""
    shapes = materialize(lines.groupBy("shape").agg(F.any_value("leaf").alias("leaf"), F.any_value("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "shapes")
    cells = shapes.select("shape", "leaf", "n", F.posexplode("tokens").alias("p", "token")).filter(F.col("token") != VARIABLE)
    votes = cells.groupBy("leaf", "p", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_lines)
    constant = materialize(votes.select(F.xxhash64("leaf", "p", "token").alias("cell")), "constants")
    held = cells.select("shape", "p", F.xxhash64("leaf", "p", "token").alias("cell")).join(_small(constant), "cell", "left_semi")
    places = held.groupBy("shape").agg(F.collect_set("p").alias("places"))
    built = shapes.join(places, "shape").filter(F.size("places") >= least_constant * F.size("tokens"))
    kept = F.map_from_arrays("places", F.array_repeat(F.lit(True), F.size("places")))
    text = F.transform("tokens", lambda t, p: F.when(F.map_contains_key(kept, p), t).otherwise(VARIABLE))
    built = built.select("shape", "leaf", text.alias("text"))
    return materialize(built.select("shape", F.xxhash64("leaf", "text").alias("template"), "text"), "templates")


def drop_template_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    depth: int = 3,
    least_documents: int = 10,
    least_constant: float = 0.5,
) -> DataFrame:
    """The rows with ``n_lines``, ``n_dropped`` and ``clean_text``, the text without the lines of recurring templates."""
    lines = crowded_lines(_lines(docs, depth, key, text), least_documents)
    found = templates(lines, least_documents, least_constant).select("shape", "template")
    fitting = materialize(lines.select("key", "text_hash", "i", "shape").join(_small(found), "shape").drop("shape"), "template-lines")
    recurring = (
        fitting.select("template", "key", "text_hash")
        .distinct()
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least_documents)
    )
    dropped = (
        fitting.join(_small(materialize(recurring.select("template"), "recurring")), "template", "left_semi")
        .groupBy("key", "text_hash")
        .agg(F.collect_set("i").alias("__dropped"))
        .withColumnsRenamed({"key": "__key", "text_hash": "__hash"})
    )
    # a text crosses the join as its lines, which are then taken by their places; so very many lines cost their number
    split = docs.withColumns({"__text_hash": F.xxhash64(F.col(text)), "__lines": F.when(F.col(text).isNotNull(), lines_of(F.col(text)))})
    same = (F.col("__text_hash") == F.col("__hash")) & F.col(key).eqNullSafe(F.col("__key"))
    joined = split.drop(text).join(dropped, same, "left")
    gone = F.coalesce("__dropped", F.array().cast("array<int>"))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone), lambda i: F.get("__lines", i))
    whole = F.array_join("__lines", "\n")
    told = {
        text: whole,
        "n_lines": n.cast("long"),
        "n_dropped": F.size(gone).cast("long"),
        "clean_text": F.coalesce(F.when(F.size(gone) == 0, whole).otherwise(F.array_join(kept, "\n")), F.lit("")),
    }
    names = [*docs.columns, *(c for c in told if c not in docs.columns)]
    return joined.select(*[told[c].alias(c) if c in told else F.col(c) for c in names])
