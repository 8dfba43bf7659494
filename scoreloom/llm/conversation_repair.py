"""Repairs the turn structure of conversations with the cheapest edits, proved by branch and bound.

A well-formed conversation is empty or has, after at most one system turn, user and assistant turns in alternation that begin
with the user and end with the assistant. Edits keep a row, give it the role that is due, delete it, or insert an empty
turn. Among the cheapest edits those whose initials sort first are taken.

Rows are put in order by range partitioning and numbered by their place, so a conversation may reach over tasks. Blocks of
at most 64 rows are searched from every state that they can be entered in to every state that they can be left in;
blocks of a conversation are then joined in a tree. Costs and edits of a block don't depend on other blocks, and of two
edit strings of one block and equal cost neither is the beginning of the other, so the best of a conversation is made of the
bests of its blocks.

The search goes depth first with a stack of its own. What remains is bounded below by the cheapest edits to any state; a
first greedy dive gives an incumbent (cost, edits); a table for each row and state holds the least cost with which a prefix
has come there, and a later prefix that costs as much has edits that sort later. When the stack is empty the incumbent
is proved.

Defined cases: a null in any column is read as one space, but null turns sort first and don't count for gaps; rows of equal
turn are ordered by role and text; repeated rows are rows of their own; a null conversation id is an id like others;
columns beyond the four are ignored; an empty table gives an empty result with the same columns; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import StructField, StructType

from scoreloom.session import materialize

#: A block holds the rows of a conversation among 2 ** 6 consecutive ones of a task.
BLOCK_BITS = 6
#: Blocks that are joined at a time.
JOINED_AT_ONCE = 64
#: Rows that a task passes on at a time.
BATCH = 4096
#: Block contents whose tables a worker remembers.
REMEMBERED = 1 << 14

#: States after some turns: none yet, a system turn only, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: States in which a conversation may end.
COMPLETE = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1

SPACES = " \t\n\x0b\x0c\r"

#: A row for the search is two letters: the initial of its role and its fault (blank, duplicate, truncated or none).
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"


def _due(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is, or None where it can't."""
    if initial == "s":
        return SYSTEM if state == START else None
    wanted = {"u": USER, "a": ASSISTANT}.get(initial)
    return wanted if wanted == _due(state) else None


def _edits(state: int, row: str | None) -> list[tuple[str, int, int, int]]:
    """Edits in the order of their initials: (initial, cost, next state, rows consumed)."""
    out = []
    if row is not None:
        out.append((DELETE, DELETE_COST, state, 1))
    out.append((INSERT, INSERT_COST, _due(state), 0))
    if row is not None and row[1] not in (BLANK, DUPLICATE):
        extra = TRUNCATED_COST if row[1] == TRUNCATED else 0
        after = _kept(state, row[0])
        if after is not None:
            out.append((KEEP, extra, after, 1))
        out.append((REROLE, REROLE_COST + extra, _due(state), 1))
    return out


def suffix_bounds(rows: list[str]) -> list[list[int]]:
    """For each row and state the cost that the rows from there on take at least, whatever state they end in."""
    bounds = [[0] * 4]
    for row in reversed(rows):
        ahead = bounds[-1]
        plain = [min(c + ahead[s] for e, c, s, n in _edits(state, row) if n) for state in range(4)]
        # one insertion ahead of a row; a second one only undoes the first
        bounds.append([min(plain[state], INSERT_COST + plain[_due(state)]) for state in range(4)])
    return bounds[::-1]


def cheapest(rows: list[str], bounds: list[list[int]], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, edits) that lead through the rows from a state to one of the given states; None if there are none."""
    n = len(rows)

    def dive() -> tuple[int, str] | None:
        at, state, cost, edits = 0, entry, 0, ""
        while at < n:
            edit, c, state, _ = min(
                ((e, c, s, k) for e, c, s, k in _edits(state, rows[at]) if k), key=lambda x: (x[1] + bounds[at + 1][x[2]], x[0])
            )
            at, cost, edits = at + 1, cost + c, edits + edit
        for _ in range(2):
            if state in exits:
                return cost, edits
            state, cost, edits = _due(state), cost + INSERT_COST, edits + INSERT
        return (cost, edits) if state in exits else None

    best = dive()
    reached: dict[tuple[int, int], int] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, edits = stack.pop()
        if best is not None:
            least = cost + bounds[at][state]
            if least > best[0] or (least == best[0] and edits > best[1][: len(edits)]):
                continue
        if cost >= reached.get((at, state), cost + 1):
            continue
        reached[at, state] = cost
        if at == n and state in exits and (best is None or (cost, edits) < best):
            best = cost, edits
        row = rows[at] if at < n else None
        for edit, c, after, k in reversed(_edits(state, row)):
            stack.append((at + k, after, cost + c, edits + edit))
    return best


def _split(code: str) -> list[str]:
    return [code[i : i + 2] for i in range(0, len(code), 2)]


@lru_cache(REMEMBERED)
def whole_repair(code: str) -> tuple[int, str]:
    """The best (cost, edits) of a conversation that is one block."""
    rows = _split(code)
    return cheapest(rows, suffix_bounds(rows), START, COMPLETE)


@lru_cache(REMEMBERED)
def block_table(code: str) -> list[tuple[int, int, int, str]]:
    """The best (entry, exit, cost, edits) of a block for each pair of states between which there are edits."""
    rows = _split(code)
    bounds = suffix_bounds(rows)
    found = ((i, o, cheapest(rows, bounds, i, (o,))) for i in range(4) for o in range(4))
    return [(i, o, *best) for i, o, best in found if best is not None]


def joined_tables(tables: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The table of neighbouring blocks, given in order."""
    total = tables[0]
    for table in tables[1:]:
        best: dict[tuple[int, int], tuple[int, str]] = {}
        for i, middle, cost, edits in total:
            for j, o, more, further in table:
                if j == middle:
                    found = cost + more, edits + further
                    if (i, o) not in best or found < best[i, o]:
                        best[i, o] = found
        total = [(i, o, *b) for (i, o), b in sorted(best.items())]
    return total


def repaired_turns(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that the edits make of the rows."""
    state = START
    for edit in audit:
        if edit == INSERT:
            state = _due(state)
            yield "user" if state == USER else "assistant", ""
            continue
        role, text = next(rows)
        if edit == KEEP:
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            yield role, text
        elif edit == REROLE:
            state = _due(state)
            yield "user" if state == USER else "assistant", text


def _stripped_of_spaces(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with one in five damaged by a hash of conversation and turn: dropped, emptied, robbed of stops, repeated, or given
    to the user."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", read("role").alias("role"), read("text").alias("text"), lot.alias("lot"))
    changed = rows.filter("lot <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("lot") == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``place``, which grows by turn (nulls first), role and text inside a conversation.

    Ranges are cut by the beginnings of texts, so that the samples that the driver sees stay small.
    """
    by = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*by, F.substring("text", 1, 64)).sortWithinPartitions(*by, "text")
    return materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "ordered-turns")


def with_faults(ordered: DataFrame) -> DataFrame:
    """Narrow rows with ``fault``: the first of blank, duplicate and truncated that holds."""
    bare = _stripped_of_spaces(F.col("text"))
    narrow = ordered.select(
        "conv_id",
        "turn",
        "place",
        F.substring("role", 1, 1).alias("initial"),
        F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256).alias("content"),
        (bare == "").alias("is_blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"),
    )
    firsts = narrow.groupBy("conv_id", "content").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("is_blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(F.col("is_cut"), TRUNCATED).otherwise(SOUND)
    # places are unique, so no key of this join is frequent
    return narrow.join(firsts, "place", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault"))


def _counts(faults: DataFrame) -> DataFrame:
    """Gaps and faults of each conversation; turns are counted apart first, so that a long conversation is spread."""
    is_ = lambda f: F.sum((F.col("fault") == f).cast("long"))
    turns = faults.groupBy("conv_id", "turn").agg(is_(BLANK).alias("blank"), is_(DUPLICATE).alias("duplicate"), is_(TRUNCATED).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return turns.groupBy("conv_id").agg(
        gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )


_TABLE = "array<struct<entry:int,exit:int,cost:long,edits:string>>"


def _whole_repairs(code: str) -> Column:
    @F.pandas_udf("cost long, edits string")
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([whole_repair(c) for c in codes], columns=["cost", "edits"])

    return run(code)


def _block_tables(code: str) -> Column:
    @F.pandas_udf(_TABLE)
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([block_table(c) for c in codes], dtype=object)

    return run(code)


def _join_tables(parts: str) -> Column:
    def unpack(table: list) -> list[tuple[int, int, int, str]]:
        return [(e["entry"], e["exit"], e["cost"], e["edits"]) for e in table]

    @F.pandas_udf(_TABLE)
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([joined_tables([unpack(t["best"]) for t in some]) for some in lists], dtype=object)

    return run(parts)


def _illegal(left: Column, right: Column) -> Column:
    return (~F.concat(left, right).isin("su", "ua", "au")).cast("long")


def _added(numbers: Column | str) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def _between(lasts: str, firsts: str) -> Column:
    """How many neighbours don't go together, given the last and the first initial of each part."""
    n = F.size(firsts)
    return _added(F.zip_with(F.slice(lasts, 1, n - 1), F.slice(firsts, 2, n), _illegal))


def _several(parts: DataFrame) -> DataFrame:
    return parts.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id").alias("s")


def _apart(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations that are one part, and those of several."""
    same = F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))
    return parts.alias("p").join(_several(parts), same, "left_anti"), parts.alias("p").join(_several(parts), same, "left_semi")


def _joined(parts: DataFrame) -> DataFrame:
    """Neighbouring parts of each conversation joined, some at a time."""
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("block"))
    numbered = parts.select("conv_id", "block").withColumn("branch", F.floor((number - 1) / JOINED_AT_ONCE)).alias("n")
    same = F.col("l.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("l.block") == F.col("n.block"))
    grouped = (
        parts.alias("l")
        .join(numbered, same)
        .select("l.*", "branch")
        .groupBy("conv_id", "branch")
        .agg(F.sort_array(F.collect_list(F.struct("block", "first", "last", "illegal", "best"))).alias("parts"))
    )
    return grouped.select(
        "conv_id",
        F.col("branch").alias("block"),
        F.element_at("parts.first", 1).alias("first"),
        F.element_at("parts.last", -1).alias("last"),
        (_added("parts.illegal") + _between("parts.last", "parts.first")).alias("illegal"),
        _join_tables("parts").alias("best"),
    )


def searched(faults: DataFrame) -> DataFrame:
    """One row per conversation with its cheapest edits: ``illegal``, ``cost``, ``audit``."""
    # a role may begin with anything: what is none of the three initials has no letter of its own
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    row = F.struct("place", "initial", F.concat(letter, "fault").alias("code"))
    blocks = (
        faults.groupBy("conv_id", F.shiftright("place", BLOCK_BITS).alias("block"))
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
        .withColumn("initials", F.col("rows.initial"))
        .select(
            "conv_id",
            "block",
            F.element_at("initials", 1).alias("first"),
            F.element_at("initials", -1).alias("last"),
            _between("initials", "initials").alias("illegal"),
            F.concat_ws("", "rows.code").alias("code"),
        )
    )
    single, parts = _apart(materialize(blocks, "blocks"))
    best = single.select("conv_id", "illegal", _whole_repairs("code").alias("best"))
    parts = materialize(parts.withColumn("best", _block_tables("code")).drop("code"), "parts")
    while not parts.isEmpty():
        done, parts = _apart(materialize(_joined(parts), "parts"))
        ends = F.filter("best", lambda e: (e["entry"] == START) & e["exit"].isin(*COMPLETE))
        least = F.array_min(F.transform(ends, lambda e: F.struct(e["cost"].alias("cost"), e["edits"].alias("edits"))))
        best = best.unionByName(done.select("conv_id", "illegal", least.alias("best")))
    return best.select("conv_id", "illegal", F.col("best.cost").alias("cost"), F.col("best.edits").alias("audit"))


def _by_conversation(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of a conversation behind the row that holds its edits, sorted; tasks read them as a stream."""
    heads = edits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = heads.unionByName(ordered.select("conv_id", "place", "role", "text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, Iterator[tuple[str, str]]]]:
    """Conversations of a task, one after the other: id, edits, rows. The rows of one must be read before the next is asked for."""
    rows = ((c, p, r, t) for batch in batches for c, p, r, t in zip(*(x.to_pylist() for x in batch.columns)))
    ahead = next(rows, None)

    def own() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while ahead is not None and ahead[1] >= 0:
            out = ahead[2:]
            ahead = next(rows, None)
            yield out

    while ahead is not None:
        conversation, audit = ahead[0], ahead[3]
        ahead = next(rows, None)
        yield conversation, audit, own()


def _each(ordered: DataFrame, edits: DataFrame, made: Callable[..., Iterator[tuple]], **columns: pa.DataType) -> DataFrame:
    """The rows that a function makes of each conversation's (edits, rows), behind the conversation's id."""
    kept_type = ordered.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(kept_type), *columns.values()]
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], ["conv_id", *columns])

        for conversation, audit, rows in _stream(batches):
            for row in made(audit, rows):
                held.append((conversation, *row))
                if len(held) >= BATCH:
                    yield out()
                    held.clear()
            for _ in rows:
                pass  # deleted rows at the end
        if held:
            yield out()

    schema = StructType([StructField("conv_id", kept_type), *(StructField(c, from_arrow_type(t)) for c, t in columns.items())])
    return _by_conversation(ordered, edits).mapInArrow(run, schema)


def repaired_rows(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id``, ``turn`` from 0, ``role``, ``text``."""

    def made(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        return ((n, role, text) for n, (role, text) in enumerate(repaired_turns(rows, audit)))

    return _each(ordered, edits, made, turn=pa.int64(), role=pa.string(), text=pa.string())


def repair_digests(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """The SHA-256 of each repaired conversation's ``role:text`` lines, hashed as they stream by."""

    def made(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        hashed, mark = hashlib.sha256(), ""
        for role, text in repaired_turns(rows, audit):
            hashed.update(f"{mark}{role}:{text}".encode())
            mark = "\n"
        yield (hashed.hexdigest(),)

    return _each(ordered, edits, made, repaired_sha256=pa.string())


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in order, and per conversation with rows: gaps, faults, ``illegal``, ``cost`` and ``audit``."""
    ordered = in_order(rows)
    faults = materialize(with_faults(ordered), "faults")
    counts, edits = _counts(faults), searched(faults)
    same = F.col("c.conv_id").eqNullSafe(F.col("e.conv_id"))
    report = counts.alias("c").join(edits.alias("e"), same).select("c.*", "illegal", "cost", "audit")
    return ordered, materialize(report, "repairs")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, repair, and one row per original conversation, those that have lost all rows too."""
    ordered, report = repair(damaged(conversations))
    digests = repair_digests(ordered, report)
    ids = conversations.select("conv_id").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (
        ids.alias("i")
        .join(report.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
        .join(digests.alias("d"), F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
        .select(
            "i.conv_id",
            *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
        )
    )
