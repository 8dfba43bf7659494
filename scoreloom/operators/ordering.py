"""Exact ranks, quantiles and running totals without sorting everything in one task.

A small percentile sketch cuts the order column into ranges of similar size. Ranges are counted
map-side, so only the ranges that matter (ranks) or one row per range (running totals) travel.
The sketch steers the work only; results do not depend on how good it is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q, right_closed_index
from scoreloom.session import materialize

FEWEST_RANGES = 8
ROWS_PER_RANGE = 5_000_000  # distinct values one task puts in order


def range_splits(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Inner split points, all finite, that cut the column into ranges of roughly equal row counts.

    Without a number of ranges it follows the row count, so that a range stays one task's work.
    """
    x = q(column).cast("double")
    if ranges is None:
        ranges = max(FEWEST_RANGES, df.agg(F.count(x)).first()[0] // ROWS_PER_RANGE)
    return _sketched(df, {0: (x, ranges)})[0]


def _sketched(df: DataFrame, wanted: Mapping[int, tuple[Column, int]]) -> dict[int, list[float]]:
    """Split points for several columns in one pass."""
    row = df.agg(
        *[
            F.percentile_approx(x, [i / n for i in range(1, n)] or [0.5], 20 * n).alias(f"s{k}")
            for k, (x, n) in wanted.items()
        ]
    ).first()
    return {k: sorted({p for p in row[f"s{k}"] or [] if math.isfinite(p)}) for k in wanted}


def with_range(df: DataFrame, column: str, splits: Sequence[float], out: str = "_range") -> DataFrame:
    """Add the number of the range a value falls in; ranges are left-closed and keep the order."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    bounds = [-float("inf"), *splits, float("inf")]
    source = f"{out}_of"
    cut = Bucketizer(splits=bounds, inputCol=source, outputCol=out, handleInvalid="keep")
    ranged = cut.transform(df.withColumn(source, q(column).cast("double"))).drop(source)
    return ranged.withColumn(out, F.col(out).cast("int"))


def select_ranks(
    df: DataFrame, column: str, ranks: Sequence[int], rows: int, rows_per_range: int = ROWS_PER_RANGE
) -> dict[int, tuple]:
    """Exact order statistics of one column: rank (from 0) -> (value, rows below it, rows equal to it)."""
    return ranks_of(df.select(q(column).alias("_v")), {0: ("_v", ranks, rows)}, rows_per_range)[0]


def ranks_of(
    df: DataFrame, wanted: Mapping[int, tuple[str, Sequence[int], int]], rows_per_range: int = ROWS_PER_RANGE
) -> dict[int, dict[int, tuple]]:
    """Exact order statistics of several columns of one type in three passes at most.

    ``wanted`` maps a number to (column, ranks from 0, count of its non-null values). The result maps it to rank ->
    (value, rows below it, rows equal to it). Columns of one range need neither sketch nor range sizes. The driver receives
    one row per column and range and one per rank.
    """
    long_columns = {
        k: (q(c).cast("double"), max(2, rows // rows_per_range))
        for k, (c, _, rows) in wanted.items()
        if rows > rows_per_range
    }
    splits = _sketched(df, long_columns) if long_columns else {}
    ranged = df
    for k, (c, _, _) in wanted.items():
        ranged = with_range(ranged, c, splits.get(k, []), f"_r{k}")
    where = {k: {0: (0, sorted(set(ranks)))} for k, (_, ranks, _) in wanted.items()}
    if splits:
        parts = [F.struct(F.lit(k).alias("i"), q(f"_r{k}").alias("r"), q(wanted[k][0]).isNotNull().alias("set")) for k in splits]
        sizes = ranged.select(F.inline(F.array(*parts))).filter("set").groupBy("i", "r").count().collect()
        for k in splits:
            where[k], seen = {}, 0
            for part, n in sorted((r["r"], r["count"]) for r in sizes if r["i"] == k):
                inside = [x for x in sorted(set(wanted[k][1])) if seen <= x < seen + n]
                if inside:
                    where[k][part] = (seen, inside)
                seen += n
    cells = [
        F.struct(
            F.lit(k).alias("i"),
            q(f"_r{k}").alias("r"),
            F.when(q(f"_r{k}").isin(list(where[k])), q(c)).alias("v"),
        )
        for k, (c, _, _) in wanted.items()
    ]
    counts = ranged.select(F.inline(F.array(*cells))).filter("v is not null").groupBy("i", "r", "v").agg(F.count("*").alias("n"))
    before = Window.partitionBy("i", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    local = [(k, part, x - start) for k, parts in where.items() for part, (start, inside) in parts.items() for x in inside]
    found: dict[int, dict[int, tuple]] = {k: {} for k in wanted}
    if not local:
        return found
    asked = df.sparkSession.createDataFrame(local, "i int, r int, x long")
    hits = placed.join(F.broadcast(asked), ["i", "r"]).filter("below <= x and x < below + n")
    for row in hits.collect():
        start = where[row["i"]][row["r"]][0]
        found[row["i"]][start + row["x"]] = (row["v"], start + row["below"], row["n"])
    return found


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    rows_per_range: int = ROWS_PER_RANGE,
    stored: bool = False,
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of several columns (empty list for an all-null column).

    One way for every size: values are counted, cut into ranges where there are many, and the few values around the
    wanted ranks come to the driver. The number of jobs does not depend on the number of columns. The columns are
    read several times, so they are stored first unless ``df`` is a stored table already: what lies upstream runs once.
    """
    narrow = df.select(*[q(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    if not stored:
        narrow = materialize(narrow, "quantiles")
    counted = narrow.agg(*[F.count(c).alias(c) for c in narrow.columns]).first()
    positions = {i: [p * (counted[i] - 1) for p in probabilities] for i in range(len(columns)) if counted[i]}
    wanted = {}
    for i, places in positions.items():
        ranks = {int(p) for p in places} | {min(int(p) + 1, counted[i] - 1) for p in places}
        wanted[i] = (f"_x{i}", sorted(ranks), counted[i])
    found = ranks_of(narrow, wanted, rows_per_range) if wanted else {}
    result: dict[str, list[float]] = {}
    for i, c in enumerate(columns):
        result[c] = []
        for p in positions.get(i, []):
            low, part = int(p), p - int(p)
            v_low, v_high = (float(found[i][min(r, counted[i] - 1)][0]) for r in (low, low + 1))
            result[c].append(v_low if part == 0 or v_low == v_high else (1 - part) * v_low + part * v_high)
    return result


def quantile_edges(
    df: DataFrame, columns: Sequence[str], bins: int, rows_per_range: int = ROWS_PER_RANGE, stored: bool = False
) -> dict[str, list[float]]:
    """Distinct quantile edges of each column for ``bins`` equal-share bins."""
    grid = [i / bins for i in range(bins + 1)]
    return {c: sorted(set(v)) for c, v in exact_quantiles(df, columns, grid, rows_per_range, stored).items()}


def quantile_bin(x: str | Column, edges: Sequence[float]) -> Column:
    """Bin number under quantile edges; NULL when the column has fewer than two edges."""
    x = q(x) if isinstance(x, str) else x
    return right_closed_index(x, edges) if len(edges) > 1 else F.lit(None).cast("int")


def quantile_bins(
    df: DataFrame, column: str, bins: int = 10, out: str | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add the equal-share bin of a column; ties never straddle two bins."""
    edges = quantile_edges(df, [column], bins, rows_per_range)[column]
    return df.withColumn(out or f"{column}_bin", quantile_bin(column, edges))


def several_quantile_bins(df: DataFrame, wanted: Mapping[str, tuple[int, str]]) -> DataFrame:
    """Add the equal-share bins of several columns, whose edges come from one stored table; ``wanted``: column to (bins, name)."""
    grid = sorted({i / n for n, _ in wanted.values() for i in range(n + 1)})
    found = exact_quantiles(df, list(wanted), grid)
    added = {}
    for column, (n, out) in wanted.items():
        at = dict(zip(grid, found[column]))
        added[out] = quantile_bin(column, sorted({at[i / n] for i in range(n + 1)} if at else []))
    return df.withColumns(added)


def running_totals(
    df: DataFrame,
    order_by: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    cumulate: Sequence[str] | None = None,
    ranges: int | None = None,
    one_range: int = 10_000,
) -> DataFrame:
    """One row per (by, order_by): each sum, its running total ``cum_<name>``, its group total ``all_<name>``.

    ``cumulate`` limits the running and group totals to the named sums.

    Rows are pre-aggregated per value and that table is stored, so the input runs once. Values are
    then totalled inside each range; offsets of whole ranges come from a table of one
    row per range and group. A short table is one range.
    """
    by = list(by)
    values = df.filter(q(order_by).isNotNull())
    grouped = materialize(
        values.groupBy(*by, order_by).agg(*[c.alias(n) for n, c in sums.items()]), "totals"
    )
    splits = range_splits(grouped, order_by, ranges) if grouped.count() > one_range else []
    names = list(cumulate or sums)
    return prefix_sums(with_range(grouped, order_by, splits), [order_by], names, by, descending)


def prefix_sums(
    ranged: DataFrame, order_by: Sequence[str], names: Sequence[str], by: Sequence[str], descending: bool
) -> DataFrame:
    """Running totals over rows that already carry their ``_range``."""
    by = list(by)
    arrow = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    earlier = (
        Window.partitionBy(*by).orderBy(arrow("_range")).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = ranged.groupBy(*by, "_range").agg(*[F.sum(n).alias(n) for n in names])
    offsets = offsets.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(n).over(Window.partitionBy(*by)).alias(f"all_{n}") for n in names],
    )
    inside = (
        Window.partitionBy(*by, "_range")
        .orderBy(*[arrow(c) for c in order_by])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # groups may be null, and a null group is a group
    keys = [*by, "_range"]
    offsets = offsets.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`")) for c in keys]
    joined = ranged.join(offsets, reduce(Column.__and__, same))
    return joined.select(
        *[c for c in ranged.columns if c != "_range"],
        *[(F.sum(n).over(inside) + F.col(f"_off_{n}")).alias(f"cum_{n}") for n in names],
        *[f"all_{n}" for n in names],
    )


def row_number_both(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    forward: str = "RN1",
    backward: str = "RN_1",
    ranges: int | None = None,
) -> DataFrame:
    """Row number per group from both ends.

    Rows are dealt out by ranges of keys and all order columns, so a hot group, and one of equal leading values too, is
    numbered in parallel: each range on its own, shifted by the sizes of the group's ranges before it. ``order_by`` must
    identify a row within its group. Rows with a null key belong to no group and get no number.
    """
    ranged = _dealt_by_range(df, [*keys, *order_by], ranges)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    sizes = sizes.select(
        *keys,
        "_range",
        F.coalesce(
            F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
        F.sum("_n").over(group).alias("_all"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order_by)
    numbered = ranged.withColumn("_rn", F.row_number().over(inside)).join(sizes, [*keys, "_range"], "left")
    return numbered.select(
        *df.columns,
        (F.col("_off") + F.col("_rn")).alias(forward),
        (F.col("_all") - F.col("_off") - F.col("_rn") + 1).alias(backward),
    )


def _dealt_by_range(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range of all the columns; stored, as a range is cut by a sample of this run."""
    cut = [q(c) for c in columns]
    dealt = df.repartitionByRange(ranges, *cut) if ranges else df.repartitionByRange(*cut)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def first_rows(
    df: DataFrame, order_by: Sequence[str], n: int, rows_per_range: int = ROWS_PER_RANGE
) -> Column:
    """Condition that holds for exactly the n rows that sort first.

    No sort and no limit: the n-th row is located column by column, then the scan is filtered
    against it. ``order_by`` must identify a row.
    """
    if n <= 0:
        return F.lit(False)
    rest, left = df, n
    before, tied = F.lit(False), F.lit(True)
    for column in order_by:
        rows = rest.filter(q(column).isNotNull()).count()
        if rows <= left:
            if rows < left:
                raise ValueError(f"fewer than {n} rows with a {column}")
            return before | (tied & q(column).isNotNull())
        value, below, equal = select_ranks(rest, column, [left - 1], rows, rows_per_range)[left - 1]
        before = before | (tied & (q(column) < F.lit(value)))
        tied = tied & (q(column) == F.lit(value))
        left -= below
        if left == equal:
            return before | tied
        rest = rest.filter(q(column) == F.lit(value))
    raise ValueError("order_by does not tell apart the rows around the cut")
