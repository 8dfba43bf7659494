"""Wide statistics as vectors: tasks fold Arrow batches into arrays, arrays of one key are merged behind one shuffle.

What a task holds, sends and merges depends on the number of columns and bins, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q

#: Points that a quantile summary keeps of what it has seen.
SUMMARY_POINTS = 4096
#: Columns that one scan summarises.
COLUMNS_PER_PASS = 200

Batches = Iterator[pa.RecordBatch]


def doubles(df: DataFrame, columns: Sequence[str], carry: Mapping[str, object] | None = None) -> DataFrame:
    """The columns as doubles under positional names, ``x0``, ``x1``, ..., behind what is carried along."""
    kept = [c.alias(name) for name, c in (carry or {}).items()]
    return df.select(*kept, *[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def matrix(batch: pa.RecordBatch, first: int, last: int | None = None) -> np.ndarray:
    """Columns of a batch as rows of a float array; NULL and NaN are NaN, and -0.0 is 0.0."""
    columns = batch.columns[first:last]
    out = np.empty((len(columns), batch.num_rows))
    for i, column in enumerate(columns):
        out[i] = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out + 0.0


def gathered(batches: Iterator, rows: int) -> Iterator[list]:
    """Batches in lists of at least so many rows, the last maybe of fewer."""
    held, number = [], 0
    for batch in batches:
        held.append(batch)
        number += len(batch)
        if number >= rows:
            yield held
            held, number = [], 0
    if held:
        yield held


def merged(parts: DataFrame, keys: Sequence[str], fold: Callable[[np.ndarray, np.ndarray], np.ndarray], finish: Callable, schema: str) -> DataFrame:
    """Vectors (``vector``, packed doubles) of equal whole-number keys folded into one, and what ``finish(key, vector)`` makes of it.

    ``finish`` yields rows of ``schema``. A task holds one vector at a time.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        held, total = None, None
        rows: list[tuple] = []
        schema_of = result_types

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema_of)], names)

        for batch in batches:
            for *key, packed in zip(*(c.to_pylist() for c in batch.columns)):
                vector = np.frombuffer(packed, dtype="<f8")
                if key == held:
                    total = fold(total, vector)
                else:
                    if held is not None:
                        rows.extend(finish(tuple(held), total))
                    held, total = key, vector.copy()
            if len(rows) >= 1024:
                yield out()
                rows.clear()
        if held is not None:
            rows.extend(finish(tuple(held), total))
        if rows:
            yield out()

    result_types = [_ARROW[f.split(" ", 1)[1]] for f in schema.split(", ")]
    dealt = parts.select(*keys, "vector").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()),
}


def vector_rows(keys: Sequence[Sequence[int]], vectors: Sequence[np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    """A batch of whole-number keys with packed vectors."""
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary())], [*names, "vector"])


# -- quantile summaries ------------------------------------------------------------------------


def thinned(values: np.ndarray, weights: np.ndarray, points: int = SUMMARY_POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with weights, at most ``points`` of them; all of them where there are no more."""
    values, where = np.unique(values, return_inverse=True)
    weights = np.bincount(where, weights=weights, minlength=len(values))
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    slot = np.minimum((upto - weights / 2) * points / upto[-1], points - 1).astype(np.int64)
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    # a slot is known by its largest value
    ends = np.append(starts[1:], len(values)) - 1
    return values[ends], np.add.reduceat(weights, starts)


class Summary:
    """A quantile summary of a stream; summaries of equal weight class are merged, so each value is thinned few times."""

    def __init__(self) -> None:
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, values: np.ndarray) -> None:
        values = values[np.isfinite(values)]
        if len(values):
            self._put(0, thinned(values, np.ones(len(values))))

    def _put(self, level: int, summary: tuple[np.ndarray, np.ndarray]) -> None:
        while level in self.levels:
            v, w = self.levels.pop(level)
            summary = thinned(np.concatenate([v, summary[0]]), np.concatenate([w, summary[1]]))
            level += 1
        self.levels[level] = summary

    def packed(self) -> np.ndarray:
        if not self.levels:
            return np.zeros(0)
        v, w = (np.concatenate(x) for x in zip(*self.levels.values()))
        return np.concatenate(thinned(v, w))


def _halves(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 2
    return packed[:n], packed[n:]


def _merge_summaries(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (va, wa), (vb, wb) = _halves(a), _halves(b)
    return np.concatenate(thinned(np.concatenate([va, vb]), np.concatenate([wa, wb])))


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of at most ``bins`` groups of similar weight, but the last; one group per value where values are few."""
    if len(values) <= bins:
        return values[:-1]
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, np.arange(1, bins) * upto[-1] / bins)
    return np.unique(values[np.minimum(at, len(values) - 2)])


def quantile_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """For each column at most ``bins - 1`` rising values; value v is in the group of the first cut >= v.

    Columns of at most ``bins`` distinct values get a group per value. The driver receives the cuts.
    """
    found: dict[str, list[float]] = {}
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = list(columns[start : start + COLUMNS_PER_PASS])
        width = len(part)

        def run(batches: Batches, width: int = width) -> Batches:
            summaries = [Summary() for _ in range(width)]
            for batch in batches:
                for summary, values in zip(summaries, matrix(batch, 0)):
                    summary.add(values)
            yield vector_rows([(i,) for i in range(width)], [s.packed() for s in summaries], ["i"])

        def finish(key: tuple, packed: np.ndarray) -> Iterator[tuple]:
            if len(packed):
                yield key[0], cuts_of(*_halves(packed), bins).tolist()

        parts = doubles(df, part).mapInArrow(run, "i long, vector binary")
        for row in merged(parts, ["i"], _merge_summaries, finish, "i long, cuts array<double>").collect():
            found[part[row["i"]]] = list(row["cuts"])
    return {c: found.get(c, []) for c in columns}


def group_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The group of each value, from 1; 0 where it is missing."""
    return np.where(np.isnan(values), 0, np.searchsorted(cuts, values, "left") + 1)
