"""Boosted trees for two or more classes: second-order histograms, all classes of a round grown together.

Features are cut into quantile groups once and stored as one byte each, in blocks of an Arrow batch of rows that stay in the
executors' memory or on their disks. A level of all trees of a round is one pass: tasks add up gradients and curvatures by
(tree, column, node, group), vectors of one tree and column are summed behind one shuffle, where their best cuts are found
too, and the driver takes the best column of each node. Where each tree has drawn one column, the sums of its groups hold
those of all its nodes, and a round is one pass; margins are then sums of one value per column and group, which are looked up.
Several models can be fitted in the same passes, each on all rows but one fold. Other margins are stored every few rounds, so
a pass evaluates few trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q
from scoreloom.operators.vectors import Batches, doubles, group_of, matrix, merged, quantile_cuts, vector_rows
from scoreloom.session import delete_path, new_path

#: Rounds whose trees a pass evaluates at most before margins are stored.
STORED_EVERY = 10
#: A gain must be larger than this.
LEAST_GAIN = 1e-6
#: A group is stored in one byte.
MOST_GROUPS = 256


@dataclass(frozen=True)
class Settings:
    """How trees are grown. ``groups`` counts the group of missing values."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.01
    row_share: float = 0.5
    column_share: float = 0.1
    penalty: float = 1.0
    least_weight: float = 1.0
    groups: int = 128
    seed: int = 42


@dataclass
class Tree:
    """Nodes in heap order: node i has the children 2i + 1 and 2i + 2; a leaf has column -1."""

    column: np.ndarray
    group: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, dtype=int), np.zeros(n, dtype=bool), np.zeros(n))

    def nodes(self, groups: np.ndarray, levels: int) -> np.ndarray:
        """The node each row (a column of ``groups``) has come to after some levels."""
        at = np.zeros(groups.shape[1], dtype=np.intp)
        if not (levels and groups.size):
            return at
        # the node after each node above the last level, by the group of a row in the node's column
        width = int(groups.max()) + 1
        column, cut, missing_left = (x[: 2**levels - 1, None] for x in (self.column, self.group, self.missing_left))
        node, group = np.arange(len(column))[:, None], np.arange(width)
        left = np.where(group == 0, missing_left, group <= cut)
        after = np.where(column >= 0, 2 * node + 2 - left, node).reshape(-1)
        start = np.maximum(column[:, 0], 0) * groups.shape[1]
        rows, values = np.arange(groups.shape[1]), np.ascontiguousarray(groups).reshape(-1)
        for _ in range(levels):
            at = after.take(at * width + values.take(start.take(at) + rows))
        return at

    @property
    def levels(self) -> int:
        return int(np.log2(len(self.value) + 1)) - 1

    @cached_property
    def by_group(self) -> tuple[int, np.ndarray] | None:
        """Where one column decides: that column and the value of each of its groups. Ask for it once the tree is grown."""
        used = np.unique(self.column[self.column >= 0])
        if len(used) > 1:
            return None
        own = int(used[0]) if len(used) else 0
        each = np.arange(MOST_GROUPS)
        return own, self.value[self.nodes(np.broadcast_to(each, (own + 1, len(each))), self.levels)]

    def values(self, groups: np.ndarray) -> np.ndarray:
        if self.by_group is None:
            return self.value[self.nodes(groups, self.levels)]
        own, value = self.by_group
        return value[groups[own]]


@dataclass
class Boosted:
    """A fitted model: the groups' cuts of each feature, and per round a tree for each class (one tree for two classes)."""

    features: list[str]
    cuts: list[list[float]]
    classes: int
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: dict[int, list[float]] = field(default_factory=dict)
    _parts: tuple[int, np.ndarray] | None = field(default=None, init=False, repr=False, compare=False)

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def importances(self) -> dict[str, float]:
        """Mean gain of a feature's cuts, as a share of all."""
        means = {c: float(np.mean(self.gains[i])) if self.gains.get(i) else 0.0 for i, c in enumerate(self.features)}
        total = sum(means.values())
        return {c: v / total if total else 0.0 for c, v in means.items()}

    def groups(self, values: np.ndarray) -> np.ndarray:
        return np.stack([group_of(x, np.array(cuts)) for x, cuts in zip(values, self.cuts)]) if len(values) else values

    def staged(self, values: np.ndarray) -> Iterator[np.ndarray]:
        """Margins (outputs x rows) after each round; ``values`` has a row per feature."""
        yield from self._staged(self.groups(values))

    def _staged(self, groups: np.ndarray) -> Iterator[np.ndarray]:
        margins = np.zeros((self.outputs, groups.shape[1]))
        for trees in self.rounds:
            margins = margins + np.stack([t.values(groups) for t in trees])
            yield margins

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """Classes x rows."""
        return self.of_groups(self.groups(values))

    def of_groups(self, groups: np.ndarray) -> np.ndarray:
        """Classes x rows, where the values are cut into groups already."""
        if (shares := self._shares()) is not None:
            return probabilities(_of_shares(shares, groups).T)
        margins = np.zeros((self.outputs, groups.shape[1]))
        for margins in self._staged(groups):
            pass
        return probabilities(margins)

    def _shares(self) -> np.ndarray | None:
        """The margins' parts by column, group and output, where one column decides each tree."""
        if any(tree.by_group is None for trees in self.rounds for tree in trees):
            return None
        if self._parts is None or self._parts[0] != len(self.rounds):
            shares = np.zeros((len(self.features), MOST_GROUPS, self.outputs))
            for trees in self.rounds:
                _add_shares(shares, trees)
            self._parts = len(self.rounds), shares
        return self._parts[1]

    def to_json(self) -> str:
        trees = [
            [[t.column.tolist(), t.group.tolist(), t.missing_left.tolist(), t.value.tolist()] for t in round_] for round_ in self.rounds
        ]
        return json.dumps({"features": self.features, "cuts": self.cuts, "classes": self.classes, "trees": trees, "gains": self.gains})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        doc = json.loads(text)
        rounds = [
            [Tree(np.array(c), np.array(g), np.array(m, dtype=bool), np.array(v)) for c, g, m, v in round_] for round_ in doc["trees"]
        ]
        return cls(doc["features"], doc["cuts"], doc["classes"], rounds, {int(k): v for k, v in doc["gains"].items()})

    def score(self, df: DataFrame, out: Mapping[int, str]) -> DataFrame:
        """Add the probabilities of the named classes, computed in Arrow batches."""
        shared = df.sparkSession.sparkContext.broadcast(self.to_json())

        def shares(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[np.ndarray]:
            model = Boosted.from_json(shared.value)
            for columns in batches:
                # a single column comes by itself
                values = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in (columns if isinstance(columns, tuple) else (columns,))])
                yield model.probabilities(values)

        if len(out) == 1:
            ((i, name),) = out.items()

            @F.pandas_udf("double")
            def share(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
                for found in shares(batches):
                    yield pd.Series(found[i])

            return df.withColumn(name, share(*[q(c).cast("double") for c in self.features]))

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for found in shares(batches):
                yield pd.Series(list(found.T), dtype=object)

        scored = df.withColumn("_probabilities", score(*[q(c).cast("double") for c in self.features]))
        return scored.withColumns({name: F.col("_probabilities")[i] for i, name in out.items()}).drop("_probabilities")


def _add_shares(shares: np.ndarray, trees: Sequence[Tree]) -> None:
    """Add trees of one column each, one per output, to the margins' parts (columns, groups, outputs)."""
    for k, tree in enumerate(trees):
        own, value = tree.by_group
        shares[own, :, k] += value[: shares.shape[1]]


def _of_shares(shares: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Margins (rows x outputs) as the sum of each column's part."""
    out = np.zeros((groups.shape[1], shares.shape[2]))
    for part, group in zip(shares, groups):
        if part.any():
            out += np.take(part, group, axis=0)
    return out


def probabilities(margins: np.ndarray) -> np.ndarray:
    if len(margins) == 1:
        p = 1 / (1 + np.exp(-margins))
        return np.concatenate([1 - p, p])
    e = np.exp(margins - margins.max(axis=0))
    return e / e.sum(axis=0)


def _slopes(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log loss (outputs x rows)."""
    p = probabilities(margins)
    if len(margins) == 1:
        p = p[1:]
        return p - y, np.maximum(p * (1 - p), 1e-16)
    return p - (np.arange(len(p))[:, None] == y), np.maximum(2 * p * (1 - p), 1e-16)


def _drawn_rows(draw: np.ndarray, settings: Settings, round_: int) -> np.ndarray:
    """The rows of a round, by a hash of each row."""
    with np.errstate(over="ignore"):
        x = draw.view(np.uint64) ^ np.uint64((settings.seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ (x >> np.uint64(33))) / 2.0**64 < settings.row_share


def _drawn_number(width: int, settings: Settings) -> int:
    return max(1, int(settings.column_share * width))


def _drawn_columns(width: int, settings: Settings, round_: int, output: int) -> np.ndarray:
    n = _drawn_number(width, settings)
    return np.sort(np.random.default_rng([settings.seed, round_, output]).choice(width, n, replace=False))


def best_cuts(sums: np.ndarray, settings: Settings) -> Iterator[tuple[int, float, int, bool, float, float, float, float]]:
    """The best cut of a column in each node: (node, gain, group, missing left, left sums, all sums).

    ``sums`` has shape (nodes, 2, groups): gradients and curvatures, group 0 holding missing values. A node without a cut has gain 0.
    """

    def weight(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + settings.penalty)

    for node, (g, h) in enumerate(sums):
        all_g, all_h = g.sum(), h.sum()
        best = (0.0, 0, False, 0.0, 0.0)
        for missing_left in (False, True) if h[0] else (False,):
            left_g, left_h = np.cumsum(g[1:-1]), np.cumsum(h[1:-1])
            if missing_left:
                left_g, left_h = left_g + g[0], left_h + h[0]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = weight(left_g, left_h) + weight(right_g, right_h) - weight(all_g, all_h)
            gain[(left_h < settings.least_weight) | (right_h < settings.least_weight)] = 0
            at = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[at] > max(best[0], LEAST_GAIN):
                best = (float(gain[at]), at + 1, missing_left, float(left_g[at]), float(left_h[at]))
        yield node, *best, float(all_g), float(all_h)


@dataclass(frozen=True)
class _Layout:
    """How a block of rows is stored: labels, folds, hashes, groups (a byte each; columns x rows) and margins (models x outputs x rows),
    which are empty before the first trees are added."""

    width: int
    models: int
    outputs: int

    def rows(self, block: Sequence[bytes]) -> tuple[np.ndarray, ...]:
        *kept, groups = (np.frombuffer(part, dtype=kind) for part, kind in zip(block[:4], _KINDS))
        return *kept, groups.reshape(self.width, -1)

    def read(self, block: Sequence[bytes]) -> tuple[np.ndarray, ...]:
        y, *rest = self.rows(block)
        margins, shape = np.frombuffer(block[4], dtype=_KINDS[4]), (self.models, self.outputs, len(y))
        return y, *rest, margins.reshape(shape) if len(margins) else np.zeros(shape)


@dataclass(frozen=True)
class _Rows:
    path: str
    table: DataFrame
    layout: _Layout
    blocks: RDD

    def free(self) -> None:
        self.blocks.unpersist()
        delete_path(self.table.sparkSession, self.path)


_STORED = "y binary, fold binary, draw binary, groups binary, margins binary"
_NAMES = [f.split()[0] for f in _STORED.split(", ")]
_KINDS = ("<i4", "<i4", "<i8", "u1", "<f8")


def _block(parts: Sequence[np.ndarray]) -> pa.RecordBatch:
    """One row that holds a block."""
    packed = [pa.array([part.astype(kind).tobytes()], pa.binary()) for part, kind in zip(parts, _KINDS)]
    return pa.RecordBatch.from_arrays(packed, _NAMES)


def _stored(df: DataFrame, layout: _Layout) -> _Rows:
    path = new_path(df.sparkSession, "boosting")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    blocks = table.rdd.map(lambda row: tuple(bytes(part) for part in row))
    return _Rows(path, table, layout, blocks.persist(StorageLevel.MEMORY_AND_DISK))


def _prepared(
    df: DataFrame, cuts: list[list[float]], features: Sequence[str], target: str, fold: Column, models: int, outputs: int, even: bool
) -> _Rows:
    edges = [np.array(c) for c in cuts]
    # rows are hashed with all their columns, so that keys tell equal features apart
    carry = {"y": q(target).cast("int"), "fold": F.coalesce(fold.cast("int"), F.lit(-1)), "draw": F.xxhash64(*[q(c) for c in df.columns])}
    rows = doubles(df.filter(q(target).isNotNull()), features, carry)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                carried = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                groups = np.stack([group_of(x, e) for x, e in zip(matrix(batch, 3), edges)])
                yield _block([*carried, groups, np.zeros(0)])

    # a stored table of few files would leave most tasks without rows
    dealt = rows if even else rows.hint("rebalance")
    return _stored(dealt.mapInArrow(run, _STORED), _Layout(len(features), models, outputs))


def _advanced(margins: np.ndarray, groups: np.ndarray, pending: Sequence[Sequence[Sequence[Tree]]]) -> np.ndarray:
    if not pending:
        return margins
    out = margins.copy()
    for round_ in pending:
        for m, trees in enumerate(round_):
            for k, tree in enumerate(trees):
                out[m, k] += tree.values(groups)
    return out


def _with_margins(rows: _Rows, pending: list) -> _Rows:
    """The rows with the pending trees added to their margins; the former table is removed."""
    layout = rows.layout

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block in zip(*(c.to_pylist() for c in batch.columns)):
                *kept, groups, margins = layout.read(block)
                yield _block([*kept, groups, _advanced(margins, groups, pending)])

    out = _stored(rows.table.mapInArrow(run, _STORED), layout)
    rows.free()
    return out


def _passed(rows: _Rows, pending: list, trees: list[list[Tree]], columns: list[np.ndarray], level: int, round_: int, settings: Settings, found) -> list:
    """One pass: what ``found(sums)`` yields for the sums (nodes, 2, groups) of each tree (model, output) and drawn column."""
    nodes, first, groups_n, layout = 2**level, 2**level - 1, settings.groups, rows.layout

    def run(blocks: Iterator[Sequence[bytes]]) -> Iterator[tuple]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for block in blocks:
            y, fold, draw, groups, margins = layout.read(block)
            drawn = np.flatnonzero(_drawn_rows(draw, settings, round_))
            y, fold, groups, margins = y[drawn], fold[drawn], groups.take(drawn, axis=1), margins[:, :, drawn]
            margins = _advanced(margins, groups, pending)
            for m in range(layout.models):
                g, h = _slopes(margins[m], y)
                learns = fold != m
                for k, tree in enumerate(trees[m]):
                    at = tree.nodes(groups, level) - first
                    used = np.flatnonzero(learns & (at >= 0))
                    start, slopes = at[used] * groups_n, (g[k, used], h[k, used])
                    for c in columns[k].tolist():
                        cell = start + groups[c].take(used)
                        both = np.stack([np.bincount(cell, s, nodes * groups_n) for s in slopes])
                        key = m, k, c
                        sums[key] = sums[key] + both if key in sums else both
        for key, both in sums.items():
            yield key, both.reshape(2, nodes, groups_n).transpose(1, 0, 2)

    return _summed(rows, run, columns, found)


def _summed(rows: _Rows, run, columns: list[np.ndarray], found) -> list:
    """What ``found`` yields for the sums of equal keys (model, output, column) that ``run`` yields for blocks."""

    def finish(item: tuple) -> list[tuple]:
        return [(*item[0], *rest) for rest in found(item[1])]

    tasks = min(rows.layout.models * sum(map(len, columns)), rows.blocks.getNumPartitions())
    return rows.blocks.mapPartitions(run).reduceByKey(np.add, max(1, tasks)).flatMap(finish).collect()


def _level(rows: _Rows, pending: list, trees: list[list[Tree]], columns: list[np.ndarray], level: int, round_: int, settings: Settings) -> list:
    """One pass: for each tree (model, output) and node of a level the best cut over the drawn columns, as (m, k, c, level, node, cut)."""

    def found(sums: np.ndarray) -> Iterator[tuple]:
        for node, *best in best_cuts(sums, settings):
            if best[-1] > 0:
                yield level, node, best

    return _passed(rows, pending, trees, columns, level, round_, settings, found)


def column_cuts(sums: np.ndarray, settings: Settings) -> Iterator[tuple[int, int, list]]:
    """All cuts of a tree over one column, as (level, node, cut), from its sums (1, 2, groups)."""
    groups = np.arange(settings.groups)
    held = {0: np.ones(settings.groups, dtype=bool)}
    for level in range(settings.depth):
        below: dict[int, np.ndarray] = {}
        for node, inside in held.items():
            ((_, *best),) = best_cuts(np.where(inside, sums, 0), settings)
            if best[-1] > 0:
                yield level, node, best
            gain, group, missing_left, *_ = best
            if gain > 0:
                left = np.where(groups == 0, missing_left, groups <= group)
                below |= {2 * node: inside & left, 2 * node + 1: inside & ~left}
        held = below


def _whole(rows: _Rows, shares: np.ndarray, columns: list[np.ndarray], round_: int, settings: Settings) -> list:
    """One pass for all levels of trees that have drawn one column each; ``shares`` holds the margins' parts of all models and outputs."""
    layout = rows.layout

    def run(blocks: Iterator[Sequence[bytes]]) -> Iterator[tuple]:
        sums = np.zeros((layout.models, layout.outputs, 2, settings.groups))
        for block in blocks:
            y, fold, draw, groups = layout.rows(block)
            drawn = np.flatnonzero(_drawn_rows(draw, settings, round_))
            y, fold, groups = y[drawn], fold[drawn], groups[:, drawn]
            margins = np.ascontiguousarray(_of_shares(shares, groups).T).reshape(layout.models, layout.outputs, -1)
            cells = [groups[c].astype(np.intp) for (c,) in columns]
            for m in range(layout.models):
                learns = fold != m
                for i, slopes in enumerate(_slopes(margins[m], y)):
                    for k, cell in enumerate(cells):
                        sums[m, k, i] += np.bincount(cell, slopes[k] * learns, settings.groups)
        for m in range(layout.models):
            for k, (c,) in enumerate(columns):
                yield (m, k, int(c)), sums[m, k][None]

    return _summed(rows, run, columns, lambda found: column_cuts(found, settings))


def _grown(
    rows: _Rows, pending: list, shares: np.ndarray | None, round_: int, settings: Settings, gains: list[dict[int, list[float]]]
) -> list[list[Tree]]:
    trees = [[Tree.empty(settings.depth) for _ in range(rows.layout.outputs)] for _ in range(rows.layout.models)]
    columns = [_drawn_columns(rows.layout.width, settings, round_, k) for k in range(rows.layout.outputs)]

    def leaf(g: float, h: float) -> float:
        return -settings.rate * g / (h + settings.penalty)

    def add(cuts: list) -> bool:
        """Enter the best cuts of nodes whose parents are known; whether there was one."""
        best: dict[tuple[int, int, int, int], tuple] = {}
        for m, k, c, level, node, cut in cuts:
            key = level, m, k, node
            if key not in best or (cut[0], -c) > best[key][:2]:
                best[key] = (cut[0], -c, cut)
        for (level, m, k, node), (_, c, (gain, group, missing_left, left_g, left_h, g, h)) in sorted(best.items(), key=lambda x: x[0]):
            tree, at = trees[m][k], 2**level - 1 + node
            if level == 0:
                tree.value[at] = leaf(g, h)
            if gain > 0:
                tree.column[at], tree.group[at], tree.missing_left[at] = -c, group, missing_left
                tree.value[2 * at + 1] = leaf(left_g, left_h)
                tree.value[2 * at + 2] = leaf(g - left_g, h - left_h)
                gains[m].setdefault(-c, []).append(gain)
        return any(found[0] > 0 for found in best.values())

    if shares is not None:
        add(_whole(rows, shares, columns, round_, settings))
        return trees
    for level in range(settings.depth):
        if not add(_level(rows, pending, trees, columns, level, round_, settings)):
            break
    return trees


def fit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    classes: int = 2,
    settings: Settings = Settings(),
    fold: Column | None = None,
    folds: int = 0,
    cuts: dict[str, list[float]] | None = None,
) -> list[Boosted]:
    """Models for classes coded from 0: with ``folds``, one on all rows but those of each fold, and last one on all rows.

    ``fold`` numbers the folds from 0. ``cuts`` may come from ``feature_cuts``. A round takes one pass per level, whatever the
    number of classes and folds, and one in all where a tree draws a single column.
    """
    rows, models = _fitted(df, features, target, classes, settings, fold, folds, cuts, False)
    rows.free()
    return models


def fit_and_test(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    classes: int,
    settings: Settings,
    fold: Column,
    folds: int,
    cuts: dict[str, list[float]] | None = None,
) -> tuple[Boosted, np.ndarray]:
    """The model on all rows, and how many rows of each class (first axis) the models that have not seen their fold give each
    class. The rows are read once, from a table whose files are even; rows without a fold are not tested."""
    rows, (*held_out, whole) = _fitted(df, features, target, classes, settings, fold, folds, cuts, True)
    shared = df.sparkSession.sparkContext.broadcast([m.to_json() for m in held_out])
    layout = rows.layout

    def run(blocks: Iterator[Sequence[bytes]]) -> Iterator[np.ndarray]:
        scorers = [Boosted.from_json(m) for m in shared.value]
        counts = np.zeros((classes, classes), dtype=np.int64)
        for block in blocks:
            y, fold_of, _, groups = layout.rows(block)
            for m, scorer in enumerate(scorers):
                own = np.flatnonzero(fold_of == m)
                if len(own):
                    np.add.at(counts, (y[own], scorer.of_groups(groups[:, own]).argmax(axis=0)), 1)
        yield counts

    counts = rows.blocks.mapPartitions(run).fold(np.zeros((classes, classes), dtype=np.int64), np.add)
    rows.free()
    return whole, counts


def _fitted(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    classes: int,
    settings: Settings,
    fold: Column | None,
    folds: int,
    cuts: dict[str, list[float]] | None,
    even: bool,
) -> tuple[_Rows, list[Boosted]]:
    """The stored rows and the models of ``fit``; ``even`` says that the rows are dealt evenly already."""
    features = list(features)
    found = cuts or feature_cuts(df.filter(q(target).isNotNull()), features, settings)
    edges = [found[c] for c in features]
    outputs = 1 if classes == 2 else classes
    rows = _prepared(df, edges, features, target, fold if fold is not None else F.lit(-1), folds + 1, outputs, even)
    models = [Boosted(features, edges, classes) for _ in range(folds + 1)]
    pending: list[list[list[Tree]]] = []
    shares = np.zeros((len(features), settings.groups, (folds + 1) * outputs)) if _drawn_number(len(features), settings) == 1 else None
    for round_ in range(settings.rounds):
        if len(pending) >= STORED_EVERY:
            rows, pending = _with_margins(rows, pending), []
        trees = _grown(rows, pending, shares, round_, settings, [m.gains for m in models])
        if shares is None:
            pending.append(trees)
        else:
            _add_shares(shares, [tree for own in trees for tree in own])
        for model, own in zip(models, trees):
            model.rounds.append(own)
    return rows, models


def feature_cuts(df: DataFrame, features: Sequence[str], settings: Settings = Settings()) -> dict[str, list[float]]:
    return quantile_cuts(df, features, settings.groups - 1)


def staged_losses(df: DataFrame, model: Boosted, target: str, dataset: str) -> DataFrame:
    """(dataset, round, loss, error): log loss and share of wrong classes after every round, in one scan."""
    named = df.filter(q(target).isNotNull())
    names = sorted(r[0] for r in named.select(F.col(dataset)).distinct().collect() if r[0] is not None)
    code = F.array_position(F.array(*[F.lit(n) for n in names]), q(dataset)) - 1
    shared = df.sparkSession.sparkContext.broadcast(model.to_json())
    rows = doubles(named.filter(q(dataset).isNotNull()), model.features, {"d": code.cast("int"), "y": q(target).cast("int")}).hint("rebalance")
    n = len(model.rounds)

    def run(batches: Batches) -> Batches:
        scorer = Boosted.from_json(shared.value)
        sums = np.zeros((len(names), 2 * n + 1))
        for batch in batches:
            d, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            sums[:, -1] += np.bincount(d, minlength=len(names))
            for r, margins in enumerate(scorer.staged(matrix(batch, 2))):
                p = probabilities(margins)
                loss = -np.log(np.clip(p[y, np.arange(len(y))], 1e-16, 1))
                wrong = p.argmax(axis=0) != y
                sums[:, r] += np.bincount(d, loss, len(names))
                sums[:, n + r] += np.bincount(d, wrong, len(names))
        yield vector_rows([(i,) for i in range(len(names))], list(sums), ["d"])

    def finish(key: tuple, total: np.ndarray) -> Iterator[tuple]:
        for r in range(n if total[-1] else 0):
            yield names[key[0]], r + 1, float(total[r] / total[-1]), float(total[n + r] / total[-1])

    parts = rows.mapInArrow(run, "d long, vector binary")
    return merged(parts, ["d"], np.add, finish, "dataset string, round int, loss double, error double")


def out_of_fold(df: DataFrame, models: Sequence[Boosted], target: str, fold: Column) -> DataFrame:
    """(y, predicted, n): each row's class by the model that has not seen its fold, counted."""
    shared = df.sparkSession.sparkContext.broadcast([m.to_json() for m in models])
    classes = models[0].classes
    rows = doubles(df.filter(q(target).isNotNull()), models[0].features, {"fold": fold.cast("int"), "y": q(target).cast("int")}).hint("rebalance")

    def run(batches: Batches) -> Batches:
        scorers = [Boosted.from_json(m) for m in shared.value]
        counts = np.zeros((classes, classes))
        for batch in batches:
            fold_of, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            values = matrix(batch, 2)
            for m in np.unique(fold_of).tolist():
                own = np.flatnonzero(fold_of == m)
                guess = scorers[m].probabilities(values[:, own]).argmax(axis=0)
                np.add.at(counts, (y[own], guess), 1)
        used = np.argwhere(counts)
        columns = [used[:, 0], used[:, 1], counts[used[:, 0], used[:, 1]].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["y", "predicted", "n"])

    return rows.mapInArrow(run, "y long, predicted long, n long").groupBy("y", "predicted").agg(F.sum("n").alias("n"))
