"""A random forest whose trees all see every row: the trees of Spark ML's forest, grown in one pass a level.

Trees that see the same rows differ only in the features their nodes may use, so nodes of many trees hold the same rows: those
between the same bounds. A pass counts rows by (bounds, feature, bin, class) once for all trees, vectors of the same bounds are
summed behind one shuffle, where the best cut of each feature is found too, and the driver takes each node's best feature. Scores
are looked up by bounds in the same way. Rows are binned once, a byte for a value, into blocks that stay in the executors' memory
or on their disks. Cuts, draws of features and gains are those of ``RandomForestClassifier``, so the trees are the same; it visits
every tree for every row in every pass.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q
from scoreloom.operators.vectors import Batches, gathered, matrix

#: Rows of a block: many, because the work on a block has a share that does not depend on its rows.
BLOCK_ROWS = 1 << 17
#: A bin is stored in one byte, and so is a class.
MOST_BINS = 256
#: Rows by which Spark ML finds cuts, at least.
CUT_ROWS = 10_000

#: Bounds of a node: (column, first bin, last bin) of the columns that are cut above it, by column.
Box = tuple[tuple[int, int, int], ...]


def grows(settings: RandomForestClassifier) -> bool:
    """Whether the forest that the settings describe can be grown here: all trees see all rows, with equal weights."""
    return (
        not settings.getBootstrap()
        and settings.getSubsamplingRate() == 1
        and settings.getImpurity() == "gini"
        and settings.getFeatureSubsetStrategy() == "auto"
        and settings.getMinWeightFractionPerNode() == 0
        and settings.getMaxBins() <= MOST_BINS
        and not settings.isSet("weightCol")
        and not settings.isSet("thresholds")
    )


# -- how Spark ML draws ------------------------------------------------------------------------

_M32, _M48, _M64 = (1 << 32) - 1, (1 << 48) - 1, (1 << 64) - 1


def _mixed(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words."""
    h = seed
    for (k,) in struct.iter_unpack("<I", data):
        k = k * 0xCC9E2D51 & _M32
        k = (k << 15 | k >> 17) & _M32
        h ^= k * 0x1B873593 & _M32
        h = (h << 13 | h >> 19) & _M32
        h = (h * 5 + 0xE6546B64) & _M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M32
    return h ^ h >> 16


class _XorShift:
    def __init__(self, seed: int) -> None:
        data = struct.pack(">Q", seed & _M64)
        low = _mixed(data, 0x3C074A61)
        self.state = _mixed(data, low) << 32 | low

    def bits(self, n: int) -> int:
        x = self.state
        x ^= x << 21 & _M64
        x ^= x >> 35
        x ^= x << 4 & _M64
        self.state = x
        return x & (1 << n) - 1

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53


class _Draws:
    """The features of one node after the other."""

    def __init__(self, seed: int, width: int, trees: int) -> None:
        self.state = (seed ^ 0x5DEECE66D) & _M48
        self.width = width
        self.number = width if trees == 1 else int(np.ceil(np.sqrt(width)))

    def _bits(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & _M48
        return self.state >> 16

    def features(self) -> list[int]:
        if self.number == self.width:
            return list(range(self.width))
        high, low = self._bits(), self._bits()
        random = _XorShift((high << 32) + low - (low >> 31 << 32))
        drawn = list(range(self.number))
        for i in range(self.number, self.width):
            at = int(random.double() * (i + 1))
            if at < self.number:
                drawn[at] = i
        return drawn


def _in_order(trees: Sequence[int]) -> list[int]:
    """Numbers of trees as a Scala map of them is passed through, which settles the order of later draws."""

    def hashed(x: int) -> int:
        x = x + ~(x << 9) & _M32
        x ^= x >> 14
        x = x + (x << 4) & _M32
        return x ^ x >> 10

    def inside(some: Sequence[int], shift: int) -> list[int]:
        at: dict[int, list[int]] = {}
        for tree in some:
            at.setdefault(hashed(tree) >> shift & 31, []).append(tree)
        groups = [found for _, found in sorted(at.items())]
        alone = [found[0] for found in groups if len(found) == 1]
        return alone + [t for found in groups if len(found) > 1 for t in inside(found, shift + 5)]

    # small maps keep the order of the table that they are made from
    return sorted(trees, key=lambda t: (t & 15, t)) if len(trees) <= 4 else inside(trees, 0)


def cuts_of_sample(values: np.ndarray, share: float, rows: int, most: int) -> list[float]:
    """At most ``most`` cuts of a column from the values of sampled rows; ``share`` of ``rows`` was to be sampled."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    if not len(found):
        return []
    counts = counts.astype(float)
    expected, held = share * rows, counts.sum()
    if expected - held > np.finfo(float).eps * held * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, expected - held)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) <= most:
        return middles.tolist()
    upto, stride = np.cumsum(counts), expected / (most + 1)
    cuts, goal = [], stride
    for i, middle in enumerate(middles.tolist()):
        if abs(upto[i] - goal) < abs(upto[i + 1] - goal):
            cuts.append(middle)
            goal += stride
    return cuts


def _cuts(rows: DataFrame, width: int, number: int, settings: RandomForestClassifier) -> list[list[float]]:
    """The cuts of each feature, from a sample of a fixed expected number of rows."""
    bins = min(settings.getMaxBins(), number)
    wanted = max(settings.getMaxBins() ** 2, CUT_ROWS)
    share, sample = 1.0, rows
    if wanted < number:
        share, seed = wanted / number, _XorShift(settings.getSeed()).bits(32)
        session = rows.sparkSession
        drawn = rows._jdf.toJavaRDD().sample(False, share, seed - (seed >> 31 << 32))
        sample = DataFrame(session._jsparkSession.createDataFrame(drawn, rows._jdf.schema()), session)
    values = sample.select(*[f"f{i}" for i in range(width)]).toArrow()
    return [cuts_of_sample(_known(c.to_numpy()), share, number, bins - 1) for c in values.columns]


# -- the rows ----------------------------------------------------------------------------------


def _known(values: np.ndarray) -> np.ndarray:
    if np.isnan(values).any():
        raise ValueError("a forest takes no missing values")
    return values


def _binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Columns x rows; the bin of a value is the number of cuts below it."""
    return np.stack([np.searchsorted(c, x, "left") for x, c in zip(_known(values), cuts)]).astype(np.uint8)


def _blocks(rows: DataFrame, label: str, cuts: list[list[float]], tasks: int) -> RDD:
    """Blocks of classes and bins, dealt evenly to the tasks."""
    width, edges = len(cuts), [np.array(c) for c in cuts]

    def run(batches: Batches) -> Batches:
        for held in gathered((b for b in batches if b.num_rows), BLOCK_ROWS):
            y = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            bins = np.concatenate([_binned(matrix(b, 1), edges) for b in held], axis=1)
            packed = [pa.array([part.astype(np.uint8).tobytes()], pa.binary()) for part in (y, bins)]
            yield pa.RecordBatch.from_arrays(packed, ["y", "bins"])

    stored = rows.select(label, *[f"f{i}" for i in range(width)]).mapInArrow(run, "y binary, bins binary")
    return stored.repartition(tasks).rdd.map(lambda row: (bytes(row[0]), bytes(row[1]))).persist(StorageLevel.MEMORY_AND_DISK)


# -- one pass ----------------------------------------------------------------------------------


@dataclass
class _Place:
    """What is done with the rows between the same bounds: ``features`` are counted under ``number``; cuts lead on."""

    number: int = -1
    features: tuple[int, ...] = ()
    cuts: dict[tuple[int, int], list[_Place | None]] = field(default_factory=dict)
    tables: dict[int, np.ndarray] = field(default_factory=dict)


def _narrowed(box: Box, column: int, cut: int, right: bool) -> Box:
    bounds = {c: (first, last) for c, first, last in box}
    first, last = bounds.get(column, (0, MOST_BINS))
    bounds[column] = (cut + 1, last) if right else (first, cut)
    return tuple((c, *bounds[c]) for c in sorted(bounds))


def _ways(boxes: Mapping[Box, tuple[Box, int, int, bool] | None], wanted: Mapping[Box, tuple[int, tuple[int, ...]]]) -> _Place:
    """The place of all rows, from which cuts lead to the wanted boxes; ``boxes`` holds the way to each from one above it."""
    places: dict[Box, _Place] = {}

    def place(box: Box) -> _Place:
        if box not in places:
            places[box] = found = _Place()
            if (way := boxes[box]) is not None:
                above, column, cut, right = way
                place(above).cuts.setdefault((column, cut), [None, None])[right] = found
        return places[box]

    for box, (number, features) in wanted.items():
        found = place(box)
        found.number, found.features = number, features
    return place(())


def _counted(blocks: RDD, top: _Place, bins: Sequence[int], classes: int, tasks: int, settings: tuple[int, float]) -> dict[tuple[int, int], tuple]:
    """One pass: the best cut by (number of a place, feature), as (gain, cut, counts left of it); a feature without a cut is left out."""
    width, size = len(bins), max(bins) * classes

    def run(blocks: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}

        def visit(place: _Place, rows: np.ndarray | None) -> None:
            if place.features:
                counts = np.stack([np.bincount(cells[f] if rows is None else cells[f].take(rows), minlength=size) for f in place.features])
                if place.number in sums:
                    sums[place.number] += counts
                else:
                    sums[place.number] = counts
            for (column, cut), below in place.cuts.items():
                left = (groups[column] if rows is None else groups[column].take(rows)) <= cut
                for side, there in zip((left, ~left), below):
                    if there is not None:
                        own = np.flatnonzero(side)
                        visit(there, own if rows is None else rows.take(own))

        for y, packed in blocks:
            groups = np.frombuffer(packed, dtype=np.uint8).reshape(width, -1)
            cells = groups.astype(np.intp) * classes + np.frombuffer(y, dtype=np.uint8)
            visit(top, None)
        yield from sums.items()

    features_of: dict[int, tuple[int, ...]] = {}

    def list_features(place: _Place) -> None:
        if place.features:
            features_of[place.number] = place.features
        for below in place.cuts.values():
            for there in below:
                if there is not None:
                    list_features(there)

    list_features(top)

    def finish(item: tuple[int, np.ndarray]) -> list[tuple]:
        number, counts = item
        out = []
        for f, own in zip(features_of[number], counts):
            best = best_cut(own.reshape(-1, classes)[: bins[f]].astype(float), *settings)
            if best is not None:
                out.append(((number, f), best))
        return out

    return dict(blocks.mapPartitions(run).reduceByKey(np.add, tasks).flatMap(finish).collect())


def _gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.ones(len(counts))
    for of_class in counts.T:
        share = np.divide(of_class, total, out=np.zeros(len(counts)), where=total > 0)
        out = out - share * share
    return np.where(total > 0, out, 0.0)


def best_cut(counts: np.ndarray, least_rows: int, least_gain: float) -> tuple[float, int, tuple[float, ...]] | None:
    """The cut (bins x classes) of the largest gain: (gain, last bin to its left, counts of the classes to its left)."""
    left = np.cumsum(counts, axis=0)
    every, left = left[-1:], left[:-1]
    right = every - left
    left_n, right_n, n = left.sum(axis=1), right.sum(axis=1), every.sum()
    gain = _gini(every, every.sum(axis=1)) - left_n / n * _gini(left, left_n) - right_n / n * _gini(right, right_n)
    gain[(left_n < least_rows) | (right_n < least_rows) | (gain < least_gain)] = -np.inf
    at = int(np.argmax(gain))
    return (float(gain[at]), at, tuple(left[at].tolist())) if gain[at] > 0 else None


# -- trees -------------------------------------------------------------------------------------


@dataclass
class _Node:
    box: Box
    counts: np.ndarray
    features: list[int] = field(default_factory=list)
    cut: tuple[int, int] | None = None
    gain: float = 0.0
    below: tuple[_Node, _Node] | None = None

    @property
    def likeliest(self) -> int:
        return int(np.argmax(self.counts))

    def prune(self) -> None:
        """Two leaves of the same likeliest class become one."""
        if self.below:
            for node in self.below:
                node.prune()
            left, right = self.below
            if not left.below and not right.below and left.likeliest == right.likeliest:
                self.cut = self.below = None


@dataclass
class Forest:
    """A fitted forest: the cuts of each feature, and per tree its nodes from the top as [column, cut, left, right], a leaf as the
    share of class 1."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[list]

    def to_json(self) -> str:
        return json.dumps({"forest": {"features": self.features, "cuts": self.cuts, "trees": self.trees}})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        return cls(**json.loads(text)["forest"])

    def __getstate__(self) -> dict:
        return {"features": self.features, "cuts": self.cuts, "trees": self.trees}

    @cached_property
    def _looked_up(self) -> tuple[float, _Place]:
        """The sum of trees without a cut, and the top place: the shares of all leaves right below a place are summed by feature and bin."""
        base, top = 0.0, _Place()
        places: dict[Box, _Place] = {(): top}

        def add(node: list, box: Box) -> None:
            column, cut, *below = node
            for right, child in enumerate(below):
                if isinstance(child, list):
                    narrow = _narrowed(box, column, cut, bool(right))
                    if narrow not in places:
                        places[narrow] = _Place()
                        places[box].cuts.setdefault((column, cut), [None, None])[right] = places[narrow]
                    add(child, narrow)
                else:
                    table = places[box].tables.setdefault(column, np.zeros(len(self.cuts[column]) + 1))
                    table[cut + 1 if right else 0 : None if right else cut + 1] += child

        for tree in self.trees:
            if isinstance(tree, list):
                add(tree, ())
            else:
                base += tree
        return base, top

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        """The probability of class 1; ``values`` has a row per feature."""
        groups = _binned(values, [np.array(c) for c in self.cuts])
        base, top = self._looked_up
        out = np.full(groups.shape[1], base)

        def visit(place: _Place, rows: np.ndarray | None) -> None:
            nonlocal out
            if place.tables:
                parts = [table.take(groups[f] if rows is None else groups[f].take(rows)) for f, table in place.tables.items()]
                share = sum(parts[1:], parts[0])
                if rows is None:
                    out += share
                else:
                    out[rows] += share
            for (column, cut), below in place.cuts.items():
                left = (groups[column] if rows is None else groups[column].take(rows)) <= cut
                for side, there in zip((left, ~left), below):
                    if there is not None:
                        own = np.flatnonzero(side)
                        visit(there, own if rows is None else rows.take(own))

        visit(top, None)
        return out / len(self.trees)

    def score(self, df: DataFrame, out: Mapping[int, str]) -> DataFrame:
        """Add the probability of class 1, computed in Arrow batches."""
        shared = df.sparkSession.sparkContext.broadcast(self.to_json())

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = Forest.from_json(shared.value)
            # a single column comes by itself
            tables = (pd.concat(c, axis=1) if isinstance(c, tuple) else c.to_frame() for c in batches)
            for held in gathered((t for t in tables if len(t)), BLOCK_ROWS):
                values = np.concatenate([t.to_numpy(dtype=float, na_value=np.nan) for t in held])
                yield pd.Series(model.probabilities(np.ascontiguousarray(values.T)))

        return df.withColumn(out[1], score(*[q(c).cast("double") for c in self.features]))


def fit(rows: DataFrame, features: Sequence[str], label: str, settings: RandomForestClassifier) -> tuple[Forest, dict[str, float]]:
    """The forest and the importances of its features; ``rows`` is a stored table of ``label`` and the features as ``f0``, ``f1``, ..."""
    width, trees = len(features), settings.getNumTrees()
    whole = F.col(label) == F.floor(label)
    number, lowest, highest, classed = rows.agg(F.count("*"), F.min(label), F.max(label), F.bool_and(whole)).first()
    if not number or not classed or lowest < 0 or highest >= MOST_BINS:
        raise ValueError("a forest needs rows whose classes are coded from 0")
    classes = int(highest) + 1
    cuts = _cuts(rows, width, number, settings)
    bins = [len(c) + 1 for c in cuts]
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = _blocks(rows, label, cuts, tasks)
    try:
        tops = _grown(blocks, bins, classes, trees, tasks, settings)
    finally:
        blocks.unpersist()
    for top in tops:
        top.prune()
    return Forest(list(features), cuts, [_listed(t) for t in tops]), _importances(tops, features)


def _grown(blocks: RDD, bins: list[int], classes: int, trees: int, tasks: int, settings: RandomForestClassifier) -> list[_Node]:
    draws = _Draws(settings.getSeed(), len(bins), trees)
    depth, rule = settings.getMaxDepth(), (settings.getMinInstancesPerNode(), settings.getMinInfoGain())
    boxes: dict[Box, tuple[Box, int, int, bool] | None] = {(): None}
    y = np.array(blocks.map(lambda b: np.bincount(np.frombuffer(b[0], dtype=np.uint8), minlength=classes)).reduce(np.add), dtype=float)
    tops = [_Node((), y) for _ in range(trees)]
    # the last is taken first
    waiting = [(t, top) for t, top in enumerate(tops)] if depth else []
    for level in range(depth):
        group: dict[int, list[_Node]] = {}
        wanted: dict[Box, set[int]] = {}
        for tree, node in reversed(waiting):
            node.features = [f for f in draws.features() if bins[f] > 1]
            group.setdefault(tree, []).append(node)
            wanted.setdefault(node.box, set()).update(node.features)
        numbers = {box: i for i, box in enumerate(wanted)}
        asked = {box: (numbers[box], tuple(sorted(features))) for box, features in wanted.items() if features}
        if not asked:
            break
        found = _counted(blocks, _ways(boxes, asked), bins, classes, tasks, rule)
        waiting, reached = [], {}
        for tree in _in_order(list(group)):
            for node in group[tree]:
                best = [(found[numbers[node.box], f], f) for f in node.features if (numbers[node.box], f) in found]
                if not best:
                    continue
                (node.gain, cut, left), column = max(best, key=lambda b: b[0][0])
                node.cut, sides = (column, cut), (np.array(left), node.counts - np.array(left))
                below = [_narrowed(node.box, column, cut, right) for right in (False, True)]
                node.below = _Node(below[0], sides[0]), _Node(below[1], sides[1])
                for right, child in enumerate(node.below):
                    reached.setdefault(child.box, (node.box, column, cut, bool(right)))
                    impurity = _gini(child.counts[None], child.counts.sum(keepdims=True))[0]
                    if level + 1 < depth and abs(impurity) >= np.finfo(float).eps:
                        waiting.append((tree, child))
        boxes.update((box, way) for box, way in reached.items() if box not in boxes)
    return tops


def _listed(node: _Node) -> list | float:
    if node.below is None:
        return float(node.counts[1] / node.counts.sum()) if len(node.counts) > 1 else 0.0
    return [*node.cut, *map(_listed, node.below)]


def _importances(tops: Sequence[_Node], features: Sequence[str]) -> dict[str, float]:
    """Each tree's gains by rows, as shares of the tree; their sums as shares of all."""
    total = np.zeros(len(features))

    def add(node: _Node, own: np.ndarray) -> None:
        if node.below:
            own[node.cut[0]] += node.gain * node.counts.sum()
            for child in node.below:
                add(child, own)

    for top in tops:
        own = np.zeros(len(features))
        add(top, own)
        total += own / own.sum() if own.sum() else 0
    total = total / total.sum() if total.sum() else total
    return dict(zip(features, total.tolist()))
