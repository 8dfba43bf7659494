"""Cross-validated single-feature trees against trees grown plainly per fold."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import stats


def grown(pairs):
    """A plain tree on one number: split at every middle between two values that differ in class, down to one class or value."""
    values = sorted({x for x, _ in pairs})
    classes = Counter(y for _, y in pairs)
    if len(values) == 1 or len(classes) == 1:
        top = min(classes, key=lambda c: (-classes[c], c))
        return lambda x: top
    middle = (values[len(values) // 2 - 1] + values[len(values) // 2]) / 2
    left, right = grown([p for p in pairs if p[0] <= middle]), grown([p for p in pairs if p[0] > middle])
    return lambda x: left(x) if x <= middle else right(x)


def weighted_f1(pairs):
    total = 0.0
    for c in {y for y, _ in pairs}:
        hit = sum(y == p == c for y, p in pairs)
        total += 2 * hit / (sum(y == c for y, _ in pairs) + sum(p == c for _, p in pairs)) * sum(y == c for y, _ in pairs)
    return total / len(pairs)


def test_power_equals_a_plain_tree_per_fold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = None if i % 40 == 0 else float(rng.integers(0, 60))
        t = None if i % 33 == 0 else f"t{rng.integers(0, 90)}"
        y = int((x or 30) > 30) + int(rng.random() < 0.2)
        rows.append((i, x, t, bool(rng.random() < 0.5), y))
    df = spark.createDataFrame(rows, "id long, x double, t string, b boolean, y int").repartition(4)
    got = {r["feature"]: r for r in stats.tree_power(df, ["x", "t", "b"], "y", F.col("id")).collect()}
    assert set(got) == {"x", "t", "b"}
    for name, at in (("x", 1), ("t", 2), ("b", 3)):
        scores = []
        for f in range(4):
            train = [(r[at], r[4]) for r in rows if r[0] % 4 != f and r[at] is not None]
            test = [(r[at], r[4]) for r in rows if r[0] % 4 == f and r[at] is not None]
            if name == "x":
                guess = grown(train)
            else:
                common = Counter(y for _, y in train)
                votes = {v: Counter(y for w, y in train if w == v) for v, _ in train}
                best = lambda c: min(c, key=lambda y: (-c[y], y))
                guess = lambda v: best(votes.get(v, common))  # noqa: B023, E731
            scores.append(weighted_f1([(y, guess(v)) for v, y in test]))
        assert got[name]["f1"] == pytest.approx(np.mean(scores)), name
        sizes = np.array(list(Counter(r[4] for r in rows if r[at] is not None).values()))
        top = sizes.max() / sizes.sum()
        assert got[name]["baseline"] == pytest.approx(max(2 * top * top / (1 + top), ((sizes / sizes.sum()) ** 2).sum()))


def test_columns_without_values_have_no_power(spark):
    df = spark.createDataFrame([(i, None, None, i % 2) for i in range(8)], "id long, x double, t string, y int")
    assert stats.tree_power(df, ["x", "t"], "y", F.col("id")).collect() == []
