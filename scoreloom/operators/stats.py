"""Supervised statistics and the selections made from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import names
from scoreloom.functions.exprs import NUMERIC, flag, pearson, q
from scoreloom.operators.gram import cross_correlations
from scoreloom.operators.ordering import quantile_bin, quantile_edges, running_totals
from scoreloom.operators.prebins import FINE, fine_counts, met_counts
from scoreloom.operators.vectors import COLUMNS_PER_PASS, Batches, merged, vector_rows
from scoreloom.session import materialize

CORR_LOW, CORR_HIGH, CORR_TOP = 0.05, 0.4, 100
NARROW = 12  # up to here one aggregate list is the cheaper plan, beyond it blocks are multiplied


def _unfold(row: DataFrame, labels: Sequence[Sequence[str]], fields: Sequence[str], value: str) -> DataFrame:
    pairs = [
        F.struct(*[F.lit(t).alias(f) for t, f in zip(texts, fields)], F.col(f"r{i}").alias(value))
        for i, texts in enumerate(labels)
    ]
    return row.select(F.inline(F.array(*pairs)))


def _named(numbers: str, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in labels]), F.col(numbers).cast("int") + 1)


def corr_with_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, r): Pearson correlation with the target over complete pairs, NULL if constant; one scan."""
    if len(features) <= NARROW:
        row = df.agg(*[pearson(q(c), q(target)).alias(f"r{i}") for i, c in enumerate(features)])
        return _unfold(row, [(c,) for c in features], ["feature"], "r")
    found = cross_correlations(df, list(features), [target])
    return found.select(_named("i", features).alias("feature"), "r")


def top_correlated(correlations: DataFrame, k: int = CORR_TOP) -> DataFrame:
    """The k features with the largest absolute correlation."""
    return (
        correlations.filter("r is not null")
        .withColumn("abs_r", F.abs("r"))
        .orderBy(F.desc("abs_r"), "feature")
        .limit(k)
    )


def correlation_filter(
    correlations: DataFrame,
    keep: Sequence[str] = (),
    low: float = CORR_LOW,
    high: float = CORR_HIGH,
    top: int = CORR_TOP,
) -> DataFrame:
    """Features worth keeping: low < |r| < high, at most ``top`` of them.

    The upper limit guards against leakage of the target. Columns cut by either limit come back
    when a name in ``keep`` equals or contains theirs.
    """
    r = F.abs("r")
    inside = correlations.filter((r > low) & (r < high))
    best = inside.orderBy(F.desc(r), "feature").limit(top).select("feature", "r")
    if not keep:
        return best
    named = F.lit(False)
    for name in keep:
        named = named | F.lit(name).contains(F.col("feature"))
    returned = correlations.filter(((r <= low) | (r >= high)) & named).select("feature", "r")
    return best.unionByName(returned)


def select_by_correlation(
    df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()
) -> list[str]:
    chosen = correlation_filter(corr_with_target(df, features, target), keep).collect()
    found = {r["feature"] for r in chosen}
    if not found:
        raise ValueError("no feature correlates with the target inside the accepted range")
    return [c for c in features if c in found]


def correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(a, b, r) for every ordered pair; each unordered pair is computed once, all of them in one scan."""
    features = list(features)
    found = cross_correlations(df, features, features)
    half = found.select(_named("i", features).alias("a"), _named("j", features).alias("b"), "r")
    both = F.when(
        F.col("a") == F.col("b"), F.array(F.struct("a", "b", "r"))
    ).otherwise(
        F.array(
            F.struct("a", "b", "r"),
            F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"),
        )
    )
    return half.select(F.inline(both))


def raw_correlation_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Correlations among the raw columns from which the features were made."""
    return correlation_matrix(df, names.raw_inputs(features))


def predictive_power(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: Column,
    bins: int = 10,
    folds: int = 4,
) -> DataFrame:
    """(feature, baseline, f1, score): how far one binned feature lifts weighted F1 above naive.

    Rows of a fold are predicted by the majority class of their bin in the other folds. All
    features share one aggregation to (feature, fold, bin, class) counts; what follows runs on
    those counts.
    """
    narrow = df.filter(q(target).isNotNull()).select(
        F.pmod(fold, F.lit(folds)).alias("fold"), q(target).alias("y"), *[q(c) for c in features]
    )
    narrow = materialize(narrow, "power")  # edges and counts both read it
    edges = quantile_edges(narrow, features, bins, stored=True)
    binned = narrow.select(
        "fold",
        "y",
        *[F.coalesce(quantile_bin(c, edges[c]), F.lit(-1)).alias(f"_b{i}") for i, c in enumerate(features)],
    )
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.col(f"_b{i}").alias("bin")) for i, c in enumerate(features)
    ]
    counts = (
        binned.select("fold", "y", F.inline(F.array(*pairs)))
        .groupBy("feature", "fold", "bin", "y")
        .agg(F.count("*").alias("n"))
    )
    counts = materialize(counts, "power")  # small, and read several times below
    # every fold of a (bin, class) needs the count of the other folds, present in the fold or not
    per_class = counts.groupBy("feature", "bin", "y").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("fold", "n"))).alias("own")
    )
    spread = per_class.select(
        "feature", "bin", "y", "total", "own", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    ).select(
        "feature",
        "bin",
        "fold",
        "y",
        (F.col("total") - F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0))).alias("outside"),
    )
    seen = spread.filter("outside > 0")
    vote = seen.groupBy("feature", "bin", "fold").agg(
        F.min_by("y", F.struct(-F.col("outside"), "y")).alias("pred")
    )
    overall = seen.groupBy("feature", "fold", "y").agg(F.sum("outside").alias("outside"))
    fallback = overall.groupBy("feature", "fold").agg(
        F.min_by("y", F.struct(-F.col("outside"), "y")).alias("common")
    )
    predicted = (
        counts.join(vote, ["feature", "bin", "fold"], "left")
        .join(fallback, ["feature", "fold"], "left")
        .select("feature", "y", F.coalesce("pred", "common").alias("pred"), "n")
    )
    f1 = _weighted_f1(predicted.groupBy("feature", "y", "pred").agg(F.sum("n").alias("n")))
    # naive guesses: always the most common class, or classes drawn at their own rates
    sizes = counts.groupBy("feature", "y").agg(F.sum("n").alias("n"))
    share = F.max("n") / F.sum("n")
    drawn = F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))
    naive = sizes.groupBy("feature").agg(
        F.greatest(2 * share * share / (1 + share), drawn).alias("baseline")
    )
    joined = f1.join(naive, "feature")
    lift = F.try_divide(F.col("f1") - F.col("baseline"), 1 - F.col("baseline"))
    return joined.select("feature", "baseline", "f1", F.greatest(lift, F.lit(0.0)).alias("score"))


def _weighted_f1(confusion: DataFrame) -> DataFrame:
    """Class-weighted F1 per feature from (feature, y, pred, n)."""
    actual = confusion.groupBy("feature", F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    given = confusion.groupBy("feature", F.col("pred").alias("c")).agg(F.sum("n").alias("given"))
    right = (
        confusion.filter("y = pred").groupBy("feature", F.col("y").alias("c")).agg(F.sum("n").alias("hit"))
    )
    per_class = actual.join(given, ["feature", "c"], "left").join(right, ["feature", "c"], "left")
    hit = F.coalesce("hit", F.lit(0))
    f1 = 2 * hit / (F.col("support") + F.coalesce("given", F.lit(0)))
    return per_class.groupBy("feature").agg(
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1")
    )


def _naive_f1(counts: np.ndarray) -> float:
    """The better weighted F1 of two guesses: always the most frequent class, or classes drawn at their own rates."""
    share = counts / counts.sum()
    top = share.max()
    return float(max(2 * top * top / (1 + top), (share**2).sum()))


def _fold_f1(confusion: np.ndarray) -> float:
    """F1 weighted by class size, from a confusion matrix (class x guess)."""
    support, given, hit = confusion.sum(axis=1), confusion.sum(axis=0), np.diag(confusion)
    f1 = np.divide(2 * hit, support + given, out=np.zeros(len(hit)), where=support + given > 0)
    return float((f1 * support).sum() / support.sum())


def _value_votes(counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Confusion matrix of each fold for one feature; ``counts`` has shape (values, folds, classes).

    The tree of a fold is grown on the other folds until its leaves hold one class or one value, so a value is guessed by the
    class that is most frequent there (the first of equals), one that the others lack by its neighbour on the same side of the
    middle between two.
    """
    total, out = counts.sum(axis=1), []
    for f in range(counts.shape[1]):
        own = counts[:, f]
        rest = total - own
        known = np.flatnonzero(rest.sum(axis=1) > 0)
        if not len(known) or not own.sum():
            continue
        middles = (high[known[:-1]] + low[known[1:]]) / 2
        guess = rest[known].argmax(axis=1)[np.searchsorted(middles, low, "left")]
        confusion = np.zeros((counts.shape[2],) * 2)
        np.add.at(confusion.T, guess, own)
        out.append(confusion)
    return out


def _power_row(confusions: Sequence[np.ndarray], classes: np.ndarray) -> tuple[float, float, float]:
    """(baseline, f1, score) from each fold's confusion matrix and the sizes of the classes."""
    f1, baseline = float(np.mean([_fold_f1(c) for c in confusions])), _naive_f1(classes)
    return baseline, f1, max(0.0, (f1 - baseline) / (1 - baseline)) if baseline < 1 else 0.0


def tree_power(df: DataFrame, features: Sequence[str], target: str, fold: Column, folds: int = 4, fine: int = FINE) -> DataFrame:
    """(feature, baseline, f1, score): how far a tree on one feature alone lifts cross-validated weighted F1 above naive guesses.

    Trees of all features and folds come from one table of counts by (feature, value, fold, class): a fold's training counts are
    the total less its own. Numbers of more than ``fine`` values are counted in that many quantile groups; texts and flags are
    counted by value, and a text that the other folds lack is guessed by their most frequent class. Rows lacking the feature take no part.
    """
    seen = df.select(q(target)).filter(q(target).isNotNull()).distinct().collect()
    classes = sorted(r[0] for r in seen)
    numbers = [c for c in features if isinstance(df.schema[c].dataType, (*NUMERIC, T.ByteType, T.DecimalType))]
    texts = [c for c in features if c not in numbers]
    k = len(classes)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), q(target)) - 1
    code = (F.pmod(fold, F.lit(folds)) * k + place).cast("int")
    narrow = df.filter(q(target).isNotNull()).select(code.alias("_code"), *[q(c) for c in features])
    narrow = materialize(narrow, "power")
    tables = [_text_power(narrow, texts, folds, k)] if texts else []
    for start in range(0, len(numbers), COLUMNS_PER_PASS):
        part = numbers[start : start + COLUMNS_PER_PASS]

        def finish(key: tuple, vector: np.ndarray) -> Iterator[tuple]:
            n = len(vector) // (folds * k + 2)
            counts = vector[: n * folds * k].reshape(n, folds, k)
            low, high = vector[n * folds * k : -n], vector[-n:]
            used = counts.sum(axis=(1, 2)) > 0
            confusions = _value_votes(counts[used], low[used], high[used])
            if confusions:
                yield key[0], *_power_row(confusions, counts.sum(axis=(0, 1)))

        counted = fine_counts(narrow, part, "_code", list(range(folds * k)), fine)
        found = merged(counted, ["i"], met_counts(folds * k), finish, "i long, baseline double, f1 double, score double")
        tables.append(found.select(_named("i", part).alias("feature"), "baseline", "f1", "score"))
    return reduce(DataFrame.unionByName, tables)


def _text_power(narrow: DataFrame, texts: Sequence[str], folds: int, k: int) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("value")) for i, c in enumerate(texts)]
    cells = narrow.select("_code", F.inline(F.array(*pairs))).filter("value is not null")
    counts = materialize(cells.groupBy("i", "value", "_code").agg(F.count(F.lit(1)).alias("n")), "text-counts")
    totals = np.zeros((len(texts), folds, k))
    for r in counts.groupBy("i", "_code").agg(F.sum("n").alias("n")).collect():
        totals[r["i"], r["_code"] // k, r["_code"] % k] = r["n"]
    common = (totals.sum(axis=1, keepdims=True) - totals).argmax(axis=2)
    per_value = counts.groupBy("i", "value").agg(F.collect_list(F.struct("_code", "n")).alias("cells"))

    def vote(batches: Batches) -> Batches:
        sums = np.zeros((len(texts), folds, k, k))
        for batch in batches:
            for i, found in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                own = np.zeros((folds, k))
                for cell in found:
                    own[cell["_code"] // k, cell["_code"] % k] = cell["n"]
                rest = own.sum(axis=0) - own
                guess = np.where(rest.sum(axis=1) > 0, rest.argmax(axis=1), common[i])
                for f in range(folds):
                    sums[i, f, :, guess[f]] += own[f]
        yield vector_rows([(i,) for i in range(len(texts))], list(sums.reshape(len(texts), -1)), ["i"])

    def finish(key: tuple, total: np.ndarray) -> Iterator[tuple]:
        confusions = [c for c in total.reshape(folds, k, k) if c.sum()]
        if confusions:
            yield key[0], *_power_row(confusions, np.sum(confusions, axis=(0, 2)))

    parts = per_value.select("i", "cells").mapInArrow(vote, "i long, vector binary")
    found = merged(parts, ["i"], np.add, finish, "i long, baseline double, f1 double, score double")
    return found.select(_named("i", texts).alias("feature"), "baseline", "f1", "score")


def select_by_predictive_power(
    power: DataFrame, threshold: float = 0.05, top: int = 100
) -> DataFrame:
    return power.filter(F.col("score") > threshold).orderBy(F.desc("score"), "feature").limit(top)


def top_features(
    importances: DataFrame,
    k: int = 30,
    exclude: Sequence[str] = (),
    low: float = 0.0,
    high: float = 0.95,
) -> DataFrame:
    """The k most important features strictly inside (low, high), less the excluded ones."""
    best = (
        importances.filter((F.col("importances") > low) & (F.col("importances") < high))
        .orderBy(F.desc("importances"), "columns")
        .limit(k)
    )
    return best.filter(~F.col("columns").isin(list(exclude))) if exclude else best


def stump_split(df: DataFrame, column: str, target: str) -> dict | None:
    """Best single cut of a column by Gini impurity, from per-value counts.

    Returns the cut (midpoint), the class of each side and the largest value on the class-0 side.
    """
    y = q(target)
    curve = running_totals(
        df.filter(y.isNotNull()), column, {"n": F.count("*"), "p": F.sum(y.cast("long"))}
    )
    n, p, all_n, all_p = (F.col(c) for c in ("cum_n", "cum_p", "all_n", "all_p"))
    rest_n, rest_p = all_n - n, all_p - p
    impurity = 2 * p * (n - p) / n + F.try_divide(2 * rest_p * (rest_n - rest_p), rest_n)
    best = (
        curve.filter(n < all_n)
        .select(
            q(column).alias("x"), n.alias("n"), p.alias("p"), all_n.alias("N"), all_p.alias("P"),
            impurity.alias("impurity"),
        )
        .orderBy("impurity", "x")
        .limit(1)
        .collect()
    )
    if not best:
        return None
    left = best[0]
    above = curve.filter(q(column) > F.lit(left["x"])).agg(
        F.min(q(column)).alias("lo"), F.max(q(column)).alias("hi")
    ).first()
    left_class = int(2 * left["p"] > left["n"])
    right_class = int(2 * (left["P"] - left["p"]) > left["N"] - left["n"])
    return {
        "cut": (left["x"] + above["lo"]) / 2,
        "left": left_class,
        "right": right_class,
        "zero_max": left["x"] if left_class == 0 else above["hi"],
    }


def stump_feature(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Add ``<col>_tree_<largest class-0 value>``: side of the best cut, as its majority class.

    A column whose two sides have the same majority gets none.
    """
    added = []
    narrow = materialize(df.select(*[q(c) for c in names.unique([target, *columns])]), "stumps")
    for c in columns:
        split = stump_split(narrow, c, target)
        if split is None or split["left"] == split["right"]:
            continue
        low = q(c) <= F.lit(split["cut"])
        one = low if split["left"] == 1 else ~low
        added.append(flag(one).alias(f"{c}_tree_{round(float(split['zero_max']), 4)}"))
    return df.select("*", *added)
