"""Model quality from grouped scores: curves, areas, confusion counts, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q
from scoreloom.operators.ordering import running_totals
from scoreloom.operators.profile import label_items, per_item


def _positive(y: Column) -> Column:
    return F.sum(F.when(y == 1, 1).otherwise(0))


def _negative(y: Column) -> Column:
    return F.sum(F.when(y == 1, 0).otherwise(1))


def score_counts(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Positives and negatives per distinct score with running totals."""
    rows = df.filter(q(y).isNotNull())
    return running_totals(
        rows, score, {"pos": _positive(q(y)), "neg": _negative(q(y))}, by, descending
    )


def roc_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first."""
    curve = score_counts(df, y, score, by, descending=True)
    return curve.select(
        *by,
        q(score).alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )


def auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL with a single class."""
    return score_counts(df, y, score, by).groupBy(*by).agg(_area().alias("auc"))


def _area() -> Column:
    """Aggregate over (pos, neg, cum_neg) per score: share of pairs ranked right, ties half."""
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    return F.try_divide(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def cap_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, population, captured): share of rows and of positives at or above each score."""
    curve = score_counts(df, y, score, by, descending=True)
    return curve.select(
        *by,
        q(score).alias("threshold"),
        ((F.col("cum_pos") + F.col("cum_neg")) / (F.col("all_pos") + F.col("all_neg"))).alias("population"),
        F.try_divide(F.col("cum_pos"), F.col("all_pos")).alias("captured"),
    )


def accuracy_ratio(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return auc(df, y, score, by).select(*by, (2 * F.col("auc") - 1).alias("accuracy_ratio"))


def one_vs_rest(df: DataFrame, y: str, scores: dict, carry: Sequence[str] = ()) -> DataFrame:
    """(class, y, score) per row and class; ``scores`` maps class value to its score column."""
    parts = [
        F.struct(
            F.lit(str(label)).alias("class"),
            F.when(q(y).isNotNull(), (q(y) == F.lit(label)).cast("int")).alias("y"),
            q(column).alias("score"),
        )
        for label, column in scores.items()
    ]
    return df.select(*carry, F.inline(F.array(*parts)))


def roc_multiclass(df: DataFrame, y: str, scores: dict) -> DataFrame:
    """ROC points of each class against the rest."""
    return roc_curve(one_vs_rest(df, y, scores), "y", "score", ["class"])


def ecdf_by_class(df: DataFrame, y: str, score: str) -> DataFrame:
    """Share of each class at or below every score it takes."""
    curve = running_totals(df.filter(q(y).isNotNull()), score, {"n": F.count("*")}, [y])
    return curve.select(
        y, q(score).alias("score"), (F.col("cum_n") / F.col("all_n")).alias("ecdf")
    )


def _rounded(value: Column, ok: Column, digits: int = 2) -> Column:
    return F.coalesce(F.when(ok, F.round(value, digits)), F.lit(0.0))


def binary_metrics(
    df: DataFrame, y: str, pred: str, score: str, by: Sequence[str] = (), digits: int = 2
) -> DataFrame:
    """One row per group: AUC, accuracy, precision, recall, F1, rates and volume.

    Confusion counts and the area come from the same (group, score) counts. A group with a
    single class has no AUC; all its metrics are 0.
    """
    by = list(by)
    truth, guess = q(y), F.round(q(pred))
    sums = {
        "n": F.count("*"),
        "pos": _positive(truth),
        "neg": _negative(truth),
        "tp": F.count_if((truth == 1) & (guess == 1)),
        "fp": F.count_if((truth == 0) & (guess == 1)),
        "fn": F.count_if((truth == 1) & (guess == 0)),
        "sum_y": F.sum(truth.cast("long")),
        "sum_pred": F.sum(guess.cast("long")),
    }
    counts = running_totals(df.filter(truth.isNotNull()), score, sums, by, cumulate=["neg"])
    both = counts.groupBy(*by).agg(
        _area().alias("auc"), *[F.sum(c).alias(c) for c in sums if c not in ("pos", "neg")]
    )
    ok = F.col("auc").isNotNull()
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return both.select(
        *by,
        _rounded((n - fp - fn) / n, ok, digits).alias("accuracy"),
        _rounded(F.col("auc"), ok, digits).alias("auc"),
        _rounded(F.try_divide(tp, tp + fp), ok, digits).alias("precision"),
        _rounded(F.try_divide(tp, tp + fn), ok, digits).alias("recall"),
        _rounded(F.try_divide(2 * tp, 2 * tp + fp + fn), ok, digits).alias("f1"),
        _rounded(F.col("sum_y") / n, ok, digits).alias("criterion_rate"),
        _rounded(F.col("sum_pred") / n, ok, digits).alias("predicted_rate"),
        F.when(ok, n).otherwise(0).alias("volume"),
    )


def cutoff_metrics(
    df: DataFrame, y: str, pred: str, score: str, cutoff: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Target rate among rows at or above the cut-off, and their predicted positives per row."""
    above = q(score) >= F.lit(cutoff)
    return df.groupBy(*by).agg(
        F.round(
            F.try_divide(
                F.sum(F.when(above, q(y))).cast("double"), F.count(F.when(above, q(y)))
            ),
            2,
        ).alias("precision_cutoff"),
        F.round(F.sum(F.when(above, q(pred))).cast("double") / F.count(q(y)), 2).alias("volume_cutoff"),
    )


def multiclass_metrics(
    df: DataFrame, y: str, pred: str, scores: dict, by: Sequence[str] = (), digits: int = 2
) -> DataFrame:
    """Macro precision, recall and F1 over present classes, macro one-vs-rest AUC, accuracy."""
    by = list(by)
    confusion = df.groupBy(*by, q(y).alias("y"), q(pred).alias("p")).agg(F.count("*").alias("n"))
    classes = confusion.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("given"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("given"),
                         F.lit(0).cast("long").alias("hit")),
            )
        ),
    )
    per_class = classes.groupBy(*by, "c").agg(
        F.sum("support").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hit, given, support = F.col("hit"), F.col("given"), F.col("support")
    averages = per_class.groupBy(*by).agg(
        F.sum("support").alias("volume"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        F.avg(ratio(hit, given)).alias("precision"),
        F.avg(ratio(hit, support)).alias("recall"),
        F.avg(ratio(2 * hit, given + support)).alias("f1"),
    )
    areas = auc(one_vs_rest(df, y, scores, by), "y", "score", [*by, "class"])
    area = areas.groupBy(*by).agg(
        F.when(F.count("auc") == F.count("*"), F.avg("auc")).alias("auc")
    )
    if by:
        both = averages.join(area, by, "left")
    else:
        both = averages.select("*", F.lit(area.first()["auc"]).cast("double").alias("auc"))
    ok = F.col("auc").isNotNull()
    return both.select(
        *by,
        *[_rounded(F.col(m), ok, digits).alias(m) for m in ("accuracy", "auc", "precision", "recall", "f1")],
        F.when(ok, F.col("volume")).otherwise(0).alias("volume"),
    )


def feature_means(df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """(feature, mean) for all features in one pass."""
    means = per_item(df, [(q(c),) for c in features], [F.avg("x0").alias(out)])
    return label_items(means, features, "feature")


def feature_drift(train: DataFrame, new: DataFrame, importances: DataFrame) -> DataFrame:
    """(feature, importances, mean_train, mean_predict, data_drift = |new / train - 1|).

    ``importances`` is the model's own feature list (columns, importances).
    """
    known = importances.select("columns", "importances").collect()  # one row per feature of a model; read once
    features = [r["columns"] for r in known]
    means = feature_means(train, features, "mean_train").join(
        feature_means(new, features, "mean_predict"), "feature"
    )
    ranked = train.sparkSession.createDataFrame([tuple(r) for r in known], "feature string, importances double")
    drift = F.abs(F.try_divide(F.col("mean_predict"), F.col("mean_train")) - 1)
    return ranked.join(means, "feature").select(
        "feature", "importances", "mean_train", "mean_predict", drift.alias("data_drift")
    )


def data_drift(train: DataFrame, new: DataFrame, importances: DataFrame, top: int = 5) -> DataFrame:
    """One row: mean drift and importance-weighted drift, over all features and the top ones."""
    table = feature_drift(train, new, importances)
    best = Window.orderBy(F.desc("importances"), "feature")  # one row per model feature
    ranked = table.withColumn("place", F.row_number().over(best))
    weighted = F.col("data_drift") * F.col("importances")

    def of_top(value: Column) -> Column:
        return F.when(F.col("place") <= top, value)

    return ranked.agg(
        F.round(F.avg("data_drift"), 2).alias("mean_data_drift"),
        F.round(F.sum(weighted) / F.sum("importances"), 2).alias("mean_w_data_drift"),
        F.round(F.avg(of_top(F.col("data_drift"))), 2).alias("mean_data_drift_top5"),
        F.round(
            F.sum(of_top(weighted)) / F.sum(of_top(F.col("importances"))), 2
        ).alias("mean_w_data_drift_top5"),
    )


