"""Boosted, tree and logistic models, fitted twice with a feature cut in between."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q
from scoreloom.operators import boosting, metrics
from scoreloom.operators import forest as forests
from scoreloom.operators.encode import score_bands
from scoreloom.operators.ordering import quantile_bin, quantile_edges
from scoreloom.operators.stats import top_features
from scoreloom.session import materialize

# Training settings of each model.
BOOST_ROUNDS = 100
BOOST_DEPTH = 6
LEARNING_RATE = 0.01
ROW_SHARE = 0.5
COLUMN_SHARE = 0.1
FOREST_TREES = 300
FOREST_DEPTH = 5
TREE_DEPTH = 4
BAND_DEPTH = 3
SEED = 42
MAX_FEATURES = 30
LR_ERROR = 0.01
LR_COEFFICIENT = 0.00005

VECTOR, LABEL = "_features", "_label"


def _vector(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR)


def _training_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features as doubles under positional names: Spark ML cannot read names with dots."""
    rows = df.filter(q(target).isNotNull())
    return rows.select(
        q(target).cast("double").alias(LABEL),
        *[q(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
    )


def _even_rows(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    # stored, because Spark joins small partitions of a shuffle for a written table, but not for a cached one
    return materialize(_training_rows(df, features, target).hint("rebalance"), "training")


@contextmanager
def _vectors(df: DataFrame, features: Sequence[str], target: str, assembler: VectorAssembler, even: bool = False) -> Iterator[DataFrame]:
    """Labels and vectors of the training rows, held while a model is fitted, because fits read them several times.

    ``even`` deals the rows evenly to the tasks: stored tables of few files leave most tasks without rows.
    """
    if even:
        yield assembler.transform(_even_rows(df, features, target)).select(VECTOR, LABEL)
        return
    held = _training_rows(df, features, target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield assembler.transform(held).select(VECTOR, LABEL)
    finally:
        held.unpersist()


def boosted(**settings) -> boosting.Settings:
    base = dict(
        rounds=BOOST_ROUNDS, depth=BOOST_DEPTH, rate=LEARNING_RATE, row_share=ROW_SHARE, column_share=COLUMN_SHARE, seed=SEED
    )
    return boosting.Settings(**{**base, **settings})


def forest(**settings) -> RandomForestClassifier:
    base = dict(
        featuresCol=VECTOR,
        labelCol=LABEL,
        numTrees=FOREST_TREES,
        maxDepth=FOREST_DEPTH,
        bootstrap=False,
        seed=SEED,
    )
    return RandomForestClassifier(**{**base, **settings})


def single_tree(**settings) -> DecisionTreeClassifier:
    base = dict(featuresCol=VECTOR, labelCol=LABEL, maxDepth=TREE_DEPTH, seed=SEED)
    return DecisionTreeClassifier(**{**base, **settings})


ESTIMATORS = {"xgb": boosted, "rf": forest, "dt": single_tree}


@dataclass
class FittedModel:
    """A fitted model with the ordered names of its features."""

    name: str
    features: list[str]
    models: list[PipelineModel]
    classes: list[str] = field(default_factory=list)  # more than two
    importances: dict[str, float] = field(default_factory=dict)
    coefficients: list[dict] = field(default_factory=list)
    trees: boosting.Boosted | forests.Forest | None = None  # boosted trees and forests stand for themselves, without ``models``

    # -- scoring -----------------------------------------------------------------------------

    def missing(self, df: DataFrame) -> list[str]:
        return [c for c in self.features if c not in df.columns]

    def _with_inputs(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[q(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])

    def _without_inputs(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"f{i}" for i in range(len(self.features))])

    def probability(self, df: DataFrame, out: str) -> DataFrame:
        """Add the probability of class 1."""
        if self.trees is not None:
            return self.trees.score(df, {1: out})
        scored = self.models[0].transform(self._with_inputs(df))
        if self.name == "lr":
            scored = scored.withColumn(out, F.col("prediction")).drop(VECTOR, "prediction")
        else:
            value = vector_to_array("probability")[1]
            scored = scored.withColumn(out, value).drop(VECTOR, "rawPrediction", "probability", "prediction")
        return self._without_inputs(scored)

    def score(self, df: DataFrame, prefix: str | None = None) -> DataFrame:
        """Add ``<m>_y_pred`` and ``<m>_y_pred_prob``."""
        if self.classes:
            raise ValueError(f"{self.name} knows {len(self.classes)} classes; use score_multiclass")
        m = prefix or self.name
        guess = F.when(q(f"{m}_y_pred_prob") > 0.5, 1).otherwise(0)
        return self.probability(df, f"{m}_y_pred_prob").withColumn(f"{m}_y_pred", guess)

    def probability_columns(self) -> dict[int, str]:
        return {i: f"proba_for_criterion_class_{c}" for i, c in enumerate(self.classes)}

    def score_multiclass(self, df: DataFrame) -> DataFrame:
        """Add one probability per class, summing to 1, and the code of the most likely class."""
        names = self.probability_columns()
        scored = self.trees.score(df, names)
        shares = F.array(*[q(names[i]) for i in range(len(self.classes))])
        best = F.array_position(shares, F.array_max(shares)) - 1
        return scored.withColumn(f"{self.name}_y_pred", best.cast("int"))

    # -- persistence -------------------------------------------------------------------------

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        spark = spark or SparkSession.active()
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model-{i}")
        doc = json.dumps(
            {
                "name": self.name,
                "features": self.features,
                "classes": self.classes,
                "importances": self.importances,
                "coefficients": self.coefficients,
                "trees": self.trees.to_json() if self.trees is not None else None,
                "n_models": len(self.models),
            }
        )
        spark.createDataFrame([(doc,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedModel":
        doc = json.loads(spark.read.text(f"{path}/about").first()[0])
        trees, count = doc.pop("trees"), doc.pop("n_models")
        models = [PipelineModel.load(f"{path}/model-{i}") for i in range(count)]
        kind = forests.Forest if trees and "forest" in json.loads(trees) else boosting.Boosted
        return cls(models=models, trees=kind.from_json(trees) if trees else None, **doc)

    def importance_table(self, spark: SparkSession) -> DataFrame:
        """(columns, importances), most important first."""
        rows = sorted(self.importances.items(), key=lambda kv: (-kv[1], kv[0]))
        return spark.createDataFrame(rows, "columns string, importances double")


def fit_model(
    df: DataFrame, features: Sequence[str], target: str, name: str, estimator=None
) -> FittedModel:
    """Fit one classifier on 0/1 ``target``; ``estimator`` holds settings of boosting, or is a Spark ML classifier."""
    features = list(features)
    settings = estimator or ESTIMATORS[name]()
    if isinstance(settings, boosting.Settings):
        return _of_trees(boosting.fit(df, features, target, 2, settings)[-1])
    is_forest = isinstance(settings, RandomForestClassifier)
    if is_forest and forests.grows(settings):
        trees, weights = forests.fit(_even_rows(df, features, target), features, LABEL, settings)
        return FittedModel(name, features, [], importances=weights, trees=trees)
    assembler = _vector([f"f{i}" for i in range(len(features))])
    with _vectors(df, features, target, assembler, even=is_forest) as rows:
        fitted = settings.fit(rows)
    weights = fitted.featureImportances.toArray()
    return FittedModel(
        name,
        features,
        # a copy has no training summary; a forest's holds the session, which tasks cannot be sent once it has observed a query
        [PipelineModel([assembler, fitted.copy()])],
        importances={c: float(w) for c, w in zip(features, weights)},
    )


def _of_trees(trees: boosting.Boosted, classes: Sequence[str] = ()) -> FittedModel:
    return FittedModel("xgb", trees.features, [], list(map(str, classes)), trees.importances(), trees=trees)


def fit_multiclass(
    df: DataFrame, features: Sequence[str], target: str, classes: Sequence[str], estimator: boosting.Settings | None = None
) -> FittedModel:
    """Boosted trees for k encoded classes, grown together."""
    return _of_trees(boosting.fit(df, features, target, len(classes), estimator or boosted())[-1], classes)


def two_pass_fit(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    name: str,
    k: int = MAX_FEATURES,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    classes: Sequence[str] = (),
    estimator=None,
) -> FittedModel:
    """Fit, keep the most important features, fit again on those.

    ``include`` replaces the candidate list, ``exclude`` removes names after ranking.
    """
    candidates = list(include) or list(features)

    def fit(columns: Sequence[str]) -> FittedModel:
        if classes:
            return fit_multiclass(df, columns, target, classes, estimator)
        return fit_model(df, columns, target, name, estimator)

    first = fit(candidates)
    table = first.importance_table(df.sparkSession)
    chosen = [r["columns"] for r in top_features(table, k, exclude).collect()]
    if not chosen:
        raise ValueError("no feature has an importance inside the accepted range")
    second = fit(chosen)
    # features are ranked by the first fit; the second decides how they are used
    second.importances = {c: first.importances[c] for c in chosen}
    return second


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    include: Sequence[str] = (),
    error: float = LR_ERROR,
    coefficient: float = LR_COEFFICIENT,
) -> FittedModel:
    """Logistic regression; weak terms (p >= 0.01 or a tiny coefficient) are dropped and it is refitted."""

    def fit(columns: Sequence[str]) -> FittedModel:
        assembler = _vector([f"f{i}" for i in range(len(columns))])
        rows = assembler.transform(_training_rows(df, columns, target))
        glm = GeneralizedLinearRegression(
            family="binomial", link="logit", featuresCol=VECTOR, labelCol=LABEL, maxIter=50
        )
        fitted = glm.fit(rows.select(VECTOR, LABEL))
        terms = [*columns, "const"]
        values = [*map(float, fitted.coefficients.toArray()), float(fitted.intercept)]
        table = [
            {"feature": t, "coef": v, "error": float(p)}
            for t, v, p in zip(terms, values, fitted.summary.pValues)
        ]
        return FittedModel("lr", list(columns), [PipelineModel([assembler, fitted])], coefficients=table)

    model = fit(list(features))
    strong = [
        r["feature"]
        for r in model.coefficients
        if r["feature"] != "const"
        and (r["feature"] in include or (r["error"] < error and abs(r["coef"]) > coefficient))
    ]
    return fit(strong) if strong and strong != model.features else model


def learning_curve(df: DataFrame, model: FittedModel, target: str, dataset: str = "dataset") -> DataFrame:
    """(dataset, round, loss, error): log loss and share of wrong classes after every round on each split, in one scan."""
    return boosting.staged_losses(df, model.trees, target, dataset)


# -- what is derived from scores ---------------------------------------------------------------


def score_deciles(df: DataFrame, columns: dict[str, str], bins: int = 10) -> DataFrame:
    """Add the quantile bin of each score column; ``columns`` maps score to output name."""
    edges = quantile_edges(df, list(columns), bins)
    return df.select("*", *[quantile_bin(c, edges[c]).alias(out) for c, out in columns.items()])


def tree_bands(df: DataFrame, score: str, target: str, out: str, leaf: str | None = None) -> DataFrame:
    """Bands from a shallow tree on the score alone: the predicted class, and the leaf on request."""
    assembler = _vector(["f0"])
    tree = single_tree(maxDepth=BAND_DEPTH, leafCol="_leaf")
    with _vectors(df, [score], target, assembler) as rows:
        fitted = tree.fit(rows)
    inputs = df.select("*", q(score).cast("double").alias("f0"))
    banded = fitted.transform(assembler.transform(inputs))
    extra = [F.col("_leaf").cast("int").alias(leaf)] if leaf else []
    return banded.select(*[q(c) for c in df.columns], F.col("prediction").cast("int").alias(out), *extra)


def banded(
    df: DataFrame, m: str, target: str, cut_offs: Sequence[float] = ()
) -> DataFrame:
    """Add ``<m>_bands_predict`` and ``<m>_bands_predict_proba`` by cut-offs, or by shallow trees."""
    for source, out in ((f"{m}_y_pred", f"{m}_bands_predict"), (f"{m}_y_pred_prob", f"{m}_bands_predict_proba")):
        df = score_bands(df, source, cut_offs, out) if cut_offs else tree_bands(df, source, target, out)
    return df


def validate_splits(
    df: DataFrame, model: FittedModel, target: str, dataset: str = "dataset"
) -> DataFrame:
    """Metrics of every split in one grouped pass over the labelled, scored frame.

    Scores are written once, as a narrow table, because the metrics read them more than once and
    scoring costs far more than reading.
    """
    base = df.select(dataset, target, *[q(c) for c in model.features if c not in (dataset, target)])
    if model.classes:
        probabilities = list(model.probability_columns().values())
        scored = model.score_multiclass(base).select(dataset, target, f"{model.name}_y_pred", *probabilities)
        scored = materialize(scored, "scores")
        table = metrics.multiclass_metrics(
            scored, target, f"{model.name}_y_pred", model.probability_columns(), [dataset]
        )
    else:
        m = model.name
        scored = materialize(
            model.score(base).select(dataset, target, f"{m}_y_pred", f"{m}_y_pred_prob"), "scores"
        )
        table = metrics.binary_metrics(scored, target, f"{m}_y_pred", f"{m}_y_pred_prob", [dataset])
        at = metrics.cutoff_metrics(scored, target, f"{m}_y_pred", f"{m}_y_pred_prob", by=[dataset])
        table = table.join(at, dataset)
    return table.select(
        "*", F.lit(model.name).alias("method"), F.lit(len(model.features)).alias("nb_features")
    )


def batch_predict(df: DataFrame, models: Sequence[FittedModel], digits: int = 5) -> DataFrame:
    """Add ``predict_<m>`` for each model; 0 for a model some of whose features are missing.

    A model of more than two classes adds ``predict_<m>_<class>`` for each class, normalised over the classes, and the most
    likely class's code ``predict_<m>``.
    """
    for model in models:
        out = f"predict_{model.name}"
        shares = {f"{out}_{model.classes[i]}": c for i, c in model.probability_columns().items()}
        if model.missing(df):
            df = df.withColumns({name: F.lit(0.0) for name in shares} | {out: F.lit(0 if shares else 0.0)})
            continue
        if shares:
            scored = model.score_multiclass(df)
            df = scored.select(
                *[q(c) for c in df.columns],
                *[F.round(q(c), digits).alias(name) for name, c in shares.items()],
                q(f"{model.name}_y_pred").alias(out),
            )
            continue
        df = model.probability(df, "_p").select(*[q(c) for c in df.columns], F.round("_p", digits).alias(out))
    return df


def recursive_elimination(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: Column,
    keep: int | None = None,
    folds: int = 5,
    rounds: int = 10,
    classes: int = 2,
) -> DataFrame:
    """(step, nb_features, f1_macro, best, features): halve the features by importance until ``keep`` are left.

    Each step fits one model without each fold and one on all rows in the same passes, over groups that are cut once. It is
    scored by macro F1 of the rows by the models that have not seen them; ``best`` marks the highest, the later step of equals.
    """
    least = keep or max(1, min(100, len(features) // 2))
    settings = boosted(rounds=rounds)
    narrow = df.select(F.pmod(fold, F.lit(folds)).cast("int").alias("_fold"), q(target).alias("_target"), *[q(c) for c in features])
    # dealt evenly once, for all steps
    rows = materialize(narrow.filter("_target is not null").hint("rebalance"), "elimination")
    cuts = boosting.feature_cuts(rows, list(features), settings)
    current, steps = list(features), []
    while True:
        kept = rows.select("_fold", "_target", *[q(c) for c in current])
        whole, tested = boosting.fit_and_test(kept, current, "_target", classes, settings, F.col("_fold"), folds, cuts)
        steps.append([len(steps), len(current), _macro_f1(tested), current])
        if len(current) <= least:
            break
        weights = whole.importances()
        order = sorted(current, key=lambda c: (-weights[c], current.index(c)))
        current = order[: max(least, len(current) // 2)]
    best = max(steps, key=lambda s: (s[2], s[0]))
    return df.sparkSession.createDataFrame(
        [(n, k, f1, s is best, names) for s in steps for n, k, f1, names in [s]],
        "step int, nb_features int, f1_macro double, best boolean, features array<string>",
    )


def best_features(steps: DataFrame) -> list[str]:
    """The features of the best step of an elimination."""
    return list(steps.filter("best").first()["features"])


def _macro_f1(tested: np.ndarray) -> float:
    """From the number of rows by class and predicted class."""
    total = 0.0
    for c in range(len(tested)):
        hit = int(tested[c, c])
        wrong = int(tested[c].sum() + tested[:, c].sum()) - 2 * hit
        total += 2 * hit / (2 * hit + wrong) if hit + wrong else 0.0
    return total / len(tested)
