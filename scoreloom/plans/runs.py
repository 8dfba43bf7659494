"""Flows from the parameter document to files: what one run writes, the next reads, in any later session.

A run folder holds ``full`` and ``working`` (prepared tables), ``features``, ``plan``, and after training ``splits``,
``models/<kind>``, ``metrics`` and ``importances/<kind>``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.exprs import key_hash
from scoreloom.operators import models
from scoreloom.params import ScoringParams
from scoreloom.plans.predict import Predicted, predict
from scoreloom.plans.prepare import Prepared, PreparationPlan, SideTable, join_side_tables, prepare
from scoreloom.plans.train import Trained, train
from scoreloom.sources import readers, sinks


def load_sides(spark: SparkSession, params: ScoringParams) -> dict[str, SideTable]:
    """The side tables of the document: file name to a table joined on the listed columns, ordered by all its columns."""
    names = {path.rstrip("/").rsplit("/", 1)[-1]: path for path in params.additional_tables}
    tables = readers.side_tables(spark, names)
    return {n: SideTable(df, params.additional_tables[names[n]], sorted(df.columns)) for n, df in tables.items()}


def prepare_run(
    spark: SparkSession, params: ScoringParams, key: Sequence[str], folder: str, bucket: Column | None = None
) -> Prepared:
    """Load the main and side tables, prepare them, and write tables, features and plan."""
    main = readers.load_table(spark, params.main_table)
    prepared = prepare(main, params, key, load_sides(spark, params), bucket)
    sinks.write_prepared(prepared.full, f"{folder}/full")
    sinks.write_prepared(prepared.working, f"{folder}/working")
    sinks.write_feature_list(spark, prepared.features, f"{folder}/features")
    prepared.plan.save(spark, f"{folder}/plan")
    return prepared


def train_run(
    spark: SparkSession,
    params: ScoringParams,
    key: Sequence[str],
    folder: str,
    kinds: Sequence[str] = ("xgb", "rf", "dt"),
    bucket: Column | None = None,
) -> Trained:
    """Fit and validate on the prepared tables of the folder; write splits, models, metrics and importances."""
    full, working = (sinks.read_prepared(spark, f"{folder}/{name}") for name in ("full", "working"))
    features = sinks.read_feature_list(spark, f"{folder}/features")
    trained = train(full, features, params, key_hash(*key) if bucket is None else bucket, kinds, working)
    sinks.write_splits(trained.labelled, f"{folder}/splits")
    sinks.write_report(trained.metrics, f"{folder}/metrics")
    for kind, model in trained.models.items():
        model.save(f"{folder}/models/{kind}")
        if kind in trained.importances:
            sinks.write_report(trained.importances[kind], f"{folder}/importances/{kind}")
    return trained


def predict_run(
    spark: SparkSession,
    params: ScoringParams,
    rows: DataFrame,
    folder: str,
    kinds: Sequence[str],
    out: str,
    columns: Sequence[str],
    constants: Mapping[str, Any] | None = None,
) -> Predicted:
    """Score new main-table rows with the stored plan and models and write the listed columns and all predictions."""
    plan = PreparationPlan.load(spark, f"{folder}/plan")
    fitted = [models.FittedModel.load(spark, f"{folder}/models/{kind}") for kind in kinds]
    joined = join_side_tables(rows, load_sides(spark, params), params.observation_date_column)
    training = spark.read.parquet(f"{folder}/splits").filter(F.col("dataset") == "train")
    result = predict(joined, plan, fitted, params, training, constants)
    scores = [c for c in result.predictions.columns if c.startswith("predict_")]
    sinks.write_predictions(result.predictions, out, [*columns, *scores])
    return result
