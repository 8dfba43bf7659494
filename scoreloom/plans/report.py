"""All report tables for one model, as lazy DataFrames by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.exprs import q
from scoreloom.operators import encode, metrics, models, profile, report, stats
from scoreloom.params import ScoringParams


def model_report(
    splits: DataFrame,
    model: models.FittedModel,
    params: ScoringParams,
    features: Sequence[str] | None = None,
    dictionary: DataFrame | None = None,
    raw_columns: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Tables over the labelled, scored and banded splits of a two-class model.

    ``splits`` carries ``dataset`` and the score and band columns of the model.
    """
    y, obs, m = params.criterion_column, params.observation_date_column, model.name
    score, band = f"{m}_y_pred_prob", f"{m}_bands_predict_proba"
    features = list(features or model.features)
    train = splits.filter("dataset = 'train'")
    both = splits.filter(F.col("dataset").isin("train", "test"))
    grid = report.predictor_grid(train, features, y)
    grid = encode.feature_labels(grid, "feature")
    if model.coefficients:
        table = splits.sparkSession.createDataFrame(model.coefficients, "feature string, coef double, error double")
        grid = report.coefficient_join(grid, table)
    if dictionary is not None:
        grid = report.describe_features(grid, "mouchard_name", dictionary)
    tables = {
        "scope": report.scope_summary(splits, "dataset", obs, y, score),
        "metrics": metrics.binary_metrics(splits, y, f"{m}_y_pred", score, ["dataset"]),
        "cutoff": metrics.cutoff_metrics(splits, y, f"{m}_y_pred", score, by=["dataset"]),
        "criterion_by_period": report.criterion_by_period(splits, obs, y),
        "class_share_by_period": report.class_share_by_period(splits, obs, y),
        "correlations": stats.correlation_matrix(train, features),
        "target_correlations": stats.corr_with_target(train, features, y),
        "predictor_grid": grid,
        "band_rates": report.band_rates(train, band, y),
        "band_crosstab": report.crosstab_margins_long(both, ["dataset", y], band),
        "band_by_period": report.crosstab_values_long(splits, obs, band, y),
        "band_share_by_period": report.crosstab_normalized(splits, obs, band, "index"),
        "ecdf": metrics.ecdf_by_class(splits, y, score),
        "roc": metrics.roc_curve(both, y, score, ["dataset"]),
        "cap": metrics.cap_curve(both, y, score, ["dataset"]),
        "deciles": report.decile_rates(both, score, y, "dataset"),
        "accumulation_train": report.accumulation_points(train, score),
        "accumulation_test": report.accumulation_points(splits.filter("dataset = 'test'"), score),
        "band_profile": report.predictor_band_profile(train, features, band),
        "missing": profile.missing_report(profile.missing_table(splits)),
        "modality_evolution": report.modality_evolution(splits, obs, features, y),
    }
    if len(params.secondary_criterion_columns) == 2:
        a, b = params.secondary_criterion_columns
        tables["secondary_by_band"] = report.secondary_rate(train, band, a, b)
    for c in raw_columns:
        tables[f"raw_{c}"] = report.decile_rates(splits, c, y)
    return tables


def stacked(tables: dict[str, DataFrame]) -> DataFrame:
    """(report, row): every table as JSON rows under one schema."""
    parts = [
        df.select(F.lit(name).alias("report"), F.to_json(F.struct(*[q(c) for c in df.columns])).alias("row"))
        for name, df in tables.items()
    ]
    return report.union_splits(*parts)
