"""From a main table and side tables to a modelling table: clean, engineer, bin, select.

Fitting learns every data-dependent choice once (which columns, fill values, levels, splits) and
keeps them in a ``PreparationPlan``, which can be stored, so that new data gets exactly the same columns on another day.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import names
from scoreloom.functions.exprs import key_hash, nan_to_null, q
from scoreloom.operators import aggregates, cleaning, encode, filters, profile, projection, sampling, stats
from scoreloom.operators.binning import OptimalBins, require_two_valued
from scoreloom.params import ScoringParams
from scoreloom.plans.hooks import run_hook
from scoreloom.session import materialize, wide_projections


@dataclass(frozen=True)
class SideTable:
    """A side table with the keys it joins on and the columns that order its rows."""

    df: DataFrame
    keys: Sequence[str]
    order_by: Sequence[str]
    grain: str = "exact"


@dataclass
class PreparationPlan:
    """Everything learned from the data while preparing it."""

    missing_treatment: Any
    outliers: cleaning.OutlierRule
    date_formats: dict[str, int]
    dates: list[str]
    one_hot: encode.OneHot
    ratios: encode.Ratios
    bins: OptimalBins = field(default_factory=lambda: OptimalBins({}, {}))
    features: list[str] = field(default_factory=list)
    #: means or medians learned from the working frame, where the treatment fills with them
    fills: dict[str, float] | None = None

    def clean(self, df: DataFrame) -> DataFrame:
        """Outliers treated, dates parsed and spread into hours and parts, all as it was learned."""
        known = set(df.columns)
        df = encode.add_parsed_dates(
            self.outliers.only(known).transform(df), {c: f for c, f in self.date_formats.items() if c in known}
        )
        dates = [d for d in self.dates if d in df.columns]
        return encode.date_parts(encode.date_diff_hours(df, dates, always=True), dates)

    def derive(self, df: DataFrame) -> DataFrame:
        """Dummies and ratios on a clean frame; lazily, so whoever reads a few added columns pays for those only."""
        have = set(df.columns)
        one_hot = encode.OneHot({c: v for c, v in self.one_hot.levels.items() if c in have})
        ratios = encode.Ratios({p: m for p, m in self.ratios.fills.items() if have.issuperset(p)})
        return ratios.transform(one_hot.transform(df))

    def engineer(self, df: DataFrame, keep_rows: bool = False) -> DataFrame:
        """Derived columns with filled gaps.

        Means and medians are those learned once. While fitting, rows that still miss something are dropped as the
        treatment says; new data keeps its rows.
        """
        wide = self.derive(df)
        if self.fills is None:
            return cleaning.treat_missing(wide, self.missing_treatment, df.columns)
        filled = cleaning.fill_learned(wide, self.fills)
        return filled if keep_rows else cleaning.missing_delete(filled, df.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        """Prepare new data with the choices learned before; only selected features are added."""
        clean = self.clean(nan_to_null(df))
        wide = self.engineer(clean, keep_rows=True)
        have = set(wide.columns)
        bins = OptimalBins({c: s for c, s in self.bins.splits.items() if c in have}, {})
        wide = bins.transform(wide, fill_gaps=False)
        extra = [c for c in self.features if c in wide.columns and c not in clean.columns]
        return wide.select(*[q(c) for c in (*clean.columns, *extra)])

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the plan as one JSON document, to any path that Spark writes."""
        document = {
            "missing_treatment": self.missing_treatment,
            "outliers": {"action": self.outliers.action, "limit": self.outliers.limit, "moments": self.outliers.moments},
            "date_formats": self.date_formats,
            "dates": self.dates,
            "one_hot": self.one_hot.levels,
            "ratios": [[a, b, mean] for (a, b), mean in self.ratios.fills.items()],
            "bins": {"splits": self.bins.splits, "iv": self.bins.iv},
            "features": self.features,
            "fills": self.fills,
        }
        frame = spark.createDataFrame([(json.dumps(document),)], "value string")
        frame.coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PreparationPlan:
        d = json.loads(spark.read.text(path, wholetext=True).filter("trim(value) <> ''").first()["value"])
        return cls(
            d["missing_treatment"],
            cleaning.OutlierRule(
                d["outliers"]["action"], d["outliers"]["limit"], {c: tuple(m) for c, m in d["outliers"]["moments"].items()}
            ),
            d["date_formats"],
            d["dates"],
            encode.OneHot(d["one_hot"]),
            encode.Ratios({(a, b): mean for a, b, mean in d["ratios"]}),
            OptimalBins(d["bins"]["splits"], d["bins"]["iv"]),
            d["features"],
            d["fills"],
        )


@dataclass
class Prepared:
    working: DataFrame
    full: DataFrame
    features: list[str]
    missing: DataFrame
    plan: PreparationPlan


def join_side_tables(
    df: DataFrame, sides: dict[str, SideTable], obs: str, sparse: float = 0.80
) -> DataFrame:
    """Left join every side table; columns that a dated join leaves mostly empty are dropped."""
    for name, side in sides.items():
        stem = name.split(".")[0]
        if obs in side.keys:
            before = df.columns
            df = aggregates.calendar_join(
                df, side.df, side.keys, obs, stem, side.order_by, side.grain
            )
            added = [c for c in df.columns if c not in before]
            df = filters.drop_sparse_columns(df, sparse, added)
        else:
            df = aggregates.side_table_join(df, side.df, side.keys, stem, side.order_by)
    return df


def prepare(
    df: DataFrame,
    params: ScoringParams,
    key: Sequence[str],
    sides: dict[str, SideTable] | None = None,
    bucket: Column | None = None,
    binning_columns: Sequence[str] | None = None,
) -> Prepared:
    """Fit the preparation on ``df`` and return both frames with the selected features.

    ``key`` identifies a row; ``bucket`` (a whole number, by default a hash of the key) decides
    which rows the bins are learned from.
    """
    with wide_projections(df.sparkSession):
        return _prepared(df, params, key, sides, bucket, binning_columns)


def _prepared(
    df: DataFrame,
    params: ScoringParams,
    key: Sequence[str],
    sides: dict[str, SideTable] | None,
    bucket: Column | None,
    binning_columns: Sequence[str] | None,
) -> Prepared:
    target, obs = params.criterion_column, params.observation_date_column
    bucket = key_hash(*key) if bucket is None else bucket
    df = run_hook(nan_to_null(df), params.custom_calculations)
    df = filters.exclude_periods(df, obs, params.periods_to_exclude)
    full = join_side_tables(df, sides or {}, obs)
    multiclass = full.select(target).filter(q(target).isNotNull()).distinct().limit(3).count() > 2
    if params.under_sampling:
        full = materialize(full.withColumn("_h", key_hash(*key)), "joined")
        working, _ = sampling.undersample(full, target, ["_h", *key], params.under_sampling)
        full, working = full.drop("_h"), working.drop("_h")
    else:
        working = full = materialize(full, "joined")

    missing = profile.missing_table(working)
    hidden = names.unique([*params.columns_to_exclude, *key, target])
    keep = params.columns_to_include

    # cleaning, decided on the working frame
    roles = projection.roles_of(working.schema, hidden)
    outliers = cleaning.OutlierRule.fit(working, roles.numerical)
    formats = encode.date_formats_of(working, roles.object)
    parsed = encode.add_parsed_dates(working, formats)
    dates = list(projection.roles_of(parsed.schema, hidden).dates)
    plan = PreparationPlan(
        params.missing_treatment, outliers, formats, dates, encode.OneHot({}), encode.Ratios({})
    )
    working, full = _both(plan.clean, working, full, "clean")

    # categories become dummies, numbers that pass selection become ratios
    roles = projection.roles_of(working.schema, hidden)
    few = encode.high_cardinality_filter(full, roles.object)
    switched = encode.numeric_to_categorical(full, roles.numerical)
    numerical = [c for c in roles.numerical if c not in switched]
    plan.one_hot = encode.OneHot.fit(full, [*few, *switched])
    first = [*plan.one_hot.names(), *numerical]
    chosen = _select(plan.one_hot.transform(working), first, target, keep, multiclass, bucket)
    numerical = projection.reconcile_features(chosen, numerical, keep)
    plan.ratios = encode.Ratios.fit(working, numerical, keep)

    # bins, learned from training rows outside the hold-out periods
    plan.fills = cleaning.learn_fills(plan.derive(working), params.missing_treatment, working.columns)
    wide = plan.engineer(working)
    measures = [*numerical, *plan.ratios.names()]
    learn_from = wide.filter(
        ~filters.in_periods(obs, params.holdout_periods) & (filters.train_test_label(bucket) == "train")
    )
    wanted = binning_columns or params.optimal_binning_columns
    plan.bins = OptimalBins.fit(learn_from, [c for c in measures if c in wanted] or measures, target)

    # final selection among all candidates; only what is selected gets stored
    candidates = names.unique([*plan.one_hot.names(), *measures, *plan.bins.dummy_names()])
    wide = plan.bins.transform(wide, fill_gaps=False)
    chosen = _select(wide, candidates, target, keep, multiclass, bucket)
    features = projection.finalize_features(chosen, keep, wide)
    stored = names.unique([*working.columns, *features])

    def finish(df: DataFrame) -> DataFrame:
        binned = plan.bins.transform(plan.engineer(df), fill_gaps=False)
        return binned.select(*[q(c) for c in stored])

    working, full = _both(finish, working, full, "prepared")
    constant = set(filters.constant_columns(working, features))
    features = [c for c in features if c not in constant]
    require_two_valued(working, [c for c in features if c in plan.bins.dummy_names()])
    cleaning.nan_inspector(full, [features], raise_on_null=True)
    plan.features = features
    return Prepared(working, full, features, missing, plan)


def _both(step, working: DataFrame, full: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Apply a step to both frames and cut the plan there; one table when they are the same."""
    if working is full:
        out = materialize(step(full), name)
        return out, out
    return materialize(step(working), f"{name}-working"), materialize(step(full), name)


def _select(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keep: Sequence[str],
    multiclass: bool,
    bucket: Column,
) -> list[str]:
    """Correlation for a two-class target, predictive power for more classes."""
    if not multiclass:
        return stats.select_by_correlation(df, features, target, keep)
    power = stats.tree_power(df, features, target, bucket)
    found = {r["feature"] for r in stats.select_by_predictive_power(power).collect()}
    if not found:
        raise ValueError("no feature has predictive power for the target")
    return [c for c in features if c in found or names.kept_by(c, keep)]
