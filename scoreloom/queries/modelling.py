"""Models, scoring and the composed flows. Fits have no SQL; their properties are tested instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators import encode, models, stats
from scoreloom.params import ScoringParams
from scoreloom.plans import predict as predict_flow
from scoreloom.plans import prepare as prepare_flow
from scoreloom.plans import report as report_flow
from scoreloom.plans import train as train_flow
from scoreloom.queries.catalog import query
from scoreloom.queries.frame import KEY, NUMERIC_FEATURES, PERIODS, frame, rounded, table, with_frame
from scoreloom.queries.rows import CUT_OFFS
from scoreloom.session import materialize


def _rows(spark, sf) -> DataFrame:
    """The frame's features, target and splits, written once because fitting reads them often."""
    return materialize(
        frame(spark, sf).select(*KEY, "obs", "y", "o_orderpriority", "dataset", "bucket", *NUMERIC_FEATURES), "frame"
    )


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter("dataset = 'train'")


def _fit(rows: DataFrame, kind: str, **settings) -> models.FittedModel:
    estimator = models.ESTIMATORS[kind](**settings) if settings else None
    return models.fit_model(_train(rows), NUMERIC_FEATURES, "y", kind, estimator)


#: Boosted models at full length by session, data and target; several queries show what one fit gives.
_fitted: dict[tuple[str, str, str], models.FittedModel] = {}


def _boosted(spark, sf: str, target: str) -> tuple[DataFrame, models.FittedModel]:
    """The rows and the boosted model of ``y`` or of the three levels, fitted once in a session."""
    rows = _rows(spark, sf) if target == "y" else _three_levels(_rows(spark, sf))
    key = spark.sparkContext.applicationId, sf, target
    if key not in _fitted:
        _fitted[key] = _fit(rows, "xgb") if target == "y" else _fit_levels(rows)
    return rows, _fitted[key]


@query("train_boosted")
def train_boosted(spark, sf):
    return models.validate_splits(*_boosted(spark, sf, "y"), "y")


#: One round of one-level trees on columns of few values, which SQL can follow; 0.3 of each step is taken.
STEP_FEATURES = ("qty", "disc100", "p_size", "l_tax")
LEVEL_SQL = "CASE WHEN y = 0 THEN 0 WHEN qty < 40 THEN 1 ELSE 2 END"


def _one_step(label: str, classes: int) -> str:
    """Common tables: ``lv`` (the frame with ``label``) and ``step`` (each class's cut and the margins on both sides)."""
    p, outputs = 1 / classes, (1,) if classes == 2 else range(classes)
    h = p * (1 - p) * (1 if classes == 2 else 2)
    cells = " UNION ALL ".join(
        f"SELECT {k} AS k, {i} AS i, CAST({c} AS DOUBLE) AS x, sum(CAST({p!r} AS DOUBLE) - CAST(label = {k} AS INTEGER)) AS g, sum(CAST({h!r} AS DOUBLE)) AS h "
        f"FROM lv WHERE dataset = 'train' GROUP BY {c}"
        for k in outputs for i, c in enumerate(STEP_FEATURES)
    )
    return f""", lv AS (SELECT *, {label} AS label FROM frame),
      cells AS ({cells}),
      cum AS (SELECT k, i, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY k, i) AS ga, sum(h) OVER (PARTITION BY k, i) AS ha
              FROM cells WINDOW w AS (PARTITION BY k, i ORDER BY x)),
      gains AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM cum
                WHERE hl >= 1 AND ha - hl >= 1),
      step AS (SELECT k, i, x AS cut, -0.3 * gl / (hl + 1) AS lo, -0.3 * (ga - gl) / (ha - hl + 1) AS hi FROM gains
               QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, i, x) = 1)"""


def _margin(k: int) -> str:
    value = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(STEP_FEATURES))
    return f"(SELECT CASE WHEN CASE i {value} END <= cut THEN lo ELSE hi END FROM step WHERE k = {k})"


_THREE = ", m AS (SELECT *, {}, {}, {} FROM lv), e AS (SELECT *, exp(m0) + exp(m1) + exp(m2) AS z FROM m)".format(
    *(f"{_margin(k)} AS m{k}" for k in range(3))
)


def _step_settings():
    return models.boosted(rounds=1, depth=1, rate=0.3, row_share=1.1, column_share=1.0)


@query(
    "boosted_first_round",
    with_frame(
        f"""{_one_step("y", 2)} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          round(1 / (1 + exp(-{_margin(1)})), 5) AS predict_xgb, 0.0 AS predict_rf FROM lv"""
    ),
)
def boosted_first_round(spark, sf):
    rows = _rows(spark, sf)
    model = models.fit_model(_train(rows), STEP_FEATURES, "y", "xgb", _step_settings())
    lacking = models.FittedModel("rf", ["not_there"], [])
    return models.batch_predict(rows, [model, lacking]).select(*KEY, "predict_xgb", "predict_rf")


@query(
    "boosted_first_round_multiclass",
    with_frame(
        f"""{_one_step(LEVEL_SQL, 3)}{_THREE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          round(exp(m0) / z, 6) AS none, round(exp(m1) / z, 6) AS small, round(exp(m2) / z, 6) AS large,
          CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS guess FROM e"""
    ),
)
def boosted_first_round_multiclass(spark, sf):
    rows = _three_levels(_rows(spark, sf))
    model = models.fit_multiclass(_train(rows), STEP_FEATURES, "level", ["none", "small", "large"], _step_settings())
    names = model.probability_columns()
    scored = model.score_multiclass(rows)
    return scored.select(*KEY, *[F.round(names[i], 6).alias(c) for i, c in enumerate(model.classes)], F.col("xgb_y_pred").alias("guess"))


@query(
    "learning_curve_first_round",
    with_frame(
        f"""{_one_step(LEVEL_SQL, 3)}{_THREE} SELECT dataset, 1 AS round,
          round(avg(-ln(CASE label WHEN 0 THEN exp(m0) WHEN 1 THEN exp(m1) ELSE exp(m2) END / z)), 6) AS loss,
          round(avg(CAST(label <> CASE WHEN m0 >= m1 AND m0 >= m2 THEN 0 WHEN m1 >= m2 THEN 1 ELSE 2 END AS INTEGER)), 6) AS error
          FROM e GROUP BY dataset"""
    ),
)
def learning_curve_first_round(spark, sf):
    rows = _three_levels(_rows(spark, sf))
    model = models.fit_multiclass(_train(rows), STEP_FEATURES, "level", ["none", "small", "large"], _step_settings())
    return rounded(models.learning_curve(rows, model, "level"), "loss", "error")


@query("train_forest")
def train_forest(spark, sf):
    rows = _rows(spark, sf)
    return models.validate_splits(rows, _fit(rows, "rf"), "y")


@query("train_tree")
def train_tree(spark, sf):
    rows = _rows(spark, sf)
    return models.validate_splits(rows, _fit(rows, "dt"), "y")


@query("train_logistic")
def train_logistic(spark, sf):
    rows = _rows(spark, sf)
    model = models.fit_logistic(_train(rows), NUMERIC_FEATURES, "y")
    return spark.createDataFrame(model.coefficients, "feature string, coef double, error double")


def _three_levels(rows: DataFrame) -> DataFrame:
    """0 for no event, 1 and 2 for an event on a small and a large quantity."""
    return rows.withColumn("level", F.when(F.col("y") == 0, 0).when(F.col("qty") < 40, 1).otherwise(2))


def _fit_levels(rows: DataFrame, **settings) -> models.FittedModel:
    estimator = models.boosted(**settings)
    return models.fit_multiclass(_train(rows), NUMERIC_FEATURES, "level", ["none", "small", "large"], estimator)


@query("train_boosted_multiclass")
def train_boosted_multiclass(spark, sf):
    return models.validate_splits(*_boosted(spark, sf, "level"), "level")


@query("score_multiclass")
def score_multiclass(spark, sf):
    rows, model = _boosted(spark, sf, "level")
    # a stored table of few files would leave most tasks without rows
    scored = materialize(model.score_multiclass(rows.hint("rebalance")), "scores")
    columns = {c: c.replace("proba_for_criterion_class", "criterion_decil_class") for c in model.probability_columns().values()}
    return models.score_deciles(scored, columns).select(*KEY, "xgb_y_pred", *columns, *columns.values())


@query("two_pass_fit")
def two_pass_fit(spark, sf):
    rows = _rows(spark, sf)
    model = models.two_pass_fit(_train(rows), NUMERIC_FEATURES, "y", "rf", k=4, exclude=["l_tax"])
    return model.importance_table(spark)


@query("top_features")
def top_features(spark, sf):
    model = _fit(_rows(spark, sf), "dt")
    return stats.top_features(model.importance_table(spark), k=3)


@query("learning_curve")
def learning_curve(spark, sf):
    rows, model = _boosted(spark, sf, "y")
    return models.learning_curve(rows.filter("dataset in ('train', 'test')"), model, "y")


@query("learning_curve_multiclass")
def learning_curve_multiclass(spark, sf):
    rows, model = _boosted(spark, sf, "level")
    return models.learning_curve(rows.filter("dataset in ('train', 'test')"), model, "level")


@query("score")
def score(spark, sf):
    rows = _rows(spark, sf)
    return _fit(rows, "dt").score(rows).select(*KEY, "dt_y_pred", "dt_y_pred_prob")


@query("tree_bands")
def tree_bands(spark, sf):
    rows = frame(spark, sf).select(*KEY, "score", "y")
    return models.tree_bands(rows, "score", "y", "band", leaf="leaf").select(*KEY, "band", "leaf")


@query("validate_splits")
def validate_splits(spark, sf):
    rows = _rows(spark, sf)
    return models.validate_splits(rows, _fit(rows, "dt"), "y")


@query("batch_predict")
def batch_predict(spark, sf):
    rows = _rows(spark, sf)
    known = _fit(rows, "dt")
    lacking = models.FittedModel("rf", ["not_there"], known.models)
    return models.batch_predict(rows, [known, lacking]).select(*KEY, "predict_dt", "predict_rf")


@query("recursive_elimination")
def recursive_elimination(spark, sf):
    # the elimination stores what it needs of the frame
    steps = models.recursive_elimination(_train(frame(spark, sf)), NUMERIC_FEATURES, "y", F.col("bucket"), keep=3)
    return steps.withColumn("features", F.array_join("features", ","))


@query("recursive_elimination_multiclass")
def recursive_elimination_multiclass(spark, sf):
    rows = _train(_three_levels(frame(spark, sf)))
    steps = models.recursive_elimination(rows, NUMERIC_FEATURES, "level", F.col("bucket"), keep=3, classes=3)
    return steps.withColumn("features", F.array_join("features", ","))


# -- flows -------------------------------------------------------------------------------------

PARAMS = ScoringParams(
    criterion_column="y",
    observation_date_column="obs",
    t1df=PERIODS[0],
    t2df=PERIODS[1],
    t3df=PERIODS[2],
    missing_treatment="column_mean",
    periods_to_exclude=["2001-08"],
    columns_to_include=["qty_div_ratio_p_size"],
    columns_to_exclude=["bucket", "l_suppkey", "p_partkey", "user_id", "obs"],
    cut_offs={"dt": CUT_OFFS, "xgb": CUT_OFFS, "rf": CUT_OFFS},
    secondary_criterion_columns=["l_extendedprice", "o_totalprice"],
    under_sampling=1,
    symbol="portfolio",
    direction="up",
    model_version="1",
    signal_trade={"col1_name": "predict_dt", "col1_value": 0.5},
)


def _main(spark, sf) -> DataFrame:
    rows = frame(spark, sf)
    return rows.select(
        *KEY,
        "obs",
        "y",
        "bucket",
        "qty",
        F.when(F.col("l_partkey") % 50 != 0, F.col("disc100")).alias("disc100"),
        "p_size",
        "l_extendedprice",
        "o_totalprice",
        "l_returnflag",
        "l_shipdate",
        "o_orderdate",
        F.col("o_custkey").alias("user_id"),
    )


def _sides(spark, sf) -> dict[str, prepare_flow.SideTable]:
    events = table(spark, sf, "events").select("user_id", "event_id", "value")
    return {"events.parquet": prepare_flow.SideTable(events, ["user_id"], ["event_id"])}


@query("flow_prepare")
def flow_prepare(spark, sf):
    prepared = prepare_flow.prepare(_main(spark, sf), PARAMS, KEY, _sides(spark, sf), F.col("bucket"))
    return stats.corr_with_target(prepared.working, prepared.features, "y")


def _flow_estimators() -> dict:
    """In the flows the boosted model takes fewer, longer steps and the forest fewer trees; ``train_boosted`` and ``train_forest``
    fit them at full length."""
    boosted = models.boosted(rounds=10, rate=0.1, column_share=0.5)
    return {"xgb": boosted, "rf": models.forest(numTrees=30), "dt": models.single_tree()}


def _trained(spark, sf):
    prepared = prepare_flow.prepare(_main(spark, sf), PARAMS, KEY, _sides(spark, sf), F.col("bucket"))
    kinds = _flow_estimators()
    trained = train_flow.train(
        prepared.full, prepared.features, PARAMS, F.col("bucket"), list(kinds), prepared.working, estimators=kinds
    )
    return prepared, trained


@query("flow_train")
def flow_train(spark, sf):
    return _trained(spark, sf)[1].metrics


@query("flow_predict")
def flow_predict(spark, sf):
    prepared, trained = _trained(spark, sf)
    joined = prepare_flow.join_side_tables(_main(spark, sf), _sides(spark, sf), PARAMS.observation_date_column)
    fitted = list(trained.models.values())
    result = predict_flow.predict(
        joined,
        prepared.plan,
        fitted,
        PARAMS,
        trained.labelled.filter("dataset = 'train'"),
        {"tp": 10, "sl": 5, "period": 3},
        "obs",
        3,
    )
    scores = [*(f"predict_{m.name}" for m in fitted), "signal_trade", "mean_data_drift", "mean_w_data_drift", "symbol", "version"]
    return result.predictions.select(*KEY, "obs", *scores)


@query("flow_report")
def flow_report(spark, sf):
    rows = frame(spark, sf)
    narrow = rows.select(
        *KEY, "obs", "y", "dataset", "l_returnflag", "qty", "disc100", "p_size", "l_extendedprice", "o_totalprice"
    )
    flags = encode.one_hot(narrow, ["l_returnflag"])
    features = ["qty", "disc100", "p_size", "l_returnflag_dummie_N"]
    base = materialize(flags, "splits")
    model = models.fit_model(base.filter("dataset = 'train'"), features, "y", "dt")
    banded = models.banded(model.score(base), "dt", "y", CUT_OFFS)
    splits = materialize(banded, "banded")
    return report_flow.stacked(
        report_flow.model_report(splits, model, PARAMS, raw_columns=["l_extendedprice"])
    )
