"""Sources, sinks and projections over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators import filters, metrics, models, projection, report, stats
from scoreloom.queries.catalog import query
from scoreloom.queries.frame import KEY, NUMERIC_FEATURES, PERIODS, frame, table, with_frame
from scoreloom.session import new_path
from scoreloom.sources import readers, sinks

ORDERS_SCHEMA = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate string, o_orderpriority string"
)


@query(
    "csv_scan",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""",
)
def csv_scan(spark, sf):
    path = new_path(spark, "orders.csv")
    orders = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").write.option(
        "header", True
    ).csv(path)
    from pyspark.sql.types import StructType

    return readers.csv_scan(spark, path, StructType.fromDDL(ORDERS_SCHEMA))


@query(
    "csv_separator_fallback",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_separator_fallback(spark, sf):
    path = new_path(spark, "customer.csv")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    customer.write.option("header", True).option("sep", ";").csv(path)
    return readers.csv_auto(spark, path, customer.schema)


@query(
    "parquet_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem",
)
def parquet_scan(spark, sf):
    return readers.load_table(spark, f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )


@query(
    "side_tables_scan",
    """SELECT 'events' AS source, user_id AS key, round(value * 2, 6) AS amount FROM events
       UNION ALL SELECT 'orders', o_custkey, round(o_totalprice, 6) FROM orders""",
)
def side_tables_scan(spark, sf):
    def doubled(df: DataFrame) -> DataFrame:
        return df.withColumn("value", F.col("value") * 2)

    sides = readers.side_tables(
        spark, {"events": f"{sf}/events.parquet", "orders": f"{sf}/orders.parquet"}, doubled
    )
    events = sides["events"].select(F.lit("events").alias("source"), F.col("user_id").alias("key"), F.round("value", 6).alias("amount"))
    orders = sides["orders"].select(F.lit("orders").alias("source"), F.col("o_custkey").alias("key"), F.round("o_totalprice", 6).alias("amount"))
    return events.unionByName(orders)


@query(
    "prepared_roundtrip",
    with_frame("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, y, obs FROM frame"),
)
def prepared_roundtrip(spark, sf):
    path = new_path(spark, "prepared")
    prepared = frame(spark, sf).select(*KEY, "qty", "y", "obs")
    sinks.write_prepared(prepared, path, "obs")
    return sinks.read_prepared(spark, path, schema=prepared.schema)


@query(
    "feature_list_roundtrip",
    with_frame(
        """, r AS (
         SELECT 'qty' AS feature, corr(qty, y) AS r FROM frame UNION ALL
         SELECT 'disc100', corr(disc100, y) FROM frame UNION ALL
         SELECT 'p_size', corr(p_size, y) FROM frame UNION ALL
         SELECT 'l_tax', corr(l_tax, y) FROM frame UNION ALL
         SELECT 'l_extendedprice', corr(l_extendedprice, y) FROM frame UNION ALL
         SELECT 'p_retailprice', corr(p_retailprice, y) FROM frame UNION ALL
         SELECT 'o_totalprice', corr(o_totalprice, y) FROM frame)
       SELECT feature FROM r WHERE abs(r) > 0.05 AND abs(r) < 0.4"""
    ),
)
def feature_list_roundtrip(spark, sf):
    path = new_path(spark, "features")
    chosen = stats.select_by_correlation(frame(spark, sf), NUMERIC_FEATURES, "y")
    sinks.write_feature_list(spark, chosen, path)
    return spark.createDataFrame([(f,) for f in sinks.read_feature_list(spark, path)], "feature string")


@query(
    "splits_roundtrip",
    with_frame("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, y, dataset FROM frame"),
)
def splits_roundtrip(spark, sf):
    path = new_path(spark, "splits")
    sinks.write_splits(frame(spark, sf).select(*KEY, "y", "dataset"), path)
    parts = [sinks.read_split(spark, path, name) for name in ("train", "test", "t1", "t2", "t3")]
    return report.union_splits(*parts)


METRICS_SQL = """, f AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM frame),
  cells AS (SELECT dataset, count(*) AS n,
      sum(CASE WHEN y=1 AND pred=1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y=0 AND pred=1 THEN 1 ELSE 0 END) AS fp,
      sum(CASE WHEN y=1 AND pred=0 THEN 1 ELSE 0 END) AS fn, sum(y) AS sy, sum(pred) AS sp FROM f GROUP BY dataset),
  g AS (SELECT dataset, score, sum(y) AS pos, sum(1-y) AS neg FROM f GROUP BY dataset, score),
  w AS (SELECT *, sum(neg) OVER (PARTITION BY dataset ORDER BY score) - neg AS below FROM g),
  a AS (SELECT dataset, CAST(sum(pos*(below + neg/2)) AS DOUBLE) / (sum(pos)*sum(neg)) AS auc FROM w GROUP BY dataset)
  SELECT dataset, round((n-fp-fn)/n, 2) AS accuracy, round(auc, 2) AS auc, round(tp/(tp+fp), 2) AS "precision",
    round(tp/(tp+fn), 2) AS recall, round(2*tp/(2*tp+fp+fn), 2) AS f1, round(sy/n, 2) AS criterion_rate,
    round(sp/n, 2) AS predicted_rate, n AS volume
  FROM cells JOIN a USING (dataset)"""


@query("metrics_sink", with_frame(METRICS_SQL))
def metrics_sink(spark, sf):
    path = new_path(spark, "metrics")
    scored = frame(spark, sf).withColumn("pred", F.when(F.col("score") > 0.5, 1).otherwise(0))
    result = metrics.binary_metrics(scored, "y", "pred", "score", ["dataset"])
    sinks.write_report(result, path)
    return readers.csv_scan(spark, path, result.schema)


@query("dictionary_scan", "SELECT c_name AS \"Variable\", c_mktsegment AS \"Description\" FROM customer")
def dictionary_scan(spark, sf):
    path = new_path(spark, "dict")
    padded = table(spark, sf, "customer").select(
        F.col("c_name").alias("Variable"), F.rpad("c_mktsegment", 40, " ").alias("Description")
    )
    padded.write.option("header", True).option("sep", ";").option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.dictionary_scan(spark, path)


def _tree(df: DataFrame) -> models.FittedModel:
    return models.fit_model(df.filter("dataset = 'train'"), ["qty", "disc100", "p_size"], "y", "dt")


# a stored model scores exactly as before, whatever it has learned
@query("model_roundtrip", with_frame("SELECT dataset, count(*) AS n, 0.0 AS max_difference FROM frame GROUP BY dataset"))
def model_roundtrip(spark, sf):
    rows = frame(spark, sf)
    path = new_path(spark, "model")
    model = _tree(rows)
    model.save(path)
    again = models.FittedModel.load(spark, path)
    both = again.score(model.score(rows, "saved"), "loaded")
    return both.groupBy("dataset").agg(
        F.count("*").alias("n"),
        F.max(F.abs(F.col("saved_y_pred_prob") - F.col("loaded_y_pred_prob"))).alias("max_difference"),
    )


@query("prediction_sink")
def prediction_sink(spark, sf):
    rows = frame(spark, sf)
    path = new_path(spark, "predictions")
    scored = models.batch_predict(rows, [_tree(rows)])
    sinks.write_predictions(scored, path, [*KEY, "obs", "predict_dt", "not_there"])
    schema = scored.select(*KEY, "obs", "predict_dt").schema
    return readers.csv_scan(spark, path, schema)


# -- projections -------------------------------------------------------------------------------


@query(
    "select_by_role",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
)
def select_by_role(spark, sf):
    return projection.select_by_role(table(spark, sf, "lineitem"), "numerical")


@query(
    "exclude_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""",
)
def exclude_columns(spark, sf):
    return projection.exclude_columns(
        table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    )


@query("select_by_pattern", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def select_by_pattern(spark, sf):
    return projection.select_by_pattern(table(spark, sf, "orders").drop("o_orderdate"), "_order")


@query(
    "dedupe_columns",
    "SELECT l_orderkey, l_partkey, l_quantity, p_size FROM lineitem JOIN part ON l_partkey = p_partkey",
)
def dedupe_columns(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return projection.dedupe_columns(lines.join(parts, lines.l_partkey == parts.l_partkey))


@query(
    "sanitize_names",
    """SELECT l_orderkey, l_quantity AS qty_binned_dummie_from_incl_0_to_25_excl_,
         l_discount AS "discless_than0.05", l_tax AS taxmore_than1_incl_ FROM lineitem""",
)
def sanitize_names(spark, sf):
    lines = table(spark, sf, "lineitem")
    return projection.sanitize_names(
        lines.select(
            "l_orderkey",
            F.col("l_quantity").alias("qty_binned_dummie_[0, 25)"),
            F.col("l_discount").alias("disc<0.05"),
            F.col("l_tax").alias("tax > 1]"),
        )
    )


@query("project_selected_features", with_frame("SELECT l_orderkey, qty, disc100, l_tax, p_size FROM frame"))
def project_selected_features(spark, sf):
    rows = frame(spark, sf)
    features = projection.reconcile_features(
        ["qty", "disc100", "gone"], ["qty", "disc100", "l_tax", "p_retailprice"], ["l_tax_div_ratio_qty"]
    )
    features = projection.finalize_features(features, ["p_size", "absent", "qty"], rows, rows)
    return projection.project_selected_features(rows, features, ["l_orderkey"])


# -- filters -----------------------------------------------------------------------------------


@query("exclude_periods", with_frame("SELECT l_orderkey, l_linenumber, l_partkey, obs, y FROM frame WHERE obs NOT IN ('1995-01', '2001-08')"))
def exclude_periods(spark, sf):
    kept = filters.exclude_periods(frame(spark, sf), "obs", ["1995-01", "2001-08"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "obs", "y")


@query(
    "temporal_holdout",
    with_frame(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, obs,
           CASE WHEN dataset IN ('train', 'test') THEN 'rest' ELSE dataset END AS dataset FROM frame"""
    ),
)
def temporal_holdout(spark, sf):
    labelled = filters.temporal_holdout(frame(spark, sf).drop("dataset"), "obs", PERIODS)
    return labelled.select(*KEY, "obs", "dataset")


@query(
    "train_test_split",
    with_frame(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN bucket < 67 THEN 'train' ELSE 'test' END AS dataset FROM frame"""
    ),
)
def train_test_split(spark, sf):
    return filters.train_test_split(frame(spark, sf), "bucket").select(*KEY, "dataset")


@query(
    "label_splits",
    with_frame("SELECT dataset, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM frame GROUP BY dataset"),
)
def label_splits(spark, sf):
    labelled = filters.label_splits(frame(spark, sf).drop("dataset"), "obs", PERIODS, "bucket")
    return labelled.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("drop_sparse_columns", "SELECT event_id, value, CASE WHEN event_id % 2 = 0 THEN user_id END AS half FROM events")
def drop_sparse_columns(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        "value",
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("half"),
        F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("tenth"),
    )
    return filters.drop_sparse_columns(events)


@query("drop_constant_features", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def drop_constant_features(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.lit(1).alias("one"), "l_tax")
    return filters.drop_constant_features(lines, ["l_quantity", "one", "l_tax"])


@query(
    "drop_immature_rows",
    """WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events)
       SELECT event_id, user_id, day FROM e
       WHERE day NOT IN (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 3)""",
)
def drop_immature_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return filters.drop_immature_rows(events, "day", 3)


@query("cutoff_filter", with_frame("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sc, y FROM frame WHERE score >= 0.5"))
def cutoff_filter(spark, sf):
    return filters.cutoff_filter(frame(spark, sf), "score").select(*KEY, "sc", "y")


@query(
    "period_in_list",
    with_frame(
        """SELECT 'in' AS side, obs, count(*) AS n FROM frame WHERE obs IN ('2001-05','2001-06','2001-07') GROUP BY obs
           UNION ALL SELECT 'out', obs, count(*) FROM frame WHERE obs NOT IN ('2001-05','2001-06','2001-07') GROUP BY obs"""
    ),
)
def period_in_list(spark, sf):
    rows = frame(spark, sf)
    inside = filters.period_in_list(rows, "obs", PERIODS).withColumn("side", F.lit("in"))
    outside = filters.period_in_list(rows, "obs", PERIODS, negate=True).withColumn("side", F.lit("out"))
    return inside.unionByName(outside).groupBy("side", "obs").agg(F.count("*").alias("n"))
