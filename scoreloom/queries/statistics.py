"""Supervised statistics, binning and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import binning, metrics, stats
from scoreloom.queries.aggregates import _bin_sql, _edges_sql
from scoreloom.queries.catalog import query
from scoreloom.queries.frame import KEY, NUMERIC_FEATURES, frame, rounded, with_frame
from scoreloom.queries.tables import METRICS_SQL
from scoreloom.session import materialize


def _corr_sql(features) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS r FROM frame" for c in features)


@query(
    "corr_with_target",
    with_frame(f", r AS ({_corr_sql(NUMERIC_FEATURES)}) SELECT feature, round(r, 6) + 0 AS r FROM r"),
)
def corr_with_target(spark, sf):
    return rounded(stats.corr_with_target(frame(spark, sf), NUMERIC_FEATURES, "y"), "r")


@query(
    "correlation_filter",
    with_frame(
        f""", r AS ({_corr_sql(NUMERIC_FEATURES)}) SELECT feature, round(r, 6) + 0 AS r FROM r
          WHERE (abs(r) > 0.05 AND abs(r) < 0.4) OR feature IN ('l_tax', 'qty')"""
    ),
)
def correlation_filter(spark, sf):
    correlations = stats.corr_with_target(frame(spark, sf), NUMERIC_FEATURES, "y")
    return rounded(stats.correlation_filter(correlations, ["l_tax_div_ratio_qty"]), "r")


def _matrix_sql(columns) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0 AS r FROM frame" for a in columns for b in columns
    )
    return f" {cells}"


@query("correlation_matrix", with_frame(_matrix_sql(["qty", "disc100", "p_size", "l_extendedprice"])))
def correlation_matrix(spark, sf):
    return rounded(stats.correlation_matrix(frame(spark, sf), ["qty", "disc100", "p_size", "l_extendedprice"]), "r")


@query("correlation_matrix_raw", with_frame(_matrix_sql(["qty", "disc100", "p_size"])))
def correlation_matrix_raw(spark, sf):
    features = ["qty_div_ratio_disc100_binned_dummie_low", "p_size_binned_dummie_high", "qty"]
    return rounded(stats.raw_correlation_matrix(frame(spark, sf), features), "r")


def _power_sql(features: list[str], target: str) -> str:
    edges = ", ".join(f"{_edges_sql(c)} AS e{i}" for i, c in enumerate(features))
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, bucket % 4 AS fold, {_bin_sql(c, f'e{i}')} AS bin, {target} AS y FROM frame, q"
        for i, c in enumerate(features)
    )
    return f""", q AS (SELECT {edges} FROM frame), b AS ({rows}),
      c AS (SELECT feature, fold, bin, y, count(*) AS n FROM b GROUP BY ALL),
      t AS (SELECT feature, bin, y, sum(n) AS total FROM c GROUP BY ALL),
      f AS (SELECT unnest([0, 1, 2, 3]) AS fold),
      o AS (SELECT t.feature, t.bin, f.fold, t.y, total - coalesce(n, 0) AS outside FROM t CROSS JOIN f
            LEFT JOIN c ON c.feature = t.feature AND c.bin = t.bin AND c.y = t.y AND c.fold = f.fold),
      v AS (SELECT feature, bin, fold, y AS pred FROM o WHERE outside > 0
            QUALIFY row_number() OVER (PARTITION BY feature, bin, fold ORDER BY outside DESC, y) = 1),
      g AS (SELECT feature, fold, y AS common FROM (SELECT feature, fold, y, sum(outside) AS w FROM o GROUP BY ALL)
            QUALIFY row_number() OVER (PARTITION BY feature, fold ORDER BY w DESC, y) = 1),
      p AS (SELECT c.feature, c.y, coalesce(pred, common) AS pred, sum(n) AS n FROM c
            LEFT JOIN v USING (feature, bin, fold) LEFT JOIN g USING (feature, fold) GROUP BY ALL),
      k AS (SELECT feature, y, sum(n) AS support, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS hit FROM p GROUP BY ALL),
      h AS (SELECT feature, pred AS y, sum(n) AS given FROM p GROUP BY ALL),
      s AS (SELECT k.feature, CAST(sum(2 * hit / (support + coalesce(given, 0)) * support) AS DOUBLE) / sum(support) AS f1,
              CAST(max(support) AS DOUBLE) / sum(support) AS most,
              sum(CAST(support AS DOUBLE) * support) / (CAST(sum(support) AS DOUBLE) * sum(support)) AS drawn
            FROM k LEFT JOIN h USING (feature, y) GROUP BY k.feature),
      z AS (SELECT feature, greatest(2 * most * most / (1 + most), drawn) AS baseline, f1 FROM s)
      SELECT feature, round(baseline, 6) AS baseline, round(f1, 6) AS f1,
        round(greatest((f1 - baseline) / (1 - baseline), 0), 6) AS score FROM z"""


@query("predictive_power", with_frame(_power_sql(["qty", "p_size", "disc100", "l_extendedprice"], "y")))
def predictive_power(spark, sf):
    power = stats.predictive_power(
        frame(spark, sf), ["qty", "p_size", "disc100", "l_extendedprice"], "y", F.col("bucket")
    )
    return rounded(power, "baseline", "f1", "score")


@query("predictive_power_multiclass", with_frame(_power_sql(["o_totalprice", "score"], "l_returnflag")))
def predictive_power_multiclass(spark, sf):
    power = stats.predictive_power(frame(spark, sf), ["o_totalprice", "score"], "l_returnflag", F.col("bucket"))
    return rounded(power, "baseline", "f1", "score")


@query(
    "stump_feature",
    with_frame(
        """, g AS (SELECT sc, count(*) AS n, sum(y) AS p FROM frame GROUP BY sc),
           c AS (SELECT sc, sum(n) OVER (ORDER BY sc) AS n, sum(p) OVER (ORDER BY sc) AS p, sum(n) OVER () AS nn,
                  sum(p) OVER () AS pp, lead(sc) OVER (ORDER BY sc) AS nxt FROM g),
           b AS (SELECT sc AS cut, nxt FROM c WHERE n < nn
                 ORDER BY 2.0 * p * (n - p) / n + 2.0 * (pp - p) * ((nn - n) - (pp - p)) / (nn - n), sc LIMIT 1)
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sc > (cut + nxt) / 2.0 AS INTEGER) AS sc_tree,
           'sc_tree_' || CAST(cut AS DOUBLE) AS feature FROM frame, b"""
    ),
)
def stump_feature(spark, sf):
    out = stats.stump_feature(frame(spark, sf), ["sc", "l_tax"], "y")
    name = next(c for c in out.columns if c.startswith("sc_tree_"))
    return out.select(*KEY, F.col(f"`{name}`").alias("sc_tree"), F.lit(name).alias("feature"))


def _tree_power_sql() -> str:
    numbers, texts = ["qty", "disc100", "p_size", "l_tax"], ["l_returnflag", "o_orderpriority"]
    cells = " UNION ALL ".join(
        [f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, CAST({c} AS DOUBLE) AS x, bucket % 4 AS fold, y FROM frame" for c in numbers]
        + [f"SELECT '{c}', {c}, NULL, bucket % 4, y FROM frame" for c in texts]
    )
    return f""", cells AS ({cells}),
      cnt AS (SELECT feature, v, x, fold, y, count(*) AS n FROM cells GROUP BY ALL),
      tot AS (SELECT feature, v, x, y, sum(n) AS t FROM cnt GROUP BY ALL),
      train AS (SELECT tot.feature, tot.v, tot.x, f.fold, tot.y, t - coalesce(n, 0) AS m
                FROM tot CROSS JOIN (SELECT unnest(range(4)) AS fold) f
                LEFT JOIN cnt ON cnt.feature = tot.feature AND cnt.v = tot.v AND cnt.y = tot.y AND cnt.fold = f.fold),
      vote AS (SELECT feature, v, x, fold, y AS pred FROM train WHERE m > 0
               QUALIFY row_number() OVER (PARTITION BY feature, v, fold ORDER BY m DESC, y) = 1),
      common AS (SELECT feature, fold, y AS pred FROM (SELECT feature, fold, y, sum(m) AS m FROM train GROUP BY ALL)
                 QUALIFY row_number() OVER (PARTITION BY feature, fold ORDER BY m DESC, y) = 1),
      lacking AS (SELECT c.feature, c.v, c.fold, w.pred FROM (SELECT DISTINCT feature, v, x, fold FROM cnt WHERE x IS NOT NULL) c
                  JOIN vote w ON w.feature = c.feature AND w.fold = c.fold
                  WHERE NOT EXISTS (SELECT 1 FROM vote o WHERE o.feature = c.feature AND o.fold = c.fold AND o.v = c.v)
                  QUALIFY row_number() OVER (PARTITION BY c.feature, c.v, c.fold ORDER BY abs(w.x - c.x), w.x) = 1),
      guess AS (SELECT cnt.feature, cnt.fold, cnt.y, coalesce(vote.pred, lacking.pred, common.pred) AS pred, sum(n) AS n FROM cnt
                LEFT JOIN vote ON vote.feature = cnt.feature AND vote.v = cnt.v AND vote.fold = cnt.fold
                LEFT JOIN lacking ON lacking.feature = cnt.feature AND lacking.v = cnt.v AND lacking.fold = cnt.fold
                LEFT JOIN common ON common.feature = cnt.feature AND common.fold = cnt.fold GROUP BY ALL),
      sup AS (SELECT feature, fold, y AS c, sum(n) AS support, sum(n) FILTER (y = pred) AS hit FROM guess GROUP BY ALL),
      giv AS (SELECT feature, fold, pred AS c, sum(n) AS given FROM guess GROUP BY ALL),
      f1 AS (SELECT feature, fold, sum(2.0 * coalesce(hit, 0) / (support + coalesce(given, 0)) * support) / sum(support) AS f1
             FROM sup LEFT JOIN giv USING (feature, fold, c) GROUP BY ALL),
      sizes AS (SELECT feature, y, sum(n) AS n FROM cnt GROUP BY ALL),
      base AS (SELECT feature, max(n) / sum(n) AS top, sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * sum(n)) AS drawn FROM sizes GROUP BY feature),
      lifts AS (SELECT feature, greatest(2 * top * top / (1 + top), drawn) AS baseline, (SELECT avg(f1) FROM f1 WHERE f1.feature = base.feature) AS f1 FROM base)
      SELECT feature, round(baseline, 6) AS baseline, round(f1, 6) AS f1,
        round(greatest((f1 - baseline) / (1 - baseline), 0), 6) AS score FROM lifts"""


@query("predictive_power_trees", with_frame(_tree_power_sql()))
def predictive_power_trees(spark, sf):
    columns = ["qty", "disc100", "p_size", "l_tax", "l_returnflag", "o_orderpriority"]
    found = stats.tree_power(frame(spark, sf).select("y", "bucket", *columns), columns, "y", F.col("bucket"))
    return rounded(found, "baseline", "f1", "score")


def _train(spark, sf):
    rows = frame(spark, sf).filter("dataset = 'train'").select("y", "sc", *NUMERIC_FEATURES)
    return materialize(rows, "train")  # binning reads it twice


def _splits_table(spark, bins: binning.OptimalBins):
    rows = [(c, i, float(s), bins.iv[c]) for c, splits in bins.splits.items() for i, s in enumerate(splits)]
    return spark.createDataFrame(rows, "feature string, position int, split double, iv double")


@query("optimal_binning")
def optimal_binning(spark, sf):
    return _splits_table(spark, binning.OptimalBins.fit(_train(spark, sf), [*NUMERIC_FEATURES, "sc"], "y"))


@query("optimal_binning_multiclass")
def optimal_binning_multiclass(spark, sf):
    rows = _train(spark, sf).withColumn(
        "level", F.when(F.col("y") == 0, 0).when(F.col("sc") < 150, 1).otherwise(2)
    )
    return _splits_table(spark, binning.OptimalBins.fit(rows, ["qty", "p_size", "disc100", "l_tax"], "level"))


SPLITS = [125.0, 150.0, 175.0]


@query(
    "binning_table",
    with_frame(
        """, b AS (SELECT CASE WHEN sc < 125 THEN '(-inf, 125.00)' WHEN sc < 150 THEN '[125.00, 150.00)'
               WHEN sc < 175 THEN '[150.00, 175.00)' ELSE '[175.00, inf)' END AS bin, y FROM frame),
           g AS (SELECT bin, count(*) AS n, count(*) FILTER (y = 1) AS event, count(*) FILTER (y = 0) AS nonevent FROM b GROUP BY bin),
           p AS (SELECT *, event / sum(event) OVER () AS pe, nonevent / sum(nonevent) OVER () AS pn, n / sum(n) OVER () AS share FROM g)
         SELECT bin, n, round(share, 6) AS share, event, nonevent, round(event / n, 6) AS event_rate,
           round(ln(pn / pe), 6) AS woe, round((pn - pe) * ln(pn / pe), 6) AS iv FROM p"""
    ),
)
def binning_table(spark, sf):
    table = binning.binning_table(frame(spark, sf), "sc", SPLITS, "y")
    return rounded(table, "share", "event_rate", "woe", "iv")


@query(
    "apply_bins",
    with_frame(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN sc < 125 THEN '(-inf, 125.00)' WHEN sc < 150 THEN '[125.00, 150.00)'
             WHEN sc < 175 THEN '[150.00, 175.00)' ELSE '[175.00, inf)' END AS sc_binned,
           CAST(sc < 125 AS INTEGER) AS "sc_binned_dummie_from_excl_-inf_to_125.00_excl_",
           CAST(sc >= 125 AND sc < 150 AS INTEGER) AS "sc_binned_dummie_from_incl_125.00_to_150.00_excl_",
           CAST(sc >= 150 AND sc < 175 AS INTEGER) AS "sc_binned_dummie_from_incl_150.00_to_175.00_excl_",
           CAST(sc >= 175 AS INTEGER) AS "sc_binned_dummie_from_incl_175.00_to_inf_excl_" FROM frame"""
    ),
)
def apply_bins(spark, sf):
    rows = frame(spark, sf).select(*KEY, "sc")
    return binning.bin_labels(binning.apply_bins(rows, {"sc": SPLITS}), "sc", SPLITS).drop("sc")


@query("binning_selection")
def binning_selection(spark, sf):
    rows = materialize(frame(spark, sf).select("y", "dataset", *NUMERIC_FEATURES), "frame")
    bins = binning.OptimalBins.fit(rows.filter("dataset = 'train'"), NUMERIC_FEATURES, "y")
    binned = bins.transform(rows)
    chosen = binning.binning_selection(binned, list(NUMERIC_FEATURES), bins, "y")
    return rounded(stats.corr_with_target(binned, chosen, "y"), "r")


# -- metrics -----------------------------------------------------------------------------------


def _guess(spark, sf):
    return frame(spark, sf).withColumn("pred", F.when(F.col("score") > 0.5, 1).otherwise(0))


@query("binary_metrics", with_frame(METRICS_SQL))
def binary_metrics(spark, sf):
    return metrics.binary_metrics(_guess(spark, sf), "y", "pred", "score", ["dataset"])


@query(
    "cutoff_metrics",
    with_frame(
        """SELECT dataset, round(avg(y) FILTER (score >= 0.5), 2) AS precision_cutoff,
           round(CAST(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) FILTER (score >= 0.5) AS DOUBLE) / count(y), 2) AS volume_cutoff
         FROM frame GROUP BY dataset"""
    ),
)
def cutoff_metrics(spark, sf):
    return metrics.cutoff_metrics(_guess(spark, sf), "y", "pred", "score", by=["dataset"])


_CLASS_SQL = """, m AS (SELECT *, CAST(qty AS DOUBLE) / (qty + disc100 + p_size) AS p0, CAST(disc100 AS DOUBLE) / (qty + disc100 + p_size) AS p1,
     CAST(p_size AS DOUBLE) / (qty + disc100 + p_size) AS p2,
     CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls,
     CASE WHEN qty >= disc100 AND qty >= p_size THEN 0 WHEN p_size >= disc100 THEN 2 ELSE 1 END AS pred FROM frame)"""


def _three_classes(spark, sf):
    total = F.col("qty") + F.col("disc100") + F.col("p_size")
    qty, disc, size = F.col("qty"), F.col("disc100"), F.col("p_size")
    return frame(spark, sf).select(
        "*",
        (qty / total).alias("p0"),
        (disc / total).alias("p1"),
        (size / total).alias("p2"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("cls"),
        F.when((qty >= disc) & (qty >= size), 0).when(size >= disc, 2).otherwise(1).alias("pred"),
    )


_SCORES = {0: "p0", 1: "p1", 2: "p2"}


@query(
    "multiclass_metrics",
    with_frame(
        _CLASS_SQL
        + """, u AS (SELECT dataset, cls AS c, 1 AS s, 0 AS g, CASE WHEN cls = pred THEN 1 ELSE 0 END AS h FROM m
                UNION ALL SELECT dataset, pred, 0, 1, 0 FROM m),
            k AS (SELECT dataset, c, sum(s) AS s, sum(g) AS g, sum(h) AS h FROM u GROUP BY ALL),
            a AS (SELECT dataset, sum(s) AS volume, sum(h) / sum(s) AS accuracy, avg(CASE WHEN g > 0 THEN h / g ELSE 0 END) AS prec,
                    avg(CASE WHEN s > 0 THEN h / s ELSE 0 END) AS rec, avg(CASE WHEN s + g > 0 THEN 2 * h / (s + g) ELSE 0 END) AS f1 FROM k GROUP BY dataset),
            o AS (SELECT dataset, 0 AS c, CAST(cls = 0 AS INTEGER) AS y, p0 AS p FROM m UNION ALL
                  SELECT dataset, 1, CAST(cls = 1 AS INTEGER), p1 FROM m UNION ALL SELECT dataset, 2, CAST(cls = 2 AS INTEGER), p2 FROM m),
            g AS (SELECT dataset, c, p, sum(y) AS pos, sum(1 - y) AS neg FROM o GROUP BY ALL),
            w AS (SELECT *, sum(neg) OVER (PARTITION BY dataset, c ORDER BY p) - neg AS below FROM g),
            r AS (SELECT dataset, c, CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY ALL),
            v AS (SELECT dataset, avg(auc) AS auc FROM r GROUP BY dataset)
          SELECT dataset, round(accuracy, 4) AS accuracy, round(auc, 4) AS auc, round(prec, 4) AS "precision", round(rec, 4) AS recall,
            round(f1, 4) AS f1, CAST(volume AS BIGINT) AS volume FROM a JOIN v USING (dataset)"""
    ),
)
def multiclass_metrics(spark, sf):
    return metrics.multiclass_metrics(_three_classes(spark, sf), "cls", "pred", _SCORES, ["dataset"], digits=4)


@query(
    "data_drift",
    with_frame(
        ", r AS ("
        + _corr_sql(NUMERIC_FEATURES)
        + "), d AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, abs(avg({c}) FILTER (dataset = 't1') / avg({c}) FILTER (dataset = 'train') - 1) AS d FROM frame"
            for c in NUMERIC_FEATURES
        )
        + """), x AS (SELECT feature, abs(r) AS w, d, row_number() OVER (ORDER BY abs(r) DESC, feature) AS place FROM r JOIN d USING (feature))
          SELECT round(avg(d), 2) AS mean_data_drift, round(sum(d * w) / sum(w), 2) AS mean_w_data_drift,
            round(avg(d) FILTER (place <= 5), 2) AS mean_data_drift_top5,
            round(sum(d * w) FILTER (place <= 5) / sum(w) FILTER (place <= 5), 2) AS mean_w_data_drift_top5 FROM x"""
    ),
)
def data_drift(spark, sf):
    rows = materialize(frame(spark, sf).select("dataset", "y", *NUMERIC_FEATURES), "frame")
    weights = stats.corr_with_target(rows, NUMERIC_FEATURES, "y").select(
        F.col("feature").alias("columns"), F.abs("r").alias("importances")
    )
    return metrics.data_drift(rows.filter("dataset = 'train'"), rows.filter("dataset = 't1'"), weights)


_CURVE_SQL = """, g AS (SELECT dataset, score, sum(y) AS pos, sum(1 - y) AS neg FROM frame GROUP BY dataset, score),
   w AS (SELECT dataset, score, sum(pos) OVER d AS cp, sum(neg) OVER d AS cn, sum(pos) OVER (PARTITION BY dataset) AS p,
          sum(neg) OVER (PARTITION BY dataset) AS n FROM g WINDOW d AS (PARTITION BY dataset ORDER BY score DESC))"""


@query(
    "roc_curve",
    with_frame(
        f"{_CURVE_SQL} SELECT dataset, round(score, 6) AS threshold, round(cn / n, 6) AS fpr, round(cp / p, 6) AS tpr FROM w"
    ),
)
def roc_curve(spark, sf):
    return rounded(metrics.roc_curve(frame(spark, sf), "y", "score", ["dataset"]), "threshold", "fpr", "tpr")


@query(
    "roc_auc",
    with_frame(
        """, g AS (SELECT dataset, score, sum(y) AS pos, sum(1 - y) AS neg FROM frame GROUP BY dataset, score),
             w AS (SELECT *, sum(neg) OVER (PARTITION BY dataset ORDER BY score) - neg AS below FROM g)
           SELECT dataset, round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (sum(pos) * sum(neg)), 6) AS auc FROM w GROUP BY dataset"""
    ),
)
def roc_auc(spark, sf):
    return rounded(metrics.auc(frame(spark, sf), "y", "score", ["dataset"]), "auc")


@query(
    "cap_curve",
    with_frame(
        f"""{_CURVE_SQL} SELECT dataset, round(score, 6) AS threshold, round((cp + cn) / (p + n), 6) AS population,
            round(cp / p, 6) AS captured FROM w"""
    ),
)
def cap_curve(spark, sf):
    out = metrics.cap_curve(frame(spark, sf), "y", "score", ["dataset"])
    return rounded(out, "threshold", "population", "captured")


@query(
    "accuracy_ratio",
    with_frame(
        """, g AS (SELECT dataset, score, sum(y) AS pos, sum(1 - y) AS neg FROM frame GROUP BY dataset, score),
             w AS (SELECT *, sum(neg) OVER (PARTITION BY dataset ORDER BY score) - neg AS below FROM g)
           SELECT dataset, round(2 * CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / (sum(pos) * sum(neg)) - 1, 6) AS accuracy_ratio
           FROM w GROUP BY dataset"""
    ),
)
def accuracy_ratio(spark, sf):
    return rounded(metrics.accuracy_ratio(frame(spark, sf), "y", "score", ["dataset"]), "accuracy_ratio")


@query(
    "roc_multiclass",
    with_frame(
        _CLASS_SQL
        + """, o AS (SELECT '0' AS class, CAST(cls = 0 AS INTEGER) AS y, p0 AS p FROM m UNION ALL
                SELECT '1', CAST(cls = 1 AS INTEGER), p1 FROM m UNION ALL SELECT '2', CAST(cls = 2 AS INTEGER), p2 FROM m),
             g AS (SELECT class, p, sum(y) AS pos, sum(1 - y) AS neg FROM o GROUP BY ALL),
             w AS (SELECT class, p, sum(pos) OVER d AS cp, sum(neg) OVER d AS cn, sum(pos) OVER (PARTITION BY class) AS pp,
                     sum(neg) OVER (PARTITION BY class) AS nn FROM g WINDOW d AS (PARTITION BY class ORDER BY p DESC))
           SELECT class, round(p, 6) AS threshold, round(cn / nn, 6) AS fpr, round(cp / pp, 6) AS tpr FROM w"""
    ),
)
def roc_multiclass(spark, sf):
    out = metrics.roc_multiclass(_three_classes(spark, sf), "cls", _SCORES)
    return rounded(out, "threshold", "fpr", "tpr")


@query(
    "ecdf_by_class",
    with_frame(
        """, g AS (SELECT y, score, count(*) AS n FROM frame GROUP BY y, score)
           SELECT y, round(score, 6) AS score, round(sum(n) OVER (PARTITION BY y ORDER BY score) / sum(n) OVER (PARTITION BY y), 6) AS ecdf FROM g"""
    ),
)
def ecdf_by_class(spark, sf):
    return rounded(metrics.ecdf_by_class(frame(spark, sf), "y", "score"), "score", "ecdf")
