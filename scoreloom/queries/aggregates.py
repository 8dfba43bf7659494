"""Joins, grouped tables, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import aggregates, encode, models, ordering, profile, report, stats
from scoreloom.queries.catalog import query
from scoreloom.queries.frame import KEY, NUMERIC_FEATURES, frame, r6, rounded, table, with_frame
from scoreloom.queries.rows import BANDS_SQL, CUT_OFFS
from scoreloom.session import materialize

BANDS = ["(-0.001, 0.2]", "(0.2, 0.35]", "(0.35, 0.5]", "(0.5, 1.0]"]


def _banded(spark, sf):
    return encode.score_bands(frame(spark, sf), "score", CUT_OFFS, "band")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")


# -- side tables -------------------------------------------------------------------------------

_SIDE = """s AS (SELECT user_id, arg_min(value, event_id) AS v1, arg_max(value, event_id) AS v9,
   sum(value) AS vs, count(value) AS vc, arg_min(event_type, event_id) AS t1, arg_max(event_type, event_id) AS t9,
   count(event_type) AS tc FROM events GROUP BY user_id)"""


@query(
    "side_table_join",
    f"""WITH {_SIDE} SELECT c_custkey AS user_id, c_mktsegment, round(v1, 6) AS "value_RN1_events", t1 AS "event_type_RN1_events",
        round(v9, 6) AS "value_RN_1_events", t9 AS "event_type_RN_1_events", round(vs, 6) AS value_agg_sum_events,
        vc AS value_agg_count_events, tc AS event_type_agg_count_events
        FROM customer LEFT JOIN s ON c_custkey = user_id""",
)
def side_table_join(spark, sf):
    main = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = aggregates.side_table_join(
        main, _events(spark, sf), ["user_id"], "events", ["event_id"], ["value", "event_type"]
    )
    return rounded(joined, "value_RN1_events", "value_RN_1_events", "value_agg_sum_events")


@query(
    "calendar_join",
    """WITH s AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS ps, count(o_totalprice) AS pc,
          arg_min(o_totalprice, o_orderkey) AS p1, arg_max(o_totalprice, o_orderkey) AS p9 FROM orders GROUP BY 1, 2)
       SELECT o.o_orderkey, o.o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, round(p1, 6) AS "o_totalprice_RN1_hist",
          round(p9, 6) AS "o_totalprice_RN_1_hist", round(ps, 6) AS o_totalprice_agg_sum_hist, pc AS o_totalprice_agg_count_hist
       FROM orders o LEFT JOIN s ON o.o_custkey = s.o_custkey AND date_trunc('month', o.o_orderdate) = m""",
)
def calendar_join(spark, sf):
    orders = table(spark, sf, "orders")
    main = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    side = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    joined = aggregates.calendar_join(
        main, side, ["o_custkey", "o_orderdate"], "o_orderdate", "hist", ["o_orderkey"], "month", ["o_totalprice"]
    )
    prices = [c for c in joined.columns if "totalprice" in c and "count" not in c]
    return rounded(joined.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), *prices)


@query(
    "calendar_join_minute",
    """WITH s AS (SELECT user_id, date_trunc('minute', ts) AS m, sum(value) AS vs, count(value) AS vc,
          arg_min(value, event_id) AS v1, arg_max(value, event_id) AS v9 FROM events GROUP BY 1, 2)
       SELECT e.event_id, e.user_id, round(v1, 6) AS "value_RN1_near", round(v9, 6) AS "value_RN_1_near",
         round(vs, 6) AS value_agg_sum_near, vc AS value_agg_count_near
       FROM events e LEFT JOIN s ON e.user_id = s.user_id AND date_trunc('minute', e.ts) = m""",
)
def calendar_join_minute(spark, sf):
    events = _events(spark, sf)
    joined = aggregates.calendar_join(
        events.select("event_id", "user_id", "ts"), events, ["user_id", "ts"], "ts", "near", ["event_id"], "minute", ["value"]
    )
    return rounded(joined.drop("ts"), "value_RN1_near", "value_RN_1_near", "value_agg_sum_near")


@query(
    "aggregate_merge",
    f"""WITH {_SIDE} SELECT user_id, round(v1, 6) AS "value_RN1", t1 AS "event_type_RN1", round(v9, 6) AS "value_RN_1",
        t9 AS "event_type_RN_1", round(vs, 6) AS value_agg_sum, vc AS value_agg_count, tc AS event_type_agg_count FROM s""",
)
def aggregate_merge(spark, sf):
    merged = aggregates.aggregate_side_table(_events(spark, sf), ["user_id"], ["event_id"], ["value", "event_type"])
    return rounded(merged, "value_RN1", "value_RN_1", "value_agg_sum")


@query(
    "group_sum_count",
    """SELECT user_id, round(sum(value), 6) AS value_agg_sum, count(value) AS value_agg_count,
         count(event_type) AS event_type_agg_count FROM events GROUP BY user_id""",
)
def group_sum_count(spark, sf):
    return rounded(
        aggregates.group_sum_count(_events(spark, sf), ["user_id"], ["value", "event_type"]), "value_agg_sum"
    )


@query(
    "first_last_per_group",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events)
       SELECT f.user_id, f.event_id AS "event_id_RN1", round(f.value, 6) AS "value_RN1", l.event_id AS "event_id_RN_1",
         round(l.value, 6) AS "value_RN_1"
       FROM r f JOIN r l ON f.user_id = l.user_id AND f.a = 1 AND l.b = 1""",
)
def first_last_per_group(spark, sf):
    out = aggregates.first_last_per_group(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id", "value"])
    return rounded(out, "value_RN1", "value_RN_1")


@query("distinct_keys", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_keys(spark, sf):
    return aggregates.distinct_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@query(
    "row_number_both",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "RN1",
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS "RN_1" FROM events""",
)
def row_number_both(spark, sf):
    numbered = ordering.row_number_both(_events(spark, sf), ["user_id"], ["ts", "event_id"])
    return numbered.select("event_id", "user_id", "RN1", "RN_1")


# -- lookups -----------------------------------------------------------------------------------

_NAMES = """CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' / ' || p_brand WHEN 2 THEN p_name || ' / ' || p_type
   ELSE 'const' END"""


@query(
    "describe_features",
    f"""WITH d AS (SELECT p_type AS v, 'type of ' || min(p_brand) AS t FROM part GROUP BY p_type UNION ALL
            SELECT p_brand, 'brand sized ' || min(p_size) FROM part GROUP BY p_brand),
        n AS (SELECT p_partkey, {_NAMES} AS mouchard_name FROM part),
        k AS (SELECT *, contains(mouchard_name, '/') AS two,
            CASE WHEN contains(mouchard_name, '/') THEN replace(split_part(mouchard_name, '/', 1), ' ', '') ELSE mouchard_name END AS ka,
            CASE WHEN contains(mouchard_name, '/') THEN replace(split_part(mouchard_name, '/', 2), ' ', '') END AS kb FROM n)
        SELECT p_partkey, mouchard_name, CASE WHEN contains(mouchard_name, 'const') THEN ''
           WHEN two THEN coalesce(a.t, 'Missing description') || ' / ' || coalesce(b.t, 'Missing description')
           ELSE coalesce(a.t, 'Missing description') END AS "Description"
        FROM k LEFT JOIN d a ON ka = a.v LEFT JOIN d b ON kb = b.v""",
)
def describe_features(spark, sf):
    part = table(spark, sf, "part")
    types = part.groupBy(F.col("p_type").alias("Variable")).agg(
        F.concat(F.lit("type of "), F.min("p_brand")).alias("Description")
    )
    brands = part.groupBy(F.col("p_brand").alias("Variable")).agg(
        F.concat(F.lit("brand sized "), F.min("p_size").cast("string")).alias("Description")
    )
    kind = F.col("p_partkey") % 4
    name = (
        F.when(kind == 0, F.col("p_type"))
        .when(kind == 1, F.concat("p_type", F.lit(" / "), "p_brand"))
        .when(kind == 2, F.concat("p_name", F.lit(" / "), "p_type"))
        .otherwise("const")
    )
    named = part.select("p_partkey", name.alias("mouchard_name"))
    return report.describe_features(named, "mouchard_name", types.unionByName(brands))


_GRID = """, long AS (SELECT 'o_orderstatus' AS feature, o_orderstatus AS value, y FROM frame UNION ALL
     SELECT 'l_returnflag', l_returnflag, y FROM frame UNION ALL SELECT 'disc100', CAST(disc100 AS VARCHAR), y FROM frame),
   grid AS (SELECT feature, value, count(*) FILTER (y = 0) AS "Nb_negative_cases", count(*) FILTER (y = 1) AS "Nb_positive_cases",
     count(*) AS total_cases, round(count(*) / sum(count(*)) OVER (PARTITION BY feature), 2) AS share,
     round(count(*) FILTER (y = 1) / count(*), 2) AS criterion_rate FROM long GROUP BY feature, value)"""
_GRID_FEATURES = ["o_orderstatus", "l_returnflag", "disc100"]


@query("predictor_grid", with_frame(f"{_GRID} SELECT * FROM grid"))
def predictor_grid(spark, sf):
    return report.predictor_grid(frame(spark, sf), _GRID_FEATURES, "y")


@query(
    "coefficient_join",
    with_frame(
        f"""{_GRID}, c AS (SELECT 'disc100' AS feature, corr(disc100, y) AS coef FROM frame
             UNION ALL SELECT 'l_tax', corr(l_tax, y) FROM frame)
           SELECT feature, value, total_cases, round(coef, 6) AS coef FROM grid JOIN c USING (feature)"""
    ),
)
def coefficient_join(spark, sf):
    rows = frame(spark, sf)
    coefficients = stats.corr_with_target(rows, ["disc100", "l_tax"], "y").select("feature", r6("r").alias("coef"))
    grid = report.predictor_grid(rows, _GRID_FEATURES, "y").select("feature", "value", "total_cases")
    return report.coefficient_join(grid, coefficients)


@query(
    "period_totals_join",
    with_frame(
        """, c AS (SELECT obs, l_returnflag, count(*) AS counts FROM frame GROUP BY 1, 2),
           t AS (SELECT obs, CAST(sum(counts) AS BIGINT) AS total FROM c GROUP BY obs)
         SELECT obs, l_returnflag, counts, total, round(counts / total, 6) AS percentage FROM c JOIN t USING (obs)"""
    ),
)
def period_totals_join(spark, sf):
    counts = frame(spark, sf).groupBy("obs", "l_returnflag").agg(F.count("*").alias("counts"))
    return rounded(report.period_totals(counts, "obs"), "percentage")


@query("decode_labels", "SELECT o_orderkey, o_orderpriority AS class_label FROM orders")
def decode_labels(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    encoded, mapping = encode.label_encode(orders, "o_orderpriority", "code")
    return encode.decode_labels(encoded, "code", mapping).select("o_orderkey", "class_label")


# -- profiles ----------------------------------------------------------------------------------


def _gaps(spark, sf):
    return _events(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
        "user_id",
    )


_GAPS = """g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, user_id FROM events)"""
_MISSING = """m AS (SELECT 'event_id' AS column_name, 100.0 * avg(CAST(event_id IS NULL AS INTEGER)) AS p FROM g UNION ALL
   SELECT 'value', 100.0 * avg(CAST(value IS NULL AS INTEGER)) FROM g UNION ALL
   SELECT 'event_type', 100.0 * avg(CAST(event_type IS NULL AS INTEGER)) FROM g UNION ALL
   SELECT 'user_id', 100.0 * avg(CAST(user_id IS NULL AS INTEGER)) FROM g)"""


@query("missing_table", f"WITH {_GAPS}, {_MISSING} SELECT column_name, round(p, 6) AS percent_missing FROM m")
def missing_table(spark, sf):
    return rounded(profile.missing_table(_gaps(spark, sf)), "percent_missing")


@query(
    "missing_report",
    f"WITH {_GAPS}, {_MISSING} SELECT column_name, round(p, 6) AS percent_missing FROM m WHERE p > 0 ORDER BY p DESC LIMIT 100",
)
def missing_report(spark, sf):
    return rounded(profile.missing_report(profile.missing_table(_gaps(spark, sf))), "percent_missing")


@query(
    "class_distribution",
    with_frame(
        """SELECT dataset, y, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY dataset), 6) AS share
         FROM frame GROUP BY dataset, y"""
    ),
)
def class_distribution(spark, sf):
    return rounded(profile.class_distribution(frame(spark, sf), "y", ["dataset"]), "share")


@query(
    "cardinality",
    f"""WITH {_GAPS} SELECT 'event_id' AS feature, count(DISTINCT event_id) AS n_distinct FROM g UNION ALL
        SELECT 'value', count(DISTINCT value) + 1 FROM g UNION ALL SELECT 'event_type', count(DISTINCT event_type) + 1 FROM g
        UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM g""",
)
def cardinality(spark, sf):
    return profile.cardinality(_gaps(spark, sf), ["event_id", "value", "event_type", "user_id"])


_PROFILE_STATS = """CAST(min({c}) AS DOUBLE) AS mn, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
   quantile_cont({c}, 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS mx, avg({c}) AS av, stddev_samp({c}) AS sd"""


def _profile_sql(source: str, columns: dict[str, str], prefix: str = "") -> str:
    """SQL profile of ``columns`` (name -> type) of a table, one UNION branch per column."""
    parts = []
    for c, kind in columns.items():
        numeric = kind in ("int", "bigint", "double")
        stats_sql = (
            _PROFILE_STATS.format(c=c)
            if numeric
            else "NULL::DOUBLE AS mn, NULL::DOUBLE AS q1, NULL::DOUBLE AS q2, NULL::DOUBLE AS q3, NULL::DOUBLE AS mx, NULL::DOUBLE AS av, NULL::DOUBLE AS sd"
        )
        inner = f" FROM {source}" if numeric else ""
        top = f"""(SELECT string_agg(v || '=' || n, '; ' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n
            FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5))"""
        parts.append(
            f"""SELECT '{c}' AS column_name, '{kind}' AS {prefix}data_type, count(*) AS {prefix}n_rows,
              count(*) - count({c}) AS {prefix}n_missing, count(DISTINCT {c}) AS {prefix}n_distinct,
              round(mn, 6) AS {prefix}min, round(q1, 6) AS {prefix}q1, round(q2, 6) AS {prefix}median, round(q3, 6) AS {prefix}q3,
              round(mx, 6) AS {prefix}max, round(av, 6) AS {prefix}mean, round(sd, 6) AS {prefix}std, {top} AS {prefix}top_values
            FROM {source}, (SELECT {stats_sql}{inner}) GROUP BY mn, q1, q2, q3, mx, av, sd"""
        )
    return " UNION ALL ".join(parts)


_STATS = ("min", "q1", "median", "q3", "max", "mean", "std")
_EDA = {"qty": "int", "disc100": "int", "p_size": "int", "l_returnflag": "string", "o_orderpriority": "string"}


@query("eda_profile", with_frame(", p AS (" + _profile_sql("frame", _EDA) + ") SELECT * FROM p"))
def eda_profile(spark, sf):
    return rounded(profile.eda_profile(frame(spark, sf), list(_EDA)), *_STATS)


_EDA2 = {"qty": "int", "l_returnflag": "string"}


@query(
    "eda_compare",
    with_frame(
        ", w AS (SELECT * FROM frame WHERE dataset = 'train'), a AS ("
        + _profile_sql("w", _EDA2, "processed_")
        + "), b AS ("
        + _profile_sql("frame", _EDA2, "full_")
        + ") SELECT * FROM a JOIN b USING (column_name)"
    ),
)
def eda_compare(spark, sf):
    rows = materialize(frame(spark, sf).select("dataset", *_EDA2), "frame")
    both = profile.eda_compare(rows.filter("dataset = 'train'"), rows, list(_EDA2))
    return rounded(both, *[f"{p}_{s}" for p in ("processed", "full") for s in _STATS])


def _bin_sql(x: str, edges: str = "e") -> str:
    """Bin number of x under a list of distinct quantile edges."""
    return f"greatest(1, len(list_filter({edges}, lambda v: v < {x}))) - 1"


def _edges_sql(x: str, bins: int = 10) -> str:
    grid = ", ".join(f"{i}/{bins}.0" for i in range(bins + 1))
    return f"list_sort(list_distinct(quantile_cont(CAST({x} AS DOUBLE), [{grid}])))"


@query(
    "eda_vs_target",
    with_frame(
        f""", q AS (SELECT {_edges_sql('l_extendedprice')} AS e FROM frame)
         SELECT 'l_extendedprice' AS column_name, CAST({_bin_sql('l_extendedprice')} AS VARCHAR) AS bin, count(*) AS rows,
           round(avg(y), 6) AS target_rate FROM frame, q GROUP BY 1, 2
         UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(avg(y), 6) FROM frame GROUP BY 2"""
    ),
)
def eda_vs_target(spark, sf):
    return rounded(profile.eda_vs_target(frame(spark, sf), "y", ["l_extendedprice", "o_orderpriority"]), "target_rate")


# -- report tables -----------------------------------------------------------------------------


@query(
    "criterion_by_period",
    with_frame(
        "SELECT obs, round(avg(y), 6) AS rate, CAST(sum(y) AS BIGINT) AS positives, count(y) AS volume FROM frame GROUP BY obs"
    ),
)
def criterion_by_period(spark, sf):
    return rounded(report.criterion_by_period(frame(spark, sf), "obs", "y"), "rate")


@query(
    "class_share_by_period",
    with_frame(
        """SELECT obs, o_orderpriority, count(*) AS counts, CAST(sum(count(*)) OVER (PARTITION BY obs) AS BIGINT) AS total,
           round(count(*) / sum(count(*)) OVER (PARTITION BY obs), 6) AS percentage FROM frame GROUP BY obs, o_orderpriority"""
    ),
)
def class_share_by_period(spark, sf):
    return rounded(report.class_share_by_period(frame(spark, sf), "obs", "o_orderpriority"), "percentage")


@query(
    "crosstab_margins",
    with_frame(
        """SELECT coalesce(l_returnflag, 'All') AS l_returnflag, count(*) FILTER (y = 0) AS "0", count(*) FILTER (y = 1) AS "1",
           count(*) AS "All" FROM frame GROUP BY GROUPING SETS ((l_returnflag), ())"""
    ),
)
def crosstab_margins(spark, sf):
    return report.crosstab_margins(frame(spark, sf), ["l_returnflag"], "y", [0, 1])


@query(
    "crosstab_margins_two_level",
    with_frame(
        f""", b AS (SELECT dataset, CAST(y AS VARCHAR) AS y, {BANDS_SQL} AS band FROM frame)
         SELECT CASE WHEN grouping(dataset) = 1 THEN 'All' ELSE dataset END AS dataset, coalesce(y, '') AS y,
         """
        + ", ".join(f"count(*) FILTER (band = '{b}') AS \"{b}\"" for b in BANDS)
        + """, count(*) AS "All" FROM b WHERE dataset IN ('train', 'test') GROUP BY GROUPING SETS ((dataset, y), ())"""
    ),
)
def crosstab_margins_two_level(spark, sf):
    both = _banded(spark, sf).filter(F.col("dataset").isin("train", "test"))
    return report.crosstab_margins(both, ["dataset", "y"], "band", BANDS)


@query(
    "crosstab_cube",
    with_frame(
        """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS l_returnflag,
           CASE WHEN grouping(y) = 1 THEN 'All' ELSE CAST(y AS VARCHAR) END AS y, count(*) AS n
         FROM frame GROUP BY CUBE (l_returnflag, y)"""
    ),
)
def crosstab_cube(spark, sf):
    return report.crosstab_long(frame(spark, sf), "l_returnflag", "y")


@query(
    "crosstab_normalized",
    with_frame(
        """SELECT 'all' AS by, l_returnflag, y, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
           FROM frame GROUP BY l_returnflag, y UNION ALL
         SELECT 'index', l_returnflag, y, count(*), round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6)
           FROM frame GROUP BY l_returnflag, y"""
    ),
)
def crosstab_normalized(spark, sf):
    rows = frame(spark, sf)
    parts = [
        report.crosstab_normalized(rows, "l_returnflag", "y", by).withColumn("by", F.lit(by)) for by in ("all", "index")
    ]
    return rounded(report.union_splits(*parts), "share")


@query(
    "crosstab_values",
    with_frame(
        f""", b AS (SELECT obs, y, {BANDS_SQL} AS band FROM frame) SELECT obs, """
        + ", ".join(
            f"""round(avg(y) FILTER (band = '{b}'), 6) AS "{b}_mean", count(y) FILTER (band = '{b}') AS "{b}_count",
               CAST(sum(y) FILTER (band = '{b}') AS BIGINT) AS "{b}_sum" """
            for b in BANDS
        )
        + " FROM b GROUP BY obs"
    ),
)
def crosstab_values(spark, sf):
    out = report.crosstab_values(_banded(spark, sf), "obs", "band", BANDS, "y")
    return rounded(out, *[c for c in out.columns if c.endswith("_mean")])


@query(
    "band_rates",
    with_frame(
        f"SELECT {BANDS_SQL} AS band, round(avg(y), 6) AS rate, count(y) AS volume FROM frame GROUP BY 1"
    ),
)
def band_rates(spark, sf):
    return rounded(report.band_rates(_banded(spark, sf), "band", "y"), "rate")


@query(
    "secondary_rate",
    with_frame(
        f"""SELECT {BANDS_SQL} AS band, round(avg(l_extendedprice * l_discount / l_extendedprice), 6) AS secondary_rate
            FROM frame GROUP BY 1"""
    ),
)
def secondary_rate(spark, sf):
    rows = _banded(spark, sf).withColumn("granted", F.col("l_extendedprice") * F.col("l_discount"))
    return rounded(report.secondary_rate(rows, "band", "granted", "l_extendedprice"), "secondary_rate")


@query(
    "decile_rates",
    with_frame(
        f""", q AS (SELECT dataset, {_edges_sql('score')} AS e FROM frame GROUP BY dataset)
         SELECT dataset, CAST({_bin_sql('score')} AS INTEGER) AS decile, count(y) AS volume, round(avg(y), 6) AS rate
         FROM frame JOIN q USING (dataset) GROUP BY 1, 2"""
    ),
)
def decile_rates(spark, sf):
    return rounded(report.decile_rates(frame(spark, sf), "score", "y", "dataset"), "rate")


@query(
    "decile_rates_raw",
    with_frame(
        f""", q AS (SELECT {_edges_sql('o_totalprice')} AS e FROM frame)
         SELECT CAST({_bin_sql('o_totalprice')} AS INTEGER) AS decile, count(y) AS volume, round(avg(y), 6) AS rate
         FROM frame, q GROUP BY 1"""
    ),
)
def decile_rates_raw(spark, sf):
    return rounded(report.decile_rates(frame(spark, sf), "o_totalprice", "y"), "rate")


@query(
    "accumulation_points",
    with_frame(
        """, c AS (SELECT round(score, 3) AS score, count(*) AS n FROM frame GROUP BY 1)
         SELECT score, n, round(n / sum(n) OVER (), 2) AS share FROM c ORDER BY n DESC, score LIMIT 5"""
    ),
)
def accumulation_points(spark, sf):
    return report.accumulation_points(frame(spark, sf), "score")


@query(
    "predictor_band_profile",
    with_frame(
        f""", b AS (SELECT {BANDS_SQL} AS band, CAST(qty > 25 AS INTEGER) AS qty_dummie_high, CAST(p_size > 25 AS INTEGER) AS size_dummie_high FROM frame),
         c AS (SELECT 'qty_dummie_high' AS feature, band, count(*) AS n FROM b WHERE qty_dummie_high = 1 GROUP BY band UNION ALL
               SELECT 'size_dummie_high', band, count(*) FROM b WHERE size_dummie_high = 1 GROUP BY band)
         SELECT feature, band, n, round(n / sum(n) OVER (PARTITION BY feature), 6) AS share FROM c"""
    ),
)
def predictor_band_profile(spark, sf):
    rows = _banded(spark, sf).select(
        "band",
        (F.col("qty") > 25).cast("byte").alias("qty_dummie_high"),
        (F.col("p_size") > 25).cast("byte").alias("size_dummie_high"),
    )
    return rounded(report.predictor_band_profile(rows, ["qty_dummie_high", "size_dummie_high"], "band"), "share")


@query(
    "ratio_profile",
    with_frame(
        f""", b AS (SELECT CAST(l_extendedprice AS DOUBLE) AS a, CAST(disc100 AS DOUBLE) AS b,
             CASE WHEN disc100 = 0 THEN 0 ELSE l_extendedprice / disc100 END AS ratio, y FROM frame),
         q AS (SELECT {_edges_sql('a')} AS ea, {_edges_sql('b')} AS eb, {_edges_sql('ratio', 20)} AS er FROM b),
         p AS (SELECT 'by_left' AS part, {_bin_sql('a', 'ea')} AS bin, ratio, y FROM b, q UNION ALL
               SELECT 'by_right', {_bin_sql('b', 'eb')}, ratio, y FROM b, q UNION ALL
               SELECT 'by_ratio', {_bin_sql('ratio', 'er')}, ratio, y FROM b, q)
         SELECT part, CAST(bin AS INTEGER) AS bin, round(avg(ratio), 6) AS mean_ratio, round(avg(y), 6) AS rate, count(y) AS volume
         FROM p GROUP BY part, bin"""
    ),
)
def ratio_profile(spark, sf):
    return rounded(report.ratio_profile(frame(spark, sf), "l_extendedprice", "disc100", "y"), "mean_ratio", "rate")


@query(
    "modality_evolution",
    with_frame(
        """, l AS (SELECT 'l_returnflag' AS feature, obs, l_returnflag AS value, y FROM frame UNION ALL
              SELECT 'o_orderstatus', obs, o_orderstatus, y FROM frame)
         SELECT feature, obs, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY feature, obs), 6) AS share,
           round(avg(y), 6) AS rate FROM l GROUP BY feature, obs, value"""
    ),
)
def modality_evolution(spark, sf):
    out = report.modality_evolution(frame(spark, sf), "obs", ["l_returnflag", "o_orderstatus"], "y")
    return rounded(out, "share", "rate")


@query(
    "scope_summary",
    with_frame(
        """SELECT dataset, min(obs) AS min_obs, max(obs) AS max_obs, count(*) AS volume, round(avg(y), 3) AS criterion_rate,
           count(DISTINCT score) AS nb_of_bands FROM frame GROUP BY dataset"""
    ),
)
def scope_summary(spark, sf):
    return report.scope_summary(frame(spark, sf), "dataset", "obs", "y", "score")


# -- windows, top-k, sets ----------------------------------------------------------------------


@query(
    "quantile_bins",
    with_frame(
        f""", q AS (SELECT {_edges_sql('l_extendedprice')} AS e1, {_edges_sql('sc', 20)} AS e2 FROM frame)
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({_bin_sql('l_extendedprice', 'e1')} AS INTEGER) AS price_bin,
           CAST({_bin_sql('sc', 'e2')} AS INTEGER) AS sc_bin FROM frame, q"""
    ),
)
def quantile_bins(spark, sf):
    rows = frame(spark, sf).select(*KEY, "l_extendedprice", "sc")
    binned = ordering.several_quantile_bins(rows, {"l_extendedprice": (10, "price_bin"), "sc": (20, "sc_bin")})
    return binned.select(*KEY, "price_bin", "sc_bin")


@query(
    "score_deciles",
    with_frame(
        f""", p AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM frame),
         q AS (SELECT {_edges_sql('score')} AS e1, {_edges_sql('pred')} AS e2 FROM p)
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST({_bin_sql('score', 'e1')} AS INTEGER) AS deciles_pred_prob,
           CAST({_bin_sql('pred', 'e2')} AS INTEGER) AS deciles_predict FROM p, q"""
    ),
)
def score_deciles(spark, sf):
    rows = frame(spark, sf).withColumn("pred", (F.col("score") > 0.5).cast("int"))
    out = models.score_deciles(rows, {"score": "deciles_pred_prob", "pred": "deciles_predict"})
    return out.select(*KEY, "deciles_pred_prob", "deciles_predict")


@query(
    "top_correlated",
    with_frame(
        ", r AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS r FROM frame" for c in NUMERIC_FEATURES)
        + ") SELECT feature, round(r, 6) + 0 AS r, round(abs(r), 6) AS abs_r FROM r ORDER BY abs(r) DESC LIMIT 4"
    ),
)
def top_correlated(spark, sf):
    correlations = stats.corr_with_target(frame(spark, sf), NUMERIC_FEATURES, "y")
    return rounded(stats.top_correlated(correlations, 4), "r", "abs_r")


@query(
    "union_splits",
    with_frame("SELECT l_orderkey, y, CASE WHEN dataset = 'train' THEN score END AS score FROM frame"),
)
def union_splits(spark, sf):
    # stored, because each split of a joined frame would join again, and Spark gives a union of such joins to the same tasks
    rows = materialize(frame(spark, sf).select("l_orderkey", "y", "score", "dataset"), "splits")
    train = rows.filter("dataset = 'train'").select("l_orderkey", "y", "score")
    others = [rows.filter(F.col("dataset") == d).select("y", "l_orderkey") for d in ("test", "t1", "t2", "t3")]
    return report.union_splits(train, *others)


@query(
    "labelled_union",
    with_frame(
        """SELECT CASE dataset WHEN 'train' THEN 'Train' ELSE 'Test' END AS "Dataset", l_orderkey, y FROM frame
           WHERE dataset IN ('train', 'test')"""
    ),
)
def labelled_union(spark, sf):
    rows = materialize(frame(spark, sf).select("l_orderkey", "y", "dataset").filter("dataset in ('train', 'test')"), "splits")
    parts = {n: rows.filter(F.col("dataset") == n.lower()).select("l_orderkey", "y") for n in ("Train", "Test")}
    return report.labelled_union(parts)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax, l_discount FROM lineitem")
def distinct_rows(spark, sf):
    return report.distinct_rows(
        table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_tax", "l_discount")
    )
