"""Row-level feature engineering, cleaning and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import cleaning, encode, sampling
from scoreloom.queries.catalog import query
from scoreloom.queries.frame import KEY, frame, rounded, table, with_frame
from scoreloom.plans.hooks import register_hook, run_hook, target_hook

DATE_TEXTS = {
    "d_month": ("yyyy-MM", "%Y-%m"),
    "d_compact": ("yyyyMM", "%Y%m"),
    "d_dmy": ("ddMMyyyy", "%d%m%Y"),
    "d_ymd": ("yyyyMMdd", "%Y%m%d"),
    "d_iso": ("yyyy-MM-dd", "%Y-%m-%d"),
}
_MONTH = "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M')"
_DAY = "strftime(o_orderdate, '%Y-%m-%d 00:00')"


@query(
    "parse_dates",
    f"""SELECT o_orderkey, {_MONTH} AS d_month_date, {_MONTH} AS d_compact_date, {_DAY} AS d_dmy_date,
        {_DAY} AS d_ymd_date, {_DAY} AS d_iso_date FROM orders""",
)
def parse_dates(spark, sf):
    orders = table(spark, sf, "orders")
    texts = orders.select(
        "o_orderkey",
        "o_orderstatus",
        *[F.date_format("o_orderdate", java).alias(name) for name, (java, _) in DATE_TEXTS.items()],
    )
    parsed = encode.parse_dates(texts, ["o_orderstatus", *DATE_TEXTS])
    return parsed.select(
        "o_orderkey",
        *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in parsed.columns if c.endswith("_date")],
    )


@query(
    "date_diff_hours",
    """SELECT l_orderkey, l_linenumber, l_partkey,
         round(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9, 6) AS l_shipdate_diff_hours_o_orderdate,
         round(abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9, 6) AS o_orderdate_diff_hours_l_shipdate
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def date_diff_hours(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")
    out = encode.date_diff_hours(joined, ["l_shipdate", "o_orderdate"]).drop("l_shipdate", "o_orderdate")
    return rounded(out, *[c for c in out.columns if "_diff_hours_" in c])


@query(
    "date_parts",
    """SELECT event_id, CAST(day(ts) AS INTEGER) AS "ts_MonthDay_NB",
         CAST(isodow(ts) - 1 AS INTEGER) AS "ts_WeekDay_NB" FROM events""",
)
def date_parts(spark, sf):
    return encode.date_parts(table(spark, sf, "events").select("event_id", "ts"), ["ts"]).drop("ts")


@query(
    "high_cardinality_filter",
    "SELECT p_partkey, p_type FROM part",
)
def high_cardinality_filter(spark, sf):
    part = table(spark, sf, "part")
    kept = encode.high_cardinality_filter(part, ["p_name", "p_brand", "p_type"])
    return part.select("p_partkey", *kept)


@query("numeric_to_categorical", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem")
def numeric_to_categorical(spark, sf):
    lines = table(spark, sf, "lineitem")
    moved = encode.numeric_to_categorical(
        lines, ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
    return lines.select("l_orderkey", *moved)


@query(
    "one_hot",
    """SELECT o_orderkey,
         CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_dummie_O",
         CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_dummie_P",
         0 AS "o_orderstatus_dummie_nan" FROM orders""",
)
def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.one_hot(orders, ["o_orderstatus"]).drop("o_orderstatus")


@query(
    "category_codes",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE code END AS type_cat
       FROM part JOIN (SELECT p_type AS t, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code
                       FROM (SELECT DISTINCT p_type FROM part WHERE p_partkey % 7 <> 0)) ON p_type = t""",
)
def category_codes(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("type")
    )
    return encode.category_codes(part, "type").drop("type")


@query(
    "pairwise_ratios",
    with_frame(
        """, r AS (SELECT *, CASE WHEN disc100 <> 0 THEN CAST(qty AS DOUBLE)/disc100 END AS a,
             CAST(qty AS DOUBLE)/p_size AS b, CAST(disc100 AS DOUBLE)/p_size AS c FROM frame),
           m AS (SELECT avg(a) AS ma FROM r)
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(coalesce(a, ma), 6) AS qty_div_ratio_disc100, round(b, 6) AS qty_div_ratio_p_size,
           round(c, 6) AS disc100_div_ratio_p_size FROM r, m"""
    ),
)
def pairwise_ratios(spark, sf):
    rows = frame(spark, sf).select(*KEY, "qty", "disc100", "p_size")
    out = encode.pairwise_ratios(rows, ["qty", "disc100", "p_size"]).drop("qty", "disc100", "p_size")
    return rounded(out, *[c for c in out.columns if "_ratio_" in c])


@query(
    "ratios_for_kept",
    with_frame(
        """, r AS (SELECT *, CASE WHEN disc100 <> 0 THEN CAST(qty AS DOUBLE)/disc100 END AS a,
             CASE WHEN disc100 <> 0 THEN 1.0 END AS s, CAST(disc100 AS DOUBLE)/qty AS b FROM frame),
           m AS (SELECT avg(a) AS ma FROM r)
         SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 AS DOUBLE) AS qty_div_ratio_qty,
           round(coalesce(a, ma), 6) AS qty_div_ratio_disc100, round(b, 6) AS disc100_div_ratio_qty,
           CAST(1 AS DOUBLE) AS disc100_div_ratio_disc100 FROM r, m"""
    ),
)
def ratios_for_kept(spark, sf):
    rows = frame(spark, sf).select(*KEY, "qty", "disc100", "p_size")
    out = encode.pairwise_ratios(rows, ["qty", "disc100", "p_size"], ["qty_div_ratio_disc100"])
    out = out.drop("qty", "disc100", "p_size")
    return rounded(out, *[c for c in out.columns if "_ratio_" in c])


@query(
    "rule_predictors",
    with_frame(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(l_extendedprice / p_retailprice, 6) AS r_ratio,
           CAST(qty = 10 AS INTEGER) AS r_single, CAST(qty < 10 AS INTEGER) AS r_lt, CAST(qty > 10 AS INTEGER) AS r_gt,
           CAST(qty <= 10 AS INTEGER) AS r_le, CAST(qty >= 10 AS INTEGER) AS r_ge,
           CAST(qty >= 10 AND qty < 20 AS INTEGER) AS r_left, CAST(qty > 10 AND qty <= 20 AS INTEGER) AS r_right,
           CAST(qty >= 10 AND qty <= 20 AS INTEGER) AS r_both, CAST(qty > 10 AND qty < 20 AS INTEGER) AS r_open
         FROM frame"""
    ),
)
def rule_predictors(spark, sf):
    def on_qty(kind, cut):
        return {"type": kind, "raw_col": "qty", "cutpoint": cut}

    rules = {
        "r_ratio": {"type": "ratio", "raw_col_left": "l_extendedprice", "raw_col_right": "p_retailprice"},
        "r_single": on_qty("single", 10),
        "r_lt": on_qty("less_than", 10),
        "r_gt": on_qty("greater_than", 10),
        "r_le": on_qty("less_eq_to", 10),
        "r_ge": on_qty("greater_eq_to", 10),
        "r_left": on_qty("between_left_incl", [10, 20]),
        "r_right": on_qty("between_right_incl", [10, 20]),
        "r_both": on_qty("between_both_incl", [10, 20]),
        "r_open": on_qty("between", [10, 20]),
    }
    out = encode.rule_predictors(frame(spark, sf), rules).select(*KEY, *rules)
    return rounded(out, "r_ratio")


@query(
    "label_encode",
    """SELECT o_orderkey, code AS priority FROM orders JOIN (
         SELECT o_orderpriority AS p, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT o_orderpriority FROM orders)) ON o_orderpriority = p""",
)
def label_encode(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"))
    encoded, _ = encode.label_encode(orders, "priority")
    return encoded


@query(
    "coerce_numeric",
    """SELECT event_id, CAST(value > 0 AS INTEGER) AS flag, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts,
         CAST(user_id AS DOUBLE) AS text_number, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END AS part_number,
         code AS event_type
       FROM events JOIN (SELECT event_type AS t, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code
                         FROM (SELECT DISTINCT event_type FROM events)) ON event_type = t""",
)
def coerce_numeric(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        (F.col("value") > 0).alias("flag"),
        "ts",
        F.col("user_id").cast("string").alias("text_number"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise("n/a").alias("part_number"),
        "event_type",
    )
    for column in ("event_id", "flag", "ts", "text_number", "part_number", "event_type"):
        rows = encode.coerce_numeric(rows, column)
    return rows


BANDS_SQL = """CASE WHEN score <= 0.2 THEN '(-0.001, 0.2]' WHEN score <= 0.35 THEN '(0.2, 0.35]'
  WHEN score <= 0.5 THEN '(0.35, 0.5]' WHEN score <= 1 THEN '(0.5, 1.0]' ELSE 'nan' END"""
CUT_OFFS = [0, 0.2, 0.35, 0.5, 1]


@query("score_bands", with_frame(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {BANDS_SQL} AS band FROM frame"))
def score_bands(spark, sf):
    return encode.score_bands(frame(spark, sf), "score", CUT_OFFS, "band").select(*KEY, "band")


_LABEL_NAMES = """CASE p_partkey % 4 WHEN 0 THEN p_type || '_binned_dummie_' || p_brand || '_x'
   WHEN 1 THEN 'a_div_ratio_' || p_type || '_binned_dummie_1_to_2' WHEN 2 THEN p_brand || '_tree_' || p_size
   ELSE p_name || '_div_ratio_b' END"""


@query(
    "feature_labels",
    f"""WITH n AS (SELECT p_partkey, {_LABEL_NAMES} AS feature FROM part),
       s AS (SELECT *, CASE WHEN contains(feature, 'dummie_') THEN split_part(feature, '_dummie_', 1)
                 WHEN contains(feature, 'tree') THEN split_part(feature, '_tree', 1) ELSE feature END AS head,
               CASE WHEN contains(feature, 'dummie_') THEN substr(feature, strpos(feature, '_dummie_') + 8)
                 WHEN contains(feature, 'tree') THEN '> ' || substr(feature, strpos(feature, '_tree') + 5) ELSE '' END AS tail FROM n)
       SELECT p_partkey, feature, replace(replace(head, '_binned', ''), '_div_ratio_', ' / ') AS mouchard_name,
         replace(tail, '_', ' ') AS cut_off_value FROM s""",
)
def feature_labels(spark, sf):
    return encode.feature_labels(_named_parts(table(spark, sf, "part")), "feature")


def _named_parts(part):
    kind = F.col("p_partkey") % 4
    name = (
        F.when(kind == 0, F.concat("p_type", F.lit("_binned_dummie_"), "p_brand", F.lit("_x")))
        .when(kind == 1, F.concat(F.lit("a_div_ratio_"), "p_type", F.lit("_binned_dummie_1_to_2")))
        .when(kind == 2, F.concat("p_brand", F.lit("_tree_"), F.col("p_size").cast("string")))
        .otherwise(F.concat("p_name", F.lit("_div_ratio_b")))
    )
    return part.select("p_partkey", name.alias("feature"))


@query(
    "signal_flag",
    with_frame(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(score >= 0.5 AND disc100 * 10000 > 40000 AS INTEGER) AS signal_up,
           CAST(score >= 0.5 AND disc100 * 10000 <= 40000 AS INTEGER) AS signal_down,
           CAST(score >= 0.5 AS INTEGER) AS signal_only FROM frame"""
    ),
)
def signal_flag(spark, sf):
    rows = encode.signal_flag(frame(spark, sf), "score", 0.5, "disc100", 40000, "up", "signal_up")
    rows = encode.signal_flag(rows, "score", 0.5, "disc100", 40000, "down", "signal_down")
    rows = encode.signal_flag(rows, "score", 0.5, out="signal_only")
    return rows.select(*KEY, "signal_up", "signal_down", "signal_only")


@query(
    "add_run_constants",
    """SELECT event_id, value, 'EURUSD' AS symbol, 'up' AS direction, '1.2' AS version, 10 AS tp, 5 AS sl, 60 AS period FROM events""",
)
def add_run_constants(spark, sf):
    return encode.add_run_constants(
        table(spark, sf, "events").select("event_id", "value"),
        {"symbol": "EURUSD", "direction": "up", "version": "1.2", "tp": 10, "sl": 5, "period": 60},
    )


# -- cleaning ----------------------------------------------------------------------------------


@query(
    "outliers",
    """WITH s AS (SELECT avg(value) AS a, stddev_pop(value) AS sd FROM events)
       SELECT event_id, CASE WHEN abs((value - a) / sd) >= 3 THEN NULL ELSE round(value, 6) END AS value FROM events, s""",
)
def outliers(spark, sf):
    treated = cleaning.treat_outliers(table(spark, sf, "events").select("event_id", "value"), ["value"])
    return rounded(treated, "value")


def _gappy(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"),
    )


_GAPPY = """g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type FROM events)"""


@query(
    "missing_delete",
    f"WITH {_GAPPY} SELECT event_id, round(value, 6) AS value, event_type FROM g WHERE value IS NOT NULL AND event_type IS NOT NULL",
)
def missing_delete(spark, sf):
    return rounded(cleaning.missing_delete(_gappy(spark, sf)), "value")


@query(
    "missing_mean",
    f"""WITH {_GAPPY} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM g)), 6) AS value, event_type
        FROM g WHERE event_type IS NOT NULL""",
)
def missing_mean(spark, sf):
    return rounded(cleaning.missing_mean(_gappy(spark, sf)), "value")


@query(
    "missing_median",
    f"""WITH {_GAPPY} SELECT event_id,
        round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM g)), 6) AS value, event_type
        FROM g WHERE event_type IS NOT NULL""",
)
def missing_median(spark, sf):
    return rounded(cleaning.missing_median(_gappy(spark, sf)), "value")


@query(
    "missing_constant",
    f"""WITH {_GAPPY} SELECT event_id, round(coalesce(value, 0), 6) AS value, coalesce(event_type, 'other') AS event_type,
        CASE WHEN event_id % 5 = 0 THEN '1900-01-01' ELSE '2024-01-01' END AS day,
        CASE WHEN event_id % 3 = 0 THEN true ELSE false END AS flag,
        CASE WHEN event_id % 4 = 0 THEN 'MissingInformation' ELSE 'x' END AS note FROM g""",
)
def missing_constant(spark, sf):
    rows = _gappy(spark, sf).select(
        "*",
        F.when(F.col("event_id") % 5 != 0, F.lit("2024-01-01").cast("timestamp")).alias("day"),
        F.when(F.col("event_id") % 3 != 0, F.lit(False)).alias("flag"),
        F.when(F.col("event_id") % 4 != 0, F.lit("x")).alias("note"),
    )
    filled = cleaning.missing_constant(rows, {"event_type": "other"})
    return rounded(filled.withColumn("day", F.date_format("day", "yyyy-MM-dd")), "value")


@query(
    "nan_inspector",
    f"""WITH {_GAPPY} SELECT 'value' AS column_name, count(*) AS null_rows FROM g WHERE value IS NULL
        UNION ALL SELECT 'event_type', count(*) FROM g WHERE event_type IS NULL
        UNION ALL SELECT 'any', count(*) FROM g WHERE value IS NULL OR event_type IS NULL""",
)
def nan_inspector(spark, sf):
    return cleaning.nan_inspector(_gappy(spark, sf), ["event_id", ["value", "event_type"]])


# -- sampling ----------------------------------------------------------------------------------


_HASH = "(o_orderkey * 48271) % 2147483647"


def _hashed_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        (F.col("o_orderpriority") <= "1-URGENT").cast("int").alias("late"),
        ((F.col("o_orderkey") * 48271) % 2147483647).alias("h"),
    )


@query(
    "undersample_binary",
    f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <= '1-URGENT' THEN 1 ELSE 0 END AS late, {_HASH} AS h FROM orders),
        s AS (SELECT *, row_number() OVER (PARTITION BY late ORDER BY h, o_orderkey) AS rn,
               count(*) FILTER (late = 1) OVER () AS ones, count(*) FILTER (late = 0) OVER () AS zeros FROM o)
        SELECT o_orderkey, late FROM s WHERE rn <= least(ones, zeros)""",
)
def undersample_binary(spark, sf):
    sampled = sampling.undersample_binary(_hashed_orders(spark, sf), "late", ["h", "o_orderkey"], 1.0)
    return sampled.select("o_orderkey", "late")


@query(
    "undersample_multiclass",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority, {_HASH} AS h FROM orders),
        s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS rn FROM o),
        m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))
        SELECT o_orderkey, o_orderpriority FROM s, m WHERE rn <= least""",
)
def undersample_multiclass(spark, sf):
    sampled = sampling.undersample_multiclass(_hashed_orders(spark, sf), "o_orderpriority", ["h", "o_orderkey"])
    return sampled.select("o_orderkey", "o_orderpriority")


# -- hooks -------------------------------------------------------------------------------------


@register_hook("open_orders")
def _open_orders(df):
    return df.filter(F.col("o_orderstatus") == "O").withColumn("price_k", F.round(F.col("o_totalprice") / 1000, 3))


@query(
    "custom_transform",
    "SELECT o_orderkey, round(o_totalprice / 1000, 3) AS price_k FROM orders WHERE o_orderstatus = 'O'",
)
def custom_transform(spark, sf):
    return run_hook(table(spark, sf, "orders"), "open_orders").select("o_orderkey", "price_k")


@query(
    "custom_criterion",
    """SELECT o_orderkey, CAST(o_totalprice > 100000 AS INTEGER) AS criterion, 'train' AS use FROM orders
       UNION ALL SELECT o_orderkey, NULL, 'predict' FROM orders""",
)
def custom_criterion(spark, sf):
    def high_price(df, for_prediction):
        value = F.lit(None).cast("int") if for_prediction else (F.col("o_totalprice") > 100000).cast("int")
        return df.withColumn("criterion", value)

    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    train = target_hook(orders, high_price, for_prediction=False).withColumn("use", F.lit("train"))
    new = target_hook(orders, high_price, for_prediction=True).withColumn("use", F.lit("predict"))
    return train.unionByName(new).drop("o_totalprice")
