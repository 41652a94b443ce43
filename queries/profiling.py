"""Summaries, correlations, distributions and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, rounded
from tablelab.operators import dashboard as dash
from tablelab.operators import eda
from tablelab.operators.counts import value_counts

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPS = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM {orders}"""


def _lines(t):
    return t.lineitem.select(*[(F.col(c) + 0.0).alias(c) for c in LINE_NUMBERS])


def _union(parts):
    return " UNION ALL ".join(parts)


@query("e1_shape", "SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def e1(t):
    return eda.shape(t.lineitem)


@query("e1_e18_column_types", _union(
    f"SELECT {i}::BIGINT AS \"position\", '{c}' AS \"column\", '{k}' AS dtype, count(*) FILTER ({c} IS NULL)::BIGINT AS missing FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM orders)"
    for i, (c, k) in enumerate((("o_orderkey", "bigint"), ("price", "double"), ("priority", "string"), ("status", "string")))))
def e18(t):
    return eda.column_types(t.sql(GAPS))


def _summary_sql(table, columns):
    return _union(
        f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min, "
        f"round(quantile_cont({c}, 0.25), 4)::DOUBLE AS q25, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS q50, round(quantile_cont({c}, 0.75), 4)::DOUBLE AS q75, "
        f"round(max({c}), 4)::DOUBLE AS max, (count(*) - count({c}))::BIGINT AS missing FROM {table}"
        for c in columns
    )


@query("e2_numeric_summary", _summary_sql("lineitem", LINE_NUMBERS))
def e2(t):
    return rounded(eda.numeric_summary(t.lineitem, LINE_NUMBERS))


@query("e2_numeric_summary_sketched", _summary_sql("lineitem", LINE_NUMBERS))
def e2_sketched(t):
    return rounded(eda.numeric_summary(t.lineitem, LINE_NUMBERS, exact_rows=0))


@query("e2_summary_with_gaps", _summary_sql("(SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)", ["price"]))
def e2_gaps(t):
    return rounded(eda.numeric_summary(t.sql(GAPS), ["price"]))


@query("e3_categorical_summary", _union(
    f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS count, count(*)::BIGINT AS "unique", arg_min(v, (-n, v)) AS top, max(n)::BIGINT AS freq,
    (SELECT count(*) FROM orders) - sum(n)::BIGINT AS missing FROM (SELECT {e} AS v, count(*) AS n FROM orders WHERE {e} IS NOT NULL GROUP BY 1)"""
    for c, e in (("priority", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END"), ("status", "o_orderstatus"))))
def e3(t):
    return eda.categorical_summary(t.sql(GAPS), ["priority", "status"])


@query("e4_time_summary", """SELECT 'o_orderdate' AS "column", count(*)::BIGINT AS count, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max, 0::BIGINT AS missing FROM orders""")
def e4(t):
    return eda.time_summary(t.orders, ["o_orderdate"])


def _pairs_sql(table, names, digits=4):
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return _union(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN round(corr({a}, {b}), {digits}) END AS correlation FROM {table}"
        for a, b in pairs
    )


@query("e5_pearson_pairs", _pairs_sql("(SELECT *, 1.0 AS flat FROM lineitem)", [*LINE_NUMBERS, "flat"]))
def e5(t):
    return rounded(eda.correlation_pairs(_lines(t).withColumn("flat", F.lit(1.0))))


@query("e5_correlation_matrix", "WITH u AS (" + _pairs_sql("lineitem", LINE_NUMBERS) + ") SELECT * FROM u UNION ALL SELECT column_b, column_a, correlation FROM u UNION ALL "
       + _union(f"SELECT '{c}', '{c}', 1.0 FROM lineitem HAVING count(*) > 0" for c in LINE_NUMBERS))
def e5_matrix(t):
    return eda.correlation_matrix(_lines(t))


@query("e6_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
  SELECT 'p_size' AS column_a, 'p_retailprice' AS column_b, round(corr(a, b), 4) AS correlation FROM r""")
def e6(t):
    return rounded(eda.correlation_pairs(t.part.select("p_size", "p_retailprice"), method="spearman"))


@query("e7_kendall", """WITH d AS (SELECT p_size AS x, floor(p_retailprice / 20) AS y FROM part), g AS (SELECT x, y, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2),
  p AS (SELECT sum(CASE WHEN a.x < b.x AND a.y < b.y THEN a.n * b.n ELSE 0 END) AS c, sum(CASE WHEN a.x < b.x AND a.y > b.y THEN a.n * b.n ELSE 0 END) AS e FROM g a, g b),
  tx AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*)::DOUBLE AS n FROM d GROUP BY x)), ty AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*)::DOUBLE AS n FROM d GROUP BY y)),
  z AS (SELECT count(*)::DOUBLE * (count(*) - 1) / 2 AS v FROM d)
  SELECT 'x' AS column_a, 'y' AS column_b, round((c - e) / sqrt((z.v - tx.v) * (z.v - ty.v)), 4) AS correlation FROM p, tx, ty, z""")
def e7(t):
    d = t.part.select(F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 20).alias("y"))
    return rounded(eda.correlation_pairs(d, method="kendall"))


def _histogram_sql(table, columns, bins, by=""):
    g = f"{by}, " if by else ""
    return _union(
        f"""SELECT {'s.' + by + ',' if by else ''} '{c}' AS "column", s.bin::BIGINT AS bin, round(r.lo + s.bin * (r.hi - r.lo) / {bins}, 4) AS lower, round(r.lo + (s.bin + 1) * (r.hi - r.lo) / {bins}, 4) AS upper, coalesce(h.n, 0)::BIGINT AS n
        FROM (SELECT {g} bin FROM (SELECT {'DISTINCT ' + by if by else '1 AS one'} FROM {table} {'' if by else 'LIMIT 1'}), (SELECT unnest(range({bins})) AS bin)) s
        CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}) r
        LEFT JOIN (SELECT {g} least(floor(({c} - r2.lo) / ((r2.hi - r2.lo) / {bins})), {bins - 1}) AS bin, count(*) AS n FROM {table}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {table}) r2 GROUP BY {g} 2) h
        ON h.bin = s.bin {'AND h.' + by + ' = s.' + by if by else ''}""".replace(f"GROUP BY {g} 2", f"GROUP BY {g} {'2' if by else '1'}")
        for c in columns
    )


@query("e8_histogram", _histogram_sql("lineitem", ["l_quantity", "l_extendedprice"], 20))
def e8(t):
    return rounded(eda.histogram(t.lineitem, ["l_quantity", "l_extendedprice"], 20))


@query("e8_histogram_null_group", "WITH d AS (SELECT nullif(l_returnflag, 'N') AS l_returnflag, l_quantity AS v, min(l_quantity) OVER () AS lo, max(l_quantity) OVER () AS hi FROM lineitem), c AS (SELECT l_returnflag, least(floor((v - lo) / ((hi - lo) / 7)), 6)::BIGINT AS bin, count(*) AS n FROM d GROUP BY 1, 2) SELECT l_returnflag, 'l_quantity' AS \"column\", bin, n::BIGINT AS n FROM c")
def e8_null(t):
    d = t.lineitem.select(F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), "l_quantity")
    return eda.histogram(d, ["l_quantity"], 7, by=["l_returnflag"]).filter("n > 0").select("l_returnflag", "column", "bin", "n")


@query("e8_moments", """SELECT 'l_quantity' AS "column", round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, round(stddev_samp(l_quantity), 4) AS std FROM lineitem""")
def e8_moments(t):
    return rounded(eda.distributions(t.lineitem.select("l_quantity"))["moments"])


@query("e9_top_values", _union(
    f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, {c})::INTEGER AS rank FROM part GROUP BY {c}) WHERE rank <= 10"""
    for c in ("p_brand", "p_type", "p_name")))
def e9(t):
    return value_counts(t.part, ["p_brand", "p_type", "p_name"], 10)


@query("e10_report", _summary_sql("orders", ["o_totalprice"]))
def e10(t):
    report = eda.eda_report(t.orders.select("o_totalprice", "o_orderstatus"), correlation=False, distribution=False)
    return rounded(report["numeric"])


@query("e11_duplicate_counts", "SELECT count(*)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents))::BIGINT AS unique_rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)))::BIGINT AS duplicate_rows FROM documents")
def e11(t):
    return eda.duplicate_counts(t.documents.select("text"))


@query("e12_describe_filled", """SELECT 'v' AS "column", count(v)::BIGINT AS count, coalesce(round(avg(v), 4), 0)::DOUBLE AS mean, coalesce(round(stddev_samp(v), 4), 0)::DOUBLE AS std, coalesce(round(min(v), 4), 0)::DOUBLE AS min,
  coalesce(round(quantile_cont(v, 0.25), 4), 0)::DOUBLE AS q25, coalesce(round(quantile_cont(v, 0.5), 4), 0)::DOUBLE AS q50, coalesce(round(quantile_cont(v, 0.75), 4), 0)::DOUBLE AS q75, coalesce(round(max(v), 4), 0)::DOUBLE AS max
  FROM (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS v FROM customer)
  UNION ALL SELECT 'w', 0, 0, 0, 0, 0, 0, 0, 0 FROM customer HAVING count(*) > 0""")
def e12(t):
    from tablelab.functions.columns import normalize_nulls

    d = t.customer.select(
        F.when(F.col("c_custkey") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal")).alias("v"),
        F.lit(None).cast("double").alias("w"),
    )
    return rounded(eda.describe_filled(normalize_nulls(d)))


HEALTH_SQL = """WITH d AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice / 20000) END AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM orders),
  a AS (SELECT count(*) AS n, count(*) FILTER (price IS NULL) + count(*) FILTER (priority IS NULL) + count(*) FILTER (status IS NULL) AS m FROM d),
  u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM d)), x AS (SELECT n, m, n - k AS dups, round(100.0 * m / (3 * n), 1) AS mp, 100.0 * (n - k) / n AS dp FROM a, u) """


@query("e13_p2_health", HEALTH_SQL + "SELECT n::BIGINT AS n_rows, m::BIGINT AS missing_cells, dups::BIGINT AS duplicate_rows, mp AS missing_pct, round(dp, 4) AS duplicate_pct, greatest(0, round(100 - mp * 1.5 - least(dp, 20)))::BIGINT AS health FROM x")
def e13(t):
    d = t.sql("SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice / 20000) END AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM {orders}")
    return eda.health(d)


@query("e14_top_missing", "SELECT * FROM (SELECT 'price' AS \"column\", round(100.0 * avg(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END), 2) AS missing_pct FROM orders UNION ALL SELECT 'priority', round(100.0 * avg(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END), 2) FROM orders)")
def e14(t):
    return eda.top_missing(t.sql(GAPS))


@query("e15_class_shares", """WITH c AS (SELECT toxic AS class, count(*) AS n FROM labels GROUP BY 1), w AS (SELECT sum(n) AS s, count(*) AS k, max(n) AS hi, min(n) AS lo FROM c)
  SELECT class, n::BIGINT AS n, round(n / s, 4) AS share, k::BIGINT AS n_classes, round(round(hi / s, 4) / greatest(round(lo / s, 4), 1e-9), 2) AS imbalance_ratio FROM c, w""")
def e15(t):
    return eda.class_shares(t.labels, "toxic")


@query("e16_target_moments", "SELECT round(avg(o_totalprice), 4) AS target_mean, round(stddev_samp(o_totalprice), 4) AS target_std, round(skewness(o_totalprice), 4) AS target_skew, round(min(o_totalprice), 4) AS target_min, round(max(o_totalprice), 4) AS target_max FROM orders")
def e16(t):
    return eda.target_moments(t.orders, "o_totalprice")


@query("e17_most_skewed", "SELECT * FROM (" + _union(f"SELECT '{c}' AS \"column\", round(abs(skewness({c})), 3) AS abs_skew FROM lineitem" for c in LINE_NUMBERS) + ") ORDER BY abs_skew DESC, \"column\" LIMIT 3")
def e17(t):
    return eda.most_skewed(_lines(t), n=3)


@query("p1_column_roles", """SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'), ('order id', 'id'), ('customer email', 'email'), ('flag', 'boolean'), ('level', 'categorical'), ('amount_text', 'numeric'), ('clerk', 'text')) v("column", role)
  WHERE (SELECT count(*) FROM orders) > 0""")
def p1(t):
    d = t.orders.select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.col("o_orderkey").alias("order id"),
        F.lit("x@y.com").alias("customer email"), (F.col("o_orderkey") % 2).alias("flag"),
        (F.col("o_orderkey") % 7).alias("level"), F.col("o_custkey").cast("string").alias("amount_text"),
        F.concat(F.lit("clerk "), F.col("o_orderkey"), F.lit(" z")).alias("clerk"),
    )
    return dash.roles_table(d)


@query("p3_grouping_columns", "SELECT 1::BIGINT AS pick, 'o_orderstatus' AS \"column\" FROM orders HAVING count(*) > 0 UNION ALL SELECT 2, 'o_orderpriority' FROM orders HAVING count(*) > 0")
def p3(t):
    picked = dash.pick_groups(t.orders)
    return t.spark.createDataFrame([(i + 1, c) for i, c in enumerate(picked)], "pick bigint, `column` string")


@query("p4_strongest_pair", "SELECT * FROM (" + _pairs_sql("lineitem", LINE_NUMBERS) + ") ORDER BY abs(correlation) DESC LIMIT 1")
def p4(t):
    return rounded(dash.strongest_pair(_lines(t)))


def _nations(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


NATIONS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("p5_top_group_means", f"SELECT n_name, round(avg(o_totalprice), 4) AS avg_o_totalprice FROM {NATIONS} GROUP BY 1 ORDER BY avg(o_totalprice) DESC, n_name LIMIT 10")
def p5(t):
    return rounded(dash.top_group_means(_nations(t), "n_name", "o_totalprice", 10))


@query("p6_pivot_means", "SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 4) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 4) AS O FROM lineitem GROUP BY 1")
def p6(t):
    return rounded(dash.pivot_means(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"]))


@query("p6_grouped_means", "SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS avg_o_totalprice FROM orders GROUP BY 1, 2")
def p6_long(t):
    return rounded(dash.group_means(t.orders, ["o_orderpriority", "o_orderstatus"], ["o_totalprice"]))


@query("p7_crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def p7(t):
    return dash.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("p7_group_counts", "SELECT c_mktsegment, n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def p7_long(t):
    return dash.group_counts(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), ["c_mktsegment", "n_name"])


@query("p8_row_shares", "SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 4) AS pct FROM orders GROUP BY 1, 2")
def p8(t):
    return rounded(dash.row_shares(t.orders, "o_orderpriority", "o_orderstatus"))


@query("p9_top_categories", "WITH k AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8) SELECT CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE 'Other' END AS p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1")
def p9(t):
    return dash.group_counts(dash.top_categories(t.part.select("p_brand"), "p_brand"), ["p_brand"])


@query("p10_value_shares", "SELECT event_type AS value, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def p10(t):
    return rounded(dash.value_shares(t.events, "event_type"))


@query("p11_group_histogram", _histogram_sql("lineitem", ["l_extendedprice"], 22, "l_returnflag"))
def p11(t):
    return rounded(dash.group_histogram(t.lineitem, "l_returnflag", "l_extendedprice"))


BOX_SQL = """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
  SELECT event_type, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, count(*)::BIGINT AS n, round(min(value), 4) AS min, round(max(value), 4) AS max,
  round(min(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 4) AS whisker_low,
  round(max(CASE WHEN value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN value END), 4) AS whisker_high,
  count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::BIGINT AS outliers
  FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3"""


@query("p12_boxes", BOX_SQL)
def p12(t):
    return rounded(dash.box_statistics(t.events, "event_type", "value"))


@query("p12_boxes_sketched", BOX_SQL)
def p12_sketched(t):
    return rounded(dash.box_statistics(t.events, "event_type", "value", exact_rows=0))


@query("p12_boxes_null_sliced", BOX_SQL.replace("FROM events GROUP BY 1", "FROM e GROUP BY 1").replace("WITH q", "WITH e AS (SELECT nullif(event_type, 'view') AS event_type, CASE WHEN event_id % 11 > 0 THEN value END AS value FROM events), q").replace("FROM events JOIN q USING (event_type)", "FROM (SELECT e.*, q1, median, q3 FROM e JOIN q ON e.event_type IS NOT DISTINCT FROM q.event_type WHERE value IS NOT NULL)"))
def p12_null_sliced(t):
    d = t.events.select(F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("value"))
    return rounded(dash.box_statistics(d, "event_type", "value", top=None, exact_rows=0))


@query("p12_box_points", """WITH e AS (SELECT event_id, nullif(event_type, 'view') AS event_type, value FROM events), q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM e GROUP BY 1)
  SELECT event_id, e.event_type, CASE WHEN value < a - 1.5 * (z - a) THEN 'below' ELSE 'above' END AS side FROM e JOIN q ON e.event_type IS NOT DISTINCT FROM q.event_type WHERE value NOT BETWEEN a - 1.5 * (z - a) AND z + 1.5 * (z - a)""")
def p12_points(t):
    d = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), "value")
    return dash.box_points(d, "event_type", "value", top=None, exact_rows=0).select("event_id", "event_type", "side")


@query("p13_percentile_bar", "SELECT 'value' AS \"column\", round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q25, round(median(value), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS max FROM events")
def p13(t):
    return rounded(dash.percentile_bar(t.events, "value"))


@query("p14_linear_fit", "SELECT count(*)::BIGINT AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem")
def p14(t):
    return rounded(dash.linear_fit(t.lineitem, "l_quantity", "l_extendedprice"))


@query("p15_density", """WITH m AS (SELECT count(*) AS n, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS z FROM events),
  c AS (SELECT least(floor((value - lo) / ((hi - lo) / 2048)), 2047) AS bin, count(*) AS n, avg(value) AS center FROM events, m GROUP BY 1),
  g AS (SELECT a + i * (z - a) / 299 AS x FROM m, (SELECT unnest(range(300)) AS i))
  SELECT 'value' AS "column", round(x, 4) AS x, round(sum(c.n * exp(-0.5 * pow((x - center) / (s * pow(m.n, -0.2)), 2))) / (any_value(m.n) * any_value(s * pow(m.n, -0.2)) * sqrt(2 * pi())), 4) AS density FROM g, c, m GROUP BY x""")
def p15(t):
    return rounded(dash.density(t.events, "value"))


@query("p15_density_z_scored", """WITH e AS (SELECT (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders) AS value FROM orders),
  m AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS z FROM e),
  c AS (SELECT least(floor((value - lo) / ((hi - lo) / 2048)), 2047) AS bin, count(*) AS n, avg(value) AS center FROM e, m GROUP BY 1),
  g AS (SELECT i, a + i * (z - a) / 299 AS x FROM m, (SELECT unnest(range(300)) AS i))
  SELECT 'o_totalprice' AS "column", round(x, 4) AS x, round(sum(c.n * exp(-0.5 * pow((x - center) / pow(m.n, -0.2), 2))) / (any_value(m.n) * any_value(pow(m.n, -0.2)) * sqrt(2 * pi())), 3) AS density FROM g, c, m GROUP BY i, x""")
def p15_z(t):
    return dash.density(t.orders, "o_totalprice", standardise=True).select("column", F.round("x", 4).alias("x"), F.round("density", 3).alias("density"))


@query("p16_z_scored_boxes", "WITH m AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders), z AS (SELECT (o_totalprice - m) / (s + 1e-9) AS z FROM orders, m) SELECT 'o_totalprice' AS \"column\", count(*)::BIGINT AS n, round(quantile_cont(z, 0.25), 4) AS q1, round(median(z), 4) AS median, round(quantile_cont(z, 0.75), 4) AS q3, count(*) FILTER (abs(z) > 3)::BIGINT AS beyond_3_sigma FROM z")
def p16(t):
    return rounded(dash.z_scored_boxes(t.orders, ["o_totalprice"]))


@query("p17_value_ranges", "SELECT 'o_totalprice' AS \"column\", round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, round(max(o_totalprice), 4) AS max, round(max(o_totalprice) - min(o_totalprice), 4) AS range, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr FROM orders")
def p17(t):
    return rounded(dash.value_ranges(t.orders, ["o_totalprice"]))


@query("p18_ecdf", "SELECT l_quantity AS value, count(*)::BIGINT AS n, round(sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER (), 4) AS cumulative FROM lineitem GROUP BY 1")
def p18(t):
    return rounded(dash.ecdf(t.lineitem, "l_quantity"))


@query("p18_ecdf_sliced", "SELECT p_retailprice AS value, count(*)::BIGINT AS n, round(sum(count(*)) OVER (ORDER BY p_retailprice) / sum(count(*)) OVER (), 4) AS cumulative FROM part GROUP BY 1")
def p18_sliced(t):
    return rounded(dash.ecdf(t.part, "p_retailprice", rows_per_slice=500))


@query("p19_heatmap", "WITH u AS (" + _pairs_sql("lineitem", LINE_NUMBERS, 2) + ") SELECT * FROM u")
def p19(t):
    return rounded(eda.correlation_pairs(_lines(t)), 2)


@query("p20_scaled_group_means", """WITH g AS (SELECT l_returnflag, 'l_quantity' AS "column", avg(l_quantity) AS m FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_extendedprice', avg(l_extendedprice) FROM lineitem GROUP BY 1)
  SELECT l_returnflag, "column", round((m - min(m) OVER (PARTITION BY "column")) / (max(m) OVER (PARTITION BY "column") - min(m) OVER (PARTITION BY "column") + 1e-9), 4) AS scaled_mean FROM g""")
def p20(t):
    return rounded(dash.scaled_group_means(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"]))


@query("p21_mean_intervals", f"""WITH g AS (SELECT n_name, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) / sqrt(count(*)) AS sem, count(*) AS n FROM {NATIONS} GROUP BY 1 ORDER BY 1 LIMIT 12)
  SELECT n_name, round(mean, 4) AS mean, round(sem, 4) AS sem, n::BIGINT AS n, round(mean - 1.96 * sem, 4) AS low, round(mean + 1.96 * sem, 4) AS high FROM g WHERE n > 1""")
def p21(t):
    return rounded(dash.mean_intervals(_nations(t), "n_name", "o_totalprice"))


SPINE = "(SELECT unnest(generate_series((SELECT date_trunc('{u}', min(o_orderdate)) FROM orders)::TIMESTAMP, (SELECT date_trunc('{u}', max(o_orderdate)) FROM orders)::TIMESTAMP, INTERVAL {n} MONTH)) AS b)"


@query("p22_monthly_means", f"SELECT strftime(b, '%Y-%m-%d') AS bucket, round(avg(o_totalprice), 4) AS avg_o_totalprice, count(o_orderkey)::BIGINT AS n FROM {SPINE.format(u='month', n=1)} LEFT JOIN orders ON date_trunc('month', o_orderdate) = b GROUP BY 1")
def p22(t):
    return rounded(dash.time_means(t.orders, "o_orderdate", ["o_totalprice"])).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


def _totals_of_means(means):
    """Means of cents often end right between two rounded values; times the count they are whole cents again."""
    total = F.round(F.col("avg_o_totalprice") * F.col("n"), 2).alias("total")
    return means.filter("n > 0").select("o_orderstatus", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), total, "n")


@query("p22_monthly_means_by_status", "SELECT o_orderstatus, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS bucket, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def p22_by(t):
    return _totals_of_means(dash.time_means(t.orders, "o_orderdate", ["o_totalprice"], by=["o_orderstatus"]))


@query("p22_monthly_means_null_group", "SELECT nullif(o_orderstatus, 'O') AS o_orderstatus, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS bucket, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def p22_null(t):
    d = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
    return _totals_of_means(dash.time_means(d, "o_orderdate", ["o_totalprice"], by=["o_orderstatus"]))


@query("p23_monthly_counts", f"SELECT strftime(b, '%Y-%m-%d') AS bucket, count(o_orderkey)::BIGINT AS n FROM {SPINE.format(u='month', n=1)} LEFT JOIN orders ON date_trunc('month', o_orderdate) = b GROUP BY 1")
def p23(t):
    return dash.time_counts(t.orders, "o_orderdate").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("p24_normalised_trends", "WITH g AS (SELECT date_trunc('month', o_orderdate) AS b, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT strftime(b, '%Y-%m-%d') AS bucket, 'o_totalprice' AS metric, round((v - avg(v) OVER ()) / (stddev_samp(v) OVER () + 1e-9), 4) AS z FROM g")
def p24(t):
    return rounded(dash.normalised_trends(t.orders, "o_orderdate", ["o_totalprice"])).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("p25_quarterly_counts", "SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS bucket, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def p25(t):
    return dash.time_group_counts(t.orders, "o_orderdate", "o_orderstatus", ["F", "O", "P"]).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query("p26_missing_bands", "SELECT \"column\", p AS missing_pct, CASE WHEN p < 5 THEN 'low' WHEN p > 20 THEN 'high' ELSE 'moderate' END AS band FROM (SELECT 'o_orderkey' AS \"column\", 0.0 AS p FROM orders HAVING count(*) > 0 UNION ALL SELECT 'price', round(100.0 * avg(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END), 1) FROM orders UNION ALL SELECT 'priority', round(100.0 * avg(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END), 1) FROM orders UNION ALL SELECT 'status', 0.0 FROM orders HAVING count(*) > 0)")
def p26(t):
    return dash.missing_bands(t.sql(GAPS))


@query("p27_null_map", """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)
  SELECT r::BIGINT AS "row", (o_orderkey IS NULL)::INTEGER AS null_o_orderkey, (price IS NULL)::INTEGER AS null_price, (priority IS NULL)::INTEGER AS null_priority, (status IS NULL)::INTEGER AS null_status FROM d WHERE r % greatest(1, (SELECT count(*) FROM orders) // 150) = 0""")
def p27(t):
    return dash.null_map(t.sql(GAPS), "o_orderkey")


@query("p28_duplicate_rows", "SELECT count(*)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem))::BIGINT AS unique_rows, count(*)::BIGINT - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem))::BIGINT AS duplicate_rows FROM lineitem")
def p28(t):
    return eda.duplicate_counts(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"))


@query("p29_skew_and_kurtosis", _union(
    f"""SELECT '{c}' AS "column", round(s, 4) AS skewness, round(k, 4) AS kurtosis, CASE WHEN abs(s) > 1 THEN 'high' WHEN abs(s) > 0.5 THEN 'moderate' ELSE 'low' END AS skew_band,
    CASE WHEN abs(k) > 3 THEN 'high' WHEN abs(k) > 1 THEN 'moderate' ELSE 'low' END AS kurtosis_band FROM (SELECT skewness({c}) AS s, kurtosis({c}) AS k FROM lineitem)""" for c in LINE_NUMBERS))
def p29(t):
    return rounded(eda.shape_statistics(_lines(t)))


@query("p30_key_figures", HEALTH_SQL + "SELECT n::BIGINT AS n_rows, 3::BIGINT AS n_columns, 1::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns, 0::BIGINT AS time_columns, mp AS missing_pct, dups::BIGINT AS duplicate_rows, greatest(0, round(100 - mp * 1.5 - least(dp, 20)))::BIGINT AS health FROM x")
def p30(t):
    d = t.sql("SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE round(o_totalprice / 20000) END AS price, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus AS status FROM {orders}")
    return dash.key_figures(d)


@query("p30_role_histogram", "SELECT 'numeric' AS role, 3::BIGINT AS n FROM orders HAVING count(*) > 0 UNION ALL SELECT 'categorical', 2 FROM orders HAVING count(*) > 0 UNION ALL SELECT 'datetime', 1 FROM orders HAVING count(*) > 0")
def p30_roles(t):
    return dash.role_histogram(t.orders)
