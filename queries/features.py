"""Catalog, source, target, feature and split queries."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queries.base import query, rounded
from tablelab.operators import experience, features, selection, splits, target
from tablelab.operators.moments import class_moments
from tablelab.operators.ranks import ordered_index
from tablelab.session import shared_folder
from tablelab.sources import catalog, readers, writers

@query("s4_read_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s4(t):
    return readers.read_table(t.spark, f"{t.folder}/nation.parquet")


@query("s1_s2_s7_delimited_round_trip", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders")
def s1(t):
    path = f"{shared_folder(t.spark)}/orders.csv"
    d = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    d.write.option("header", True).option("sep", ";").csv(path)
    return rounded(readers.read_table(t.spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint")))


@query("s3_s11_json_round_trip", "SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal FROM customer")
def s3(t):
    path = f"{shared_folder(t.spark)}/customer.json"
    writers.write_table(t.customer.select("c_custkey", "c_name", "c_acctbal"), path, "json")
    return rounded(readers.read_table(t.spark, path))


@query("s2_undecodable_bytes", "SELECT doc_id, lang, regexp_replace(regexp_replace(text, '[\\r\\n\\t;\"\\\\]', ' ', 'g'), '[^\\x00-\\x7F]', chr(65533), 'g') AS text FROM documents")
def s2_bytes(t):
    """Texts written as Latin-1 and read as UTF-8: each byte that can't be decoded becomes a replacement character."""
    path = f"{shared_folder(t.spark)}/latin.csv"
    d = t.documents.select("doc_id", "lang", F.regexp_replace("text", '[\\r\\n\\t;"\\\\]', " ").alias("text"))
    d.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_delimited(t.spark, path, d.schema)


@query("s8_malformed_lines", "SELECT event_id::VARCHAR AS run_id, event_type AS agent FROM events WHERE event_id % 10 > 0")
def s8_malformed(t):
    """Every tenth line of the log breaks off; such lines are skipped."""
    path = f"{shared_folder(t.spark)}/broken"
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("agent")))
    broken = F.when(F.col("event_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    t.events.select(broken.alias("value")).write.text(path)
    return readers.read_log(t.spark, path, T.StructType([T.StructField("run_id", T.StringType()), T.StructField("agent", T.StringType())]), keep=None)


@query("s6_count_rows", "SELECT count(*)::BIGINT AS n FROM lineitem")
def s6(t):
    path = f"{shared_folder(t.spark)}/lineitem"
    t.lineitem.select("l_orderkey").repartition(4).write.option("header", True).csv(path)
    return t.spark.createDataFrame([(readers.count_rows(t.spark, path),)], "n bigint")


@query("s9_append_log", "SELECT event_type AS agent, count(*)::BIGINT AS n FROM events GROUP BY 1")
def s9(t):
    path = f"{shared_folder(t.spark)}/log"
    log = experience.make_experiences(t.events.select(F.col("event_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("agent")))
    writers.append_log(log.filter("agent = 'click'"), path)
    writers.append_log(log.filter("agent <> 'click'"), path)
    return readers.read_log(t.spark, path, experience.EXPERIENCES, keep=None).groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


@query("s12_saved_model", "SELECT p_partkey, round(a + b * p_size, 2) AS prediction FROM part, (SELECT regr_intercept(p_retailprice, p_size) AS a, regr_slope(p_retailprice, p_size) AS b FROM part)")
def s12(t):
    path = f"{shared_folder(t.spark)}/model"
    model = features.pipeline(["p_size"], None, LinearRegression(labelCol="p_retailprice", solver="normal")).fit(t.part)
    writers.save_model(model, path)
    return rounded(writers.load_model(path).transform(t.part).select("p_partkey", "prediction"), 2)


@query("s13_catalog_insert", "SELECT c_mktsegment, 2 * count(*)::BIGINT AS n FROM customer GROUP BY 1")
def s13(t):
    path = f"{shared_folder(t.spark)}/rows"
    for _ in range(2):
        writers.append_rows(t.customer.select("c_custkey", "c_mktsegment"), path)
    return writers.read_rows(t.spark, path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("s8_s10_newest_records", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def s10(t):
    return readers.newest(t.events, 2000, "ts", "event_id").select("event_id", "event_type")


@query("s2_without_nul", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def s2(t):
    d = t.documents.select("doc_id", F.concat(F.col("text"), F.lit("\0")).alias("text"))
    return readers.without_nul(d).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("s14_size_text", """SELECT doc_id, CASE WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024) ELSE concat(b::BIGINT, ' B') END AS size
  FROM (SELECT doc_id, (strlen(text) * 64)::DOUBLE AS b FROM documents)""")
def s14(t):
    return t.documents.select("doc_id", readers.size_text((F.octet_length("text") * 64).cast("double")).alias("size"))


@query("q1_newest_first", "SELECT o_orderkey, o_orderstatus FROM orders")
def q1(t):
    return catalog.list_newest_first(t.orders, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("q2_point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def q2(t):
    return catalog.find(t.customer, "c_custkey", 42).select("c_custkey", "c_name")


@query("q3_link_dataset", "SELECT page_id, coalesce(s_suppkey::VARCHAR, '') AS dataset_id FROM pages LEFT JOIN supplier ON concat('Supplier#', page_id) = concat('Supplier#', s_suppkey)")
def q3(t):
    records = t.pages.select("page_id", F.concat(F.lit("Supplier#"), F.col("page_id")).alias("dataset_filename"))
    names = t.supplier.select(F.concat(F.lit("Supplier#"), F.col("s_suppkey")).alias("filename"), F.col("s_suppkey").cast("string").alias("id"))
    return catalog.link_dataset(records, names).select("page_id", "dataset_id")


@query("q4_delete", "SELECT c_custkey, true AS existed FROM customer WHERE c_custkey <> 42")
def q4(t):
    rest, existed = catalog.delete(t.customer, "c_custkey", 42)
    return rest.select("c_custkey", F.lit(existed).alias("existed"))


@query("q5_counts", "SELECT 'datasets' AS collection, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'models', count(*) FROM part UNION ALL SELECT 'reports', count(*) FROM pages")
def q5(t):
    return catalog.counts(datasets=t.documents, models=t.part, reports=t.pages)


@query("q6_best_accuracy", "SELECT round(max(l_discount) * 100, 2) AS best_accuracy FROM lineitem")
def q6(t):
    return catalog.best_accuracy(t.lineitem, "l_discount")


@query("q6_best_accuracy_empty", "SELECT 0.0::DOUBLE AS best_accuracy FROM lineitem HAVING count(*) > 0")
def q6_empty(t):
    return catalog.best_accuracy(t.lineitem.select(F.lit(None).cast("double").alias("accuracy")))


@query("q7_recent", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def q7(t):
    return catalog.recent(t.orders, "o_orderdate", "o_orderkey", 5, ["o_orderkey", "o_orderstatus"])


@query("f1_problem_types", """SELECT * FROM (VALUES ('toxic', 'classification'), ('o_totalprice', 'regression'), ('o_orderpriority', 'classification'), ('p_size', 'regression'), ('l_linenumber', 'classification')) v(target, problem_type) WHERE (SELECT count(*) FROM orders) > 0""")
def f1(t):
    cases = [(t.labels, "toxic"), (t.orders, "o_totalprice"), (t.orders, "o_orderpriority"), (t.part, "p_size"), (t.lineitem, "l_linenumber")]
    rows = [(c, target.problem_type(d.select(c), c)["problem_type"]) for d, c in cases]
    return t.spark.createDataFrame(rows, "target string, problem_type string")


@query("f2_label_codes", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label FROM orders")
def f2(t):
    d = t.orders.select("o_orderkey", "o_orderpriority")
    return target.encode_labels(d, "o_orderpriority", target.label_codes(d, "o_orderpriority")).drop("o_orderpriority")


@query("f3_one_hot", "SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS o_orderstatus_O, (o_orderstatus = 'P')::INTEGER AS o_orderstatus_P FROM orders")
def f3(t):
    d = t.orders.select("o_orderkey", "o_orderstatus")
    return features.one_hot(d, features.one_hot_levels(d, ["o_orderstatus"]))


@query("f4_cap_levels", "WITH k AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 20) SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM k) THEN p_brand ELSE '__other__' END AS p_brand FROM part")
def f4(t):
    d = t.part.select("p_partkey", "p_brand")
    return features.cap_levels(d, features.top_levels(d, ["p_brand"], 20))


@query("f5_frequency_encode", "SELECT event_id, round(count(*) OVER (PARTITION BY event_type) / count(*) OVER (), 4) AS event_type FROM events")
def f5(t):
    return rounded(features.frequency_encode(t.events.select("event_id", "event_type"), ["event_type"]))


@query("f6_all_numeric", "SELECT p_partkey::DOUBLE AS p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size END::DOUBLE AS v FROM part")
def f6(t):
    d = t.part.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string")).alias("v"))
    return features.all_numeric(d)


@query("f7_f8_crossed_terms", """SELECT p_partkey, ln(1 + p_size)::DOUBLE * 0 + p_size::DOUBLE AS p_size, round(p_retailprice, 4) AS p_retailprice, (p_size * p_size)::DOUBLE AS "p_size^2",
  round(p_size * p_retailprice, 4) AS "p_size p_retailprice", round(p_retailprice * p_retailprice, 4) AS "p_retailprice^2", round(p_size / p_retailprice, 4) AS p_size_div_p_retailprice FROM part""")
def f7(t):
    plan = features.LowFeatureTerms.fit(t.part, ["p_size", "p_retailprice"])
    return rounded(plan.transform(t.part, keep=["p_partkey"]))


@query("f8_logged_terms", """SELECT event_id, round(CASE WHEN lo > 0 AND abs(s) > 1 THEN ln(1 + v) ELSE v END, 4) AS v, round(CASE WHEN lo > 0 AND abs(s2) > 1 THEN ln(1 + v * v) ELSE v * v END, 4) AS "v^2"
  FROM (SELECT event_id, value + 1 AS v FROM events), (SELECT min(value + 1) AS lo, skewness(value + 1) AS s, skewness((value + 1) * (value + 1)) AS s2 FROM events)""")
def f8(t):
    d = t.events.select("event_id", (F.col("value") + 1).alias("v"))
    return rounded(features.LowFeatureTerms.fit(d, ["v"]).transform(d, keep=["event_id"]))


@query("f9_standard_scaling", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 4) AS p_size FROM part")
def f9(t):
    return rounded(features.standardise(t.part.select("p_partkey", "p_size"), ["p_size"]))


@query("f9_min_max_scaling", "SELECT p_partkey, round((p_size - min(p_size) OVER ())::DOUBLE / (max(p_size) OVER () - min(p_size) OVER ()), 4) AS p_size FROM part")
def f9_range(t):
    return rounded(features.min_max(t.part.select("p_partkey", "p_size"), ["p_size"]))


@query("f10_align_columns", "SELECT p_size::DOUBLE AS p_size, 0.0::DOUBLE AS unseen, p_partkey::DOUBLE AS p_partkey FROM part")
def f10(t):
    return features.align(t.part.select("p_partkey", "p_size", "p_brand"), ["p_size", "unseen", "p_partkey"])


@query("f11_leakage_guard", """WITH d AS (SELECT o_totalprice AS y, o_totalprice * 2 + (o_orderkey % 10) AS leak, o_custkey AS ok FROM orders)
  SELECT feature FROM (SELECT 'leak' AS feature, corr(leak, y) AS r FROM d UNION ALL SELECT 'ok', corr(ok, y) FROM d) WHERE abs(r) > 0.9""")
def f11(t):
    d = t.orders.select(F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 2 + F.col("o_orderkey") % 10).alias("leak"), F.col("o_custkey").alias("ok"))
    return t.spark.createDataFrame([(c,) for c in target.leaking_features(d, "y")], "feature string")


@query("v9_target_correlations", "SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 4) AS correlation FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 4) FROM lineitem")
def v9(t):
    return rounded(target.target_correlations(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query("f12_zero_variance", "SELECT 'flat' AS feature FROM lineitem HAVING count(*) > 0")
def f12(t):
    d = t.lineitem.select("l_quantity", F.lit(3).alias("flat"))
    return t.spark.createDataFrame([(c,) for c in selection.zero_variance(d, d.columns)], "feature string")


@query("f13_correlated_features", "SELECT 'twice' AS feature FROM lineitem HAVING count(*) > 0")
def f13(t):
    d = t.lineitem.select("l_quantity", "l_tax", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("twice"), "l_extendedprice")
    out = selection.correlated(d, ["l_quantity", "l_tax", "twice"], "l_extendedprice")
    return t.spark.createDataFrame([(c,) for c in out], "feature string")


@query("f14_f_scores", """WITH g AS (SELECT o_orderstatus AS c, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), w AS (SELECT sum(n * m) / sum(n) AS m, sum(n) AS n, count(*) AS k FROM g)
  SELECT 'o_totalprice' AS feature, round((sum(g.n * (g.m - w.m) * (g.m - w.m)) / (any_value(w.k) - 1)) / (sum(g.n * g.v) / (any_value(w.n) - any_value(w.k))), 4) AS score FROM g, w""")
def f14(t):
    scores = selection.f_scores(t.orders, ["o_totalprice"], "o_orderstatus")
    return rounded(t.spark.createDataFrame(list(scores.items()), "feature string, score double"))


def _information_sql(features, target):
    place = lambda c: f"coalesce(least(floor(({c}::DOUBLE - (SELECT min({c}) FROM lineitem)) / (SELECT max({c})::DOUBLE - min({c}) FROM lineitem) * 32.0), 31), -1)"
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {place(c)} AS x, {target if target == 'l_returnflag' else place(target)} AS y FROM lineitem" for c in features)
    return f"""WITH c AS ({cells}), j AS (SELECT feature, x, y, count(*)::DOUBLE AS n FROM c GROUP BY ALL),
      w AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny, sum(n) OVER (PARTITION BY feature) AS total FROM j)
      SELECT feature, round(sum(n / total * ln(n * total / (nx * ny))), 6) AS score FROM w GROUP BY feature"""


def _information(t, features, target, problem):
    found = selection.mutual_information(t.lineitem, features, target, problem)
    return rounded(t.spark.createDataFrame(list(found.items()), "feature string, score double"), 6)


@query("f14_mutual_information", _information_sql(["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "l_returnflag"))
def f14_information(t):
    return _information(t, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "l_returnflag", "classification")


@query("f14_mutual_information_numbers", _information_sql(["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))
def f14_information_numbers(t):
    return _information(t, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "regression")


def _vectors(t):
    d = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return d, [f"e{i}" for i in range(64)]


@query("f15_lda_projection")
def f15(t):
    d, names = _vectors(t)
    mean, axes = selection.lda_weights(class_moments(d, names, "label"), 9)
    return selection.project(d, names, mean, axes, "lda", ["vec_id", "label"])


@query("f16_pca_projection")
def f16(t):
    d, names = _vectors(t)
    mean, axes, _ = selection.pca_weights(class_moments(d, names), 10**6)
    return selection.project(d, names, mean, axes, "pca", ["vec_id"])


@query("f17_feature_selection")
def f17(t):
    d, names = _vectors(t)
    plan = selection.FeatureSelection.fit(d, names, "label", "classification")
    return plan.transform(d, keep=["vec_id", "label"])


@query("f18_class_weights", "SELECT doc_id, round(count(*) OVER ()::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) * count(*) OVER (PARTITION BY toxic)), 4) AS class_weight FROM labels")
def f18(t):
    return rounded(target.class_weights(t.labels.select("doc_id", "toxic"), "toxic")).drop("toxic")


RANK = "row_number() OVER (PARTITION BY {by} ORDER BY md5(concat(o_orderkey::VARCHAR, '|', '42')), o_orderkey)"


@query("k1_stratified_split", f"SELECT o_orderkey, CASE WHEN {RANK.format(by='o_orderpriority')} <= round(count(*) OVER (PARTITION BY o_orderpriority) * 0.8) THEN 'train' ELSE 'test' END AS part FROM orders")
def k1(t):
    d = t.orders.select("o_orderkey", "o_orderpriority")
    return splits.split(d, ["o_orderkey"], by=["o_orderpriority"]).select("o_orderkey", "part")


@query("k2_three_way_report", """WITH s AS (SELECT o_orderpriority, r, n FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat(o_orderkey::VARCHAR, '|', '42')), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders))
  SELECT CASE WHEN r <= round(n * 0.7) THEN 'train' WHEN r <= round(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'validation' ELSE 'test' END AS part, o_orderpriority, count(*)::BIGINT AS n FROM s GROUP BY 1, 2""")
def k2(t):
    return splits.three_way(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], ["o_orderpriority"])[1]


@query("k3_folds", f"SELECT o_orderkey, (({RANK.format(by='o_orderpriority')} - 1) % 3)::INTEGER AS fold FROM orders")
def k3(t):
    return splits.folds(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 3, ["o_orderpriority"]).select("o_orderkey", "fold")


@query("k3_folds_sliced", f"SELECT o_orderkey, (({RANK.format(by='o_orderpriority')} - 1) % 3)::INTEGER AS fold FROM orders")
def k3_sliced(t):
    d = t.orders.select("o_orderkey", "o_orderpriority")
    return splits.folds(d, ["o_orderkey"], 3, ["o_orderpriority"], rows_per_slice=1000).select("o_orderkey", "fold")


GAPPED = "(SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS p FROM orders)"


@query("k3_folds_null_sliced", f"SELECT o_orderkey, (({RANK.format(by='p')} - 1) % 3)::INTEGER AS fold FROM {GAPPED}")
def k3_null_sliced(t):
    d = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("p"))
    return splits.folds(d, ["o_orderkey"], 3, ["p"], rows_per_slice=1000).select("o_orderkey", "fold")


@query("k1_split_null_sliced", f"SELECT o_orderkey, CASE WHEN {RANK.format(by='p')} <= round(count(*) OVER (PARTITION BY p) * 0.8) THEN 'train' ELSE 'test' END AS part FROM {GAPPED}")
def k1_null_sliced(t):
    d = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("p"))
    return splits.split(d, ["o_orderkey"], by=["p"], rows_per_slice=1000).select("o_orderkey", "part")


@query("x15_index_null_sliced", "SELECT event_id, row_number() OVER (PARTITION BY nullif(event_type, 'view') ORDER BY d NULLS FIRST, event_id)::BIGINT AS row_index FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN ts::DATE END AS d FROM events)")
def index_null_sliced(t):
    d = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"), F.when(F.col("event_id") % 3 > 0, F.to_date("ts")).alias("d"))
    return ordered_index(d, "d", ["event_id"], ["kind"], rows_per_slice=700).select("event_id", "row_index")


@query("k4_downsample", """WITH s AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat(o_orderkey::VARCHAR, '|', '42')), o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS a FROM orders)
  SELECT o_orderkey FROM s WHERE r <= round(n * (5000::DOUBLE / a))""")
def k4(t):
    return splits.downsample(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 5000, ["o_orderpriority"]).select("o_orderkey")


@query("k5_sample", "SELECT o_orderkey FROM orders ORDER BY md5(concat(o_orderkey::VARCHAR, '|', '42')), o_orderkey LIMIT 500")
def k5(t):
    return splits.sample(t.orders.select("o_orderkey"), ["o_orderkey"], 500)


@query("v4_majority_baseline", "SELECT round(max(n) / sum(n), 4) AS baseline_accuracy FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)")
def v4(t):
    return rounded(target.majority_share(t.labels, "toxic"))
