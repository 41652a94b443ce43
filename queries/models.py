"""Model, evaluation and explanation queries."""

from __future__ import annotations

import string

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from queries.base import query, rounded
from tablelab.functions import texts
from tablelab.models import automl, boosting, custom, ensemble, evaluate, explain, penalty_paths, pruning, registry, search
from tablelab.operators.splits import folds, split
from tablelab.session import checkpointed, dealt

TEXT_FEATURES = ["n_chars", "words", "sentiment", "lines", "digits", "upper"]


def documents(t, label="toxic"):
    """Labelled documents with numeric text features over the whole text."""
    d = t.documents.join(t.labels, "doc_id")
    c = F.col("text")
    without = lambda letters: F.length(c) - F.length(F.translate(c, letters, ""))
    wide = d.select(
        "doc_id", F.col(label).cast("double").alias("label"), F.col("n_chars").cast("double").alias("n_chars"),
        texts.word_count(c).cast("double").alias("words"), texts.sentiment(c).alias("sentiment"),
        without("\n").cast("double").alias("lines"), without("0123456789").cast("double").alias("digits"),
        without(string.ascii_uppercase).cast("double").alias("upper"),
    )
    # Training reads the features many times; the texts are scanned once.
    return checkpointed(VectorAssembler(inputCols=TEXT_FEATURES, outputCol="features").transform(wide))


def vectors(t):
    from pyspark.ml.functions import array_to_vector

    return t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


PART_FEATURES = ["p_size", "p_partkey"]


def parts(t):
    d = t.part.select("p_partkey", "p_size", F.col("p_retailprice").alias("label"))
    return VectorAssembler(inputCols=PART_FEATURES, outputCol="features").transform(d)


LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber"]
#: A label by a rule on two features: linear models can learn it exactly, trees nearly, and a constant not at all.
RULE = "l_quantity + 200 * l_discount > 35.5"
#: A number that follows the quantity and has nothing to do with the discount.
AMOUNT = "CAST(l_extendedprice AS DOUBLE) * l_quantity"


def lines(t):
    """Lines of orders, labelled 1 where ``RULE`` holds."""
    d = t.lineitem.select(*LINE_KEY, *[F.col(c).cast("double").alias(c) for c in LINE_FEATURES], F.expr(RULE).cast("double").alias("label"))
    return checkpointed(VectorAssembler(inputCols=LINE_FEATURES, outputCol="features").transform(d).select(*LINE_KEY, "label", "features"))


def _fit_and_score(df, key, name, params, problem="classification", classes=2, by=("label",)):
    rows = df.count()
    c = registry.candidates(problem, 1, rows, classes, key, names=[name])[0]
    # Fitting reads the halves many times; they are cut once.
    halves = checkpointed(split(df, key, by=list(by), name="part"))
    train = halves.filter("part = 'train'").drop("part")
    if name == "RandomForest":  # keeps each row with its draws for all trees
        train = dealt(train, rows, key)
    model = c.pipeline(params).fit(train)
    out = model.transform(halves.filter("part = 'test'").drop("part"))
    return out.select(*key, "label", "prediction")


# The held-out fifth in SQL: rows are ranked by a hash of their key within each label.
_SOURCES = {
    "documents": ("doc_id", "SELECT doc_id, toxic::DOUBLE AS label FROM documents JOIN labels USING (doc_id)", "PARTITION BY label"),
    "vectors": ("vec_id", "SELECT vec_id, label::DOUBLE AS label, embedding FROM embeddings", "PARTITION BY label"),
    "parts": ("p_partkey", "SELECT p_partkey, p_retailprice AS label, p_size FROM part", ""),
}


def _halves_sql(source):
    key, rows, by = _SOURCES[source]
    return f"""s AS (SELECT *, row_number() OVER ({by} ORDER BY md5(concat({key}::VARCHAR, '|', '42')), {key}) > round(count(*) OVER ({by}) * 0.8) AS held FROM ({rows}))"""


def _register(name, family, params, source, key, problem="classification", classes=2, by=("label",), sql=None, floor=None):
    """The query itself, and with ``floor`` a second one for regressions: the held-out rows (in SQL too) and whether R squared on them reaches the floor."""
    @query(name, sql)
    def run(t):
        return _fit_and_score(source(t), [key], family, params, problem, classes, by)

    if floor is None:
        return

    @query(f"{name}_held_out", f"WITH {_halves_sql(source.__name__)} SELECT 0.0::DOUBLE AS label, count(*)::BIGINT AS n, true AS reached FROM s WHERE held GROUP BY 1")
    def checked(t):
        out = _fit_and_score(source(t), [key], family, params, problem, classes, by)
        r2 = 1 - F.sum(F.pow(F.col("label") - F.col("prediction"), 2)) / (F.var_pop("label") * F.count(F.lit(1)))
        return out.agg(F.lit(0.0).alias("label"), F.count(F.lit(1)).alias("n"), (r2 >= floor).alias("reached"))


# The best single threshold on the quantity, by the mean share of hits of both classes, over all lines.
STUMP_SQL = f"""WITH d AS (SELECT l_quantity AS x, ({RULE})::INT AS y FROM lineitem), c AS (SELECT x, sum(y) AS a, count(*) - sum(y) AS b FROM d GROUP BY x),
  r AS (SELECT x, sum(a) OVER (ORDER BY x) AS a, sum(b) OVER (ORDER BY x) AS b, sum(a) OVER () AS aa, sum(b) OVER () AS bb FROM c), best AS (SELECT max(((aa - a) / aa + b / bb) / 2) AS hit FROM r)
  SELECT y::DOUBLE AS label, (count(*) - round(count(*) * 0.8))::BIGINT AS n, round(any_value(hit), 6) AS threshold_hits, 0.5::DOUBLE AS constant_hits, true AS reached FROM d, best GROUP BY y"""
#: How far below the best threshold a model may stay; it must be twice as far above a constant, whose mean share is a half.
MARGIN = 0.05


def _register_lines(name, family, params):
    """Held-out lines per label, and whether the mean share of hits of both classes comes up to the best threshold's, less ``MARGIN``."""
    @query(f"{name}_held_out", STUMP_SQL)
    def checked(t):
        d = lines(t)
        out = checkpointed(_fit_and_score(d, LINE_KEY, family, params))
        counts = t.lineitem.groupBy(F.col("l_quantity").alias("x")).agg(F.sum(F.expr(RULE).cast("long")).alias("a"), F.count(F.lit(1)).alias("n"))
        found = sorted((float(r["x"]), r["a"], r["n"] - r["a"]) for r in counts.collect())  # one row per quantity
        dear, cheap = sum(r[1] for r in found), sum(r[2] for r in found)
        hits, a, b = [], 0, 0
        for _, more, less in found:
            a, b = a + more, b + less
            hits.append(((dear - a) / dear + b / cheap) / 2)
        share = out.groupBy("label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("hit"), F.count(F.lit(1)).alias("n"))
        mean = share.agg(F.avg("hit")).first()[0]
        return share.select("label", "n", F.lit(round(max(hits), 6)).alias("threshold_hits"), F.lit(0.5).alias("constant_hits"), F.lit(mean >= max(hits) - MARGIN and mean >= 0.5 + 2 * MARGIN).alias("reached"))


_DIMENSIONS = f"""WITH {_halves_sql('vectors')}, v AS (SELECT vec_id, label, held, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM s),
  a AS (SELECT count(*)::DOUBLE AS rows, (SELECT count(DISTINCT label) FROM s) AS classes FROM s WHERE NOT held), p AS (SELECT label AS c, count(*)::DOUBLE AS n FROM s WHERE NOT held GROUP BY 1)"""
_BEST = " SELECT vec_id, label, arg_max(c, score) AS prediction FROM {scores} GROUP BY 1, 2"
GAUSSIAN_SQL = _DIMENSIONS + """, e AS (SELECT 1e-9 * max(w) AS e FROM (SELECT var_pop(x) AS w FROM v WHERE NOT held GROUP BY i)),
  g AS (SELECT label AS c, i, avg(x) AS mu, var_pop(x) + any_value(e) AS s2 FROM v, e WHERE NOT held GROUP BY 1, 2),
  z AS (SELECT vec_id, label, g.c, ln(any_value(p.n) / any_value(a.rows)) - 0.5 * sum(ln(2 * pi() * s2) + (x - mu) * (x - mu) / s2) AS score FROM v JOIN g USING (i) JOIN p ON p.c = g.c, a WHERE held GROUP BY 1, 2, 3)""" + _BEST.format(scores="z")
BERNOULLI_SQL = _DIMENSIONS + """, m AS (SELECT i, avg(x) AS mu FROM v WHERE NOT held GROUP BY 1), b AS (SELECT vec_id, label, held, i, (x > mu)::DOUBLE AS x FROM v JOIN m USING (i)),
  g AS (SELECT label AS c, i, (sum(x) + 1) / (count(*) + 2) AS t FROM b WHERE NOT held GROUP BY 1, 2),
  z AS (SELECT vec_id, label, g.c, ln((any_value(p.n) + 1) / (any_value(a.rows) + any_value(a.classes))) + sum(x * ln(t) + (1 - x) * ln(1 - t)) AS score FROM b JOIN g USING (i) JOIN p ON p.c = g.c, a WHERE held GROUP BY 1, 2, 3)""" + _BEST.format(scores="z")
MULTINOMIAL_SQL = _DIMENSIONS + """, m AS (SELECT i, min(x) AS lo, max(x) AS hi FROM v WHERE NOT held GROUP BY 1), b AS (SELECT vec_id, label, held, i, greatest((x - lo) / (hi - lo), 0) AS x FROM v JOIN m USING (i)),
  g AS (SELECT label AS c, i, ln(sum(x) + 1) - ln(sum(sum(x)) OVER (PARTITION BY label) + count(*) OVER (PARTITION BY label)) AS t FROM b WHERE NOT held GROUP BY 1, 2),
  z AS (SELECT vec_id, label, g.c, ln((any_value(p.n) + 1) / (any_value(a.rows) + any_value(a.classes))) + sum(x * t) AS score FROM b JOIN g USING (i) JOIN p ON p.c = g.c, a WHERE held GROUP BY 1, 2, 3)""" + _BEST.format(scores="z")
NEIGHBOURS_SQL = _DIMENSIONS + """, m AS (SELECT i, avg(x) AS mu, stddev_samp(x) AS sd FROM v WHERE NOT held GROUP BY 1), b AS (SELECT vec_id, label, held, i, (x - mu) / sd AS x FROM v JOIN m USING (i)),
  d AS (SELECT q.vec_id, q.label, t.vec_id AS other, t.label AS c, sqrt(round(sum((q.x - t.x) * (q.x - t.x)), 9)) AS d FROM b q JOIN b t ON q.i = t.i AND q.held AND NOT t.held GROUP BY 1, 2, 3, 4),
  k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other::VARCHAR) AS r FROM d),
  z AS (SELECT vec_id, label, c, round(sum(1 / greatest(d, 1e-12)), 9) AS w FROM k WHERE r <= 5 GROUP BY 1, 2, 3)
  SELECT vec_id, label, first(c ORDER BY w DESC, c) AS prediction FROM z GROUP BY 1, 2"""
PART_NEIGHBOURS_SQL = f"""WITH {_halves_sql('parts')}, v AS (SELECT p_partkey, label, held, unnest([0, 1]) AS i, unnest([p_size::DOUBLE, p_partkey::DOUBLE]) AS x FROM s),
  m AS (SELECT i, avg(x) AS mu, stddev_samp(x) AS sd FROM v WHERE NOT held GROUP BY 1), b AS (SELECT p_partkey, label, held, i, (x - mu) / sd AS x FROM v JOIN m USING (i)),
  d AS (SELECT q.p_partkey, q.label, t.p_partkey AS other, t.label AS y, round(sum((q.x - t.x) * (q.x - t.x)), 9) AS d FROM b q JOIN b t ON q.i = t.i AND q.held AND NOT t.held GROUP BY 1, 2, 3, 4),
  k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, other::VARCHAR) AS r FROM d)
  SELECT p_partkey, round(avg(y), 4) AS prediction FROM k WHERE r <= 5 GROUP BY 1"""


_register("m1_logistic_regression", "LogisticRegression", {"C": 1.0}, documents, "doc_id")
_register_lines("m1_logistic_regression", "LogisticRegression", {"C": 1.0})
_register("m2_linear_svc", "LinearSVC", {"C": 1.0}, documents, "doc_id")
_register_lines("m2_linear_svc", "LinearSVC", {"C": 1.0})
_register("m3_sgd_classifier", "SGDClassifier", {"regParam": 0.001, "elasticNetParam": 1.0}, documents, "doc_id")
_register_lines("m3_sgd_classifier", "SGDClassifier", {"regParam": 0.001, "elasticNetParam": 1.0})
_register("m4_ridge_classifier", "RidgeClassifier", {"alpha": 1.0}, vectors, "vec_id", classes=10)
_register("m5_decision_tree", "DecisionTree", {"maxDepth": 5}, documents, "doc_id")
_register_lines("m5_decision_tree", "DecisionTree", {"maxDepth": 5})
_register("m5_decision_tree_regression", "DecisionTree", {"maxDepth": 5}, parts, "p_partkey", "regression", by=(), floor=0.85)
_register("m6_random_forest", "RandomForest", {"numTrees": 20, "maxDepth": 5}, documents, "doc_id")
_register_lines("m6_random_forest", "RandomForest", {"numTrees": 20, "maxDepth": 5})
_register("m6_random_forest_regression", "RandomForest", {"numTrees": 20, "maxDepth": 5}, parts, "p_partkey", "regression", by=(), floor=0.4)
_register("m7_boosted_trees", "XGBoost", {"maxIter": 10, "maxDepth": 3}, documents, "doc_id")
_register_lines("m7_boosted_trees", "XGBoost", {"maxIter": 10, "maxDepth": 3})
_register("m7_boosted_trees_regression", "LightGBM", {"maxIter": 10, "maxDepth": 4}, parts, "p_partkey", "regression", by=(), floor=0.85)
_register("m8_ada_boost", "AdaBoost", {"rounds": 6}, documents, "doc_id")
_register_lines("m8_ada_boost", "AdaBoost", {"rounds": 6})
_register("m9_bagging", "Bagging", {"rounds": 5}, documents, "doc_id")
_register_lines("m9_bagging", "Bagging", {"rounds": 5})
_register("m10_nearest_neighbours", "KNN", {"k": 5, "weights": "distance"}, vectors, "vec_id", classes=10, sql=NEIGHBOURS_SQL)
_register("m10_nearest_neighbours_regression", "KNN", {"k": 5}, parts, "p_partkey", "regression", by=(), floor=0.85)
_register("m11_gaussian_nb", "GaussianNB", {}, vectors, "vec_id", classes=10, sql=GAUSSIAN_SQL)
_register("m11_bernoulli_nb", "BernoulliNB", {"smoothing": 1.0}, vectors, "vec_id", classes=10, sql=BERNOULLI_SQL)
_register("m11_multinomial_nb", "MultinomialNB", {"smoothing": 1.0}, vectors, "vec_id", classes=10, sql=MULTINOMIAL_SQL)
_register("m12_qda", "QDA", {"regParam": 0.1}, vectors, "vec_id", classes=10)
_register("m13_linear_regression", "LinearRegression", {}, parts, "p_partkey", "regression", by=(), floor=0.2)
_register("m13_ridge", "Ridge", {"alpha": 1.0}, parts, "p_partkey", "regression", by=(), floor=0.2)
_register("m13_lasso", "Lasso", {"regParam": 0.1}, parts, "p_partkey", "regression", by=(), floor=0.2)
_register("m13_elastic_net", "ElasticNet", {"regParam": 0.1, "elasticNetParam": 0.5}, parts, "p_partkey", "regression", by=(), floor=0.2)
_register("m14_bayesian_ridge", "BayesianRidge", {}, parts, "p_partkey", "regression", by=(), floor=0.2)
_register("m15_sgd_regressor", "SGDRegressor", {"loss": "huber", "regParam": 0.001}, parts, "p_partkey", "regression", by=(), floor=0.2)


@query("m10_nearest_neighbours_pivots", NEIGHBOURS_SQL)
def m10_pivots(t):
    """The same rows by way of pivots, in small blocks."""
    return _fit_and_score(vectors(t), ["vec_id"], "KNN", {"k": 5, "weights": "distance", "blockRows": 100}, classes=10)


@query("m10_nearest_neighbours_regression_rounded", PART_NEIGHBOURS_SQL)
def m10_parts(t):
    return rounded(_fit_and_score(parts(t), ["p_partkey"], "KNN", {"k": 5}, "regression", by=()).select("p_partkey", "prediction"))


# --- histogram boosting: the first tree of two levels, derived again from sums over the values of each feature

TREE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _tree_sql(table, features, y, binary, l2=1.0, key="1 AS one"):
    """Nodes of a depth-two tree (l: path, feature, threshold) over the rows r of a table with gradients g and h."""
    sums = " UNION ALL ".join(f"SELECT path, {i} AS f, {c} AS x, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {{rows}} GROUP BY path, {c}" for i, c in enumerate(features))
    score = lambda g, h: f"({g}) * ({g}) / (({h}) + {l2})"
    split = f"""SELECT path, f, x FROM (SELECT *, sum(g) OVER s AS gl, sum(h) OVER s AS hl, sum(g) OVER a AS ga, sum(h) OVER a AS ha, row_number() OVER (PARTITION BY path, f ORDER BY x DESC) AS last FROM ({sums})
      WINDOW s AS (PARTITION BY path, f ORDER BY x), a AS (PARTITION BY path, f)) WHERE last > 1
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY {score('gl', 'hl')} + {score('ga - gl', 'ha - hl')} DESC, f, x) = 1"""
    side = "path || CASE WHEN CASE f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(features)) + " END <= x THEN 'L' ELSE 'R' END"
    label = f"({y})::DOUBLE"
    h = "p * (1 - p)" if binary else "1.0"
    names = key.split(" AS ")[-1]
    return f"""WITH m AS (SELECT avg({label}) AS p FROM {table}),
  r0 AS MATERIALIZED (SELECT '' AS path, {key}, {', '.join(features)}, p - {label} AS g, {h} AS h FROM {table}, m), s0 AS MATERIALIZED ({split.format(rows='r0')}),
  r1 AS MATERIALIZED (SELECT {side} AS path, {names}, {', '.join(features)}, g, h FROM r0 JOIN s0 USING (path)), s1 AS MATERIALIZED ({split.format(rows='r1')}),
  r2 AS MATERIALIZED (SELECT {side} AS path, {names}, g, h FROM r1 JOIN s1 USING (path)),
  nodes AS (SELECT path, count(*)::BIGINT AS rows, -sum(g) / (sum(h) + {l2}) AS score FROM (SELECT path, g, h FROM r0 UNION ALL SELECT path, g, h FROM r1 UNION ALL SELECT path, g, h FROM r2) GROUP BY path),
  splits AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)"""


NODES_SQL = " SELECT path, ['" + "', '".join(TREE_FEATURES) + "'][f + 1] AS feature, x AS threshold, rows, round(score, 3) + 0.0 AS score FROM nodes LEFT JOIN splits USING (path)"


def _first_tree(t, label, problem):
    d = VectorAssembler(inputCols=TREE_FEATURES, outputCol="features").transform(t.lineitem.select(*TREE_FEATURES, label.cast("double").alias("label")))
    return boosting.HistBoost(problem=problem, maxIter=1, stepSize=1.0, maxDepth=2, l2=1.0).fit(d), d


def _nodes(t, label, problem):
    model, d = _first_tree(t, label, problem)
    return rounded(boosting.tree_table(d, model, TREE_FEATURES).select("path", "feature", "threshold", "rows", "score"), 3)


@query("m7_first_tree_numbers", _tree_sql("lineitem", TREE_FEATURES, "l_extendedprice", False) + NODES_SQL)
def m7_numbers(t):
    return _nodes(t, F.col("l_extendedprice"), "regression")


@query("m7_first_tree_classes", _tree_sql("lineitem", TREE_FEATURES, "l_extendedprice > 30000", True) + NODES_SQL)
def m7_classes(t):
    return _nodes(t, F.col("l_extendedprice") > 30000, "classification")


@query("m7_first_tree_predictions", _tree_sql("lineitem", TREE_FEATURES, "l_extendedprice", False) + """ SELECT round(any_value(score) + any_value(p), 2) AS prediction, count(*)::BIGINT AS n
  FROM r2 JOIN nodes USING (path), m GROUP BY path""")
def m7_predictions(t):
    model, d = _first_tree(t, F.col("l_extendedprice"), "regression")
    return model.transform(d).groupBy(F.round("prediction", 2).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query("v10_tree_shapley_sums", _tree_sql("lineitem", TREE_FEATURES, "l_extendedprice", False, key="l_orderkey, l_linenumber") + """ SELECT l_orderkey, l_linenumber, round(sum(score) - count(*) * (SELECT sum(score * rows) / sum(rows) FROM nodes WHERE len(path) = 2), 2) + 0.0 AS total FROM r2 JOIN nodes USING (path) GROUP BY ALL""")
def v10_tree(t):
    """Values of all features summed by key, which some rows share: the score of each row less the mean score."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", *TREE_FEATURES, F.col("l_extendedprice").cast("double").alias("label"))
    d = VectorAssembler(inputCols=TREE_FEATURES, outputCol="features").transform(d)
    model = boosting.HistBoost(problem="regression", maxIter=1, stepSize=1.0, maxDepth=2, l2=1.0).fit(d)
    values = explain.tree_shapley(model, d, TREE_FEATURES, ["l_orderkey", "l_linenumber"])
    return rounded(values.groupBy("l_orderkey", "l_linenumber").agg(F.sum("shapley").alias("total")), 2)


# Two groups of lines and no penalty: at the minimum of either loss the probability of a group is the share of its labelled lines.
SHARES_SQL = f"""SELECT l_orderkey, l_linenumber, round(avg(({RULE})::INT) OVER (PARTITION BY l_quantity > 25), 3) AS probability FROM lineitem"""


def _shares(t, loss):
    d = t.lineitem.select(*LINE_KEY, (F.col("l_quantity") > 25).cast("double").alias("large"), F.expr(RULE).cast("double").alias("label"))
    d = VectorAssembler(inputCols=["large"], outputCol="features").transform(d)
    c = registry.candidates("classification", 1, 0, 2, LINE_KEY, names=["SGDClassifier"])[0]
    out = c.pipeline({"loss": loss, "regParam": 0.0, "tol": 1e-7}).fit(d).transform(d)
    return rounded(out.select(*LINE_KEY, F.col("probability_array")[1].alias("probability")), 3)


@query("m3_sgd_log_loss_shares", SHARES_SQL)
def m3_log_loss(t):
    return _shares(t, "log_loss")


@query("m3_sgd_modified_huber_shares", SHARES_SQL)
def m3_modified_huber(t):
    return _shares(t, "modified_huber")


@query("m15_sgd_absolute_penalty_line", """WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, stddev_samp(l_quantity) AS sx, stddev_pop(l_extendedprice) AS sy, covar_pop(l_quantity, l_extendedprice) AS xy, var_pop(l_quantity) / var_samp(l_quantity) AS xx FROM lineitem),
  w AS (SELECT *, greatest(xy / (sx * sy) - 0.2, 0) / xx AS w FROM s) SELECT l_orderkey, l_linenumber, round(my + sy * w * (l_quantity - mx) / sx, 1) AS fitted FROM lineitem, w""")
def m15_line(t):
    """One feature and a penalty on its absolute weight: the weight is the covariance less the penalty."""
    d = t.lineitem.select(*LINE_KEY, "l_quantity", F.col("l_extendedprice").cast("double").alias("label"))
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(d)
    c = registry.candidates("regression", 1, 0, key=LINE_KEY, names=["SGDRegressor"])[0]
    out = c.pipeline({"loss": "squaredError", "regParam": 0.2, "elasticNetParam": 1.0, "tol": 1e-9}).fit(d).transform(d)
    return rounded(out.select(*LINE_KEY, F.col("prediction").alias("fitted")), 1)


def _groups(t):
    """Two flags of each line: a large quantity decides the amount, a large discount next to nothing."""
    flags = [(F.col("l_quantity") > 25).cast("double").alias("large"), (F.col("l_discount") > 0.05).cast("double").alias("reduced")]
    d = t.lineitem.select(*LINE_KEY, *flags, F.expr(AMOUNT).alias("label"))
    return VectorAssembler(inputCols=["large", "reduced"], outputCol="features").transform(d)


@query("m5_pruned_tree", f"SELECT l_orderkey, l_linenumber, round(avg({AMOUNT}) OVER (PARTITION BY l_quantity > 25), 1) AS fitted FROM lineitem")
def m5_pruned(t):
    """Splits on the discount go, the one on the quantity stays."""
    d = _groups(t)
    c = registry.candidates("regression", 1, 0, key=LINE_KEY, names=["DecisionTree"])[0]
    out = c.pipeline({"maxDepth": 2, "alpha": 1e10}).fit(d).transform(d)
    return rounded(out.select(*LINE_KEY, F.col("prediction").alias("fitted")), 1)


@query("m5_pruning_path", f"""WITH d AS (SELECT l_quantity > 25 AS large, {AMOUNT} AS y, l_linenumber % 3 = 0 AS held FROM lineitem),
  g AS (SELECT large, avg(y) AS m, var_pop(y) AS v, count(*)::DOUBLE AS n FROM d WHERE NOT held GROUP BY 1), a AS (SELECT avg(y) AS m, var_pop(y) AS v, count(*)::DOUBLE AS n FROM d WHERE NOT held),
  r AS (SELECT (SELECT v FROM a) AS one, (SELECT sum(v * n) / sum(n) FROM g) AS two)
  SELECT 1::BIGINT AS leaves, round((SELECT one - two FROM r) / (SELECT one FROM r), 6) AS alpha, 1.0 AS risk, round((SELECT avg(pow(y - m, 2)) FROM d, a WHERE held) / (SELECT one FROM r), 6) AS held_error
  UNION ALL SELECT 2, NULL, round((SELECT two / one FROM r), 6), round((SELECT avg(pow(y - m, 2)) FROM d JOIN g USING (large) WHERE held) / (SELECT one FROM r), 6)""")
def m5_path(t):
    """The two smallest subtrees, by training and held-out error, as shares of the variance."""
    d = _groups(t)
    train, held = d.filter("l_linenumber % 3 != 0"), d.filter("l_linenumber % 3 = 0")
    path = pruning.pruning_path(held, pruning.PrunedTree(problem="regression", maxDepth=2).grown(train), "regression")
    one = path.filter("leaves = 1").select(F.col("risk").alias("whole"))
    share = lambda c: (F.col(c) / F.col("whole")).alias(c)
    out = path.filter("leaves <= 2").join(F.broadcast(one), F.lit(True))
    return rounded(out.select("leaves", F.when(F.col("leaves") == 1, F.col("alpha") / F.col("whole")).alias("alpha"), share("risk"), share("held_error")), 6)


def _plane_sql(penalty, y="l_extendedprice", out="round({fitted}, 2) AS fitted"):
    out = out.format(fitted="my + wa * (l_quantity - ma) + wb * (l_discount - mb)")
    return f"""WITH s AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg({y}) AS my, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, {y}) AS uy,
      covar_pop(l_discount, {y}) AS vy, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb FROM lineitem),
      q AS (SELECT *, aa + {penalty} * aa / (n - 1) AS qa, bb + {penalty} * bb / (n - 1) AS qb FROM s), w AS (SELECT *, (uy * qb - vy * ab) / (qa * qb - ab * ab) AS wa, (vy * qa - uy * ab) / (qa * qb - ab * ab) AS wb FROM q)
      SELECT l_orderkey, l_linenumber, {out} FROM lineitem, w"""


def _plane(t, family, params):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.col("l_extendedprice").alias("label"))
    d = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(d)
    c = registry.candidates("regression", 1, d.count(), names=[family])[0]
    return rounded(c.pipeline(params).fit(d).transform(d).select("l_orderkey", "l_linenumber", F.col("prediction").alias("fitted")), 2)


@query("m13_least_squares_plane", _plane_sql("0.0"))
def m13_plane(t):
    return _plane(t, "LinearRegression", {})


@query("m13_ridge_plane", _plane_sql("10000.0"))
def m13_ridge_plane(t):
    return _plane(t, "Ridge", {"alpha": 10000.0})


@query("m4_ridge_classifier_plane", _plane_sql("1000.0", f"(2 * ({RULE})::INT - 1)", "CASE WHEN {fitted} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction"))
def m4_plane(t):
    """Two classes are the two sides of the plane of their codes -1 and 1."""
    d = t.lineitem.select(*LINE_KEY, "l_quantity", "l_discount", F.expr(RULE).cast("double").alias("label"))
    d = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(d)
    c = registry.candidates("classification", 1, 0, 2, LINE_KEY, names=["RidgeClassifier"])[0]
    return c.pipeline({"alpha": 1000.0}).fit(d).transform(d).select(*LINE_KEY, "prediction")


def _held_plane_sql(penalty):
    """Held-out parts on the plane of the others, features standardised for the penalty."""
    return f"""WITH {_halves_sql('parts')}, d AS (SELECT p_size::DOUBLE AS a, p_partkey::DOUBLE AS b, label::DOUBLE AS y FROM s WHERE NOT held),
  m AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS uy, covar_pop(b, y) AS vy FROM d),
  q AS (SELECT *, aa + {penalty} * aa / (n - 1) AS qa, bb + {penalty} * bb / (n - 1) AS qb FROM m), w AS (SELECT *, (uy * qb - vy * ab) / (qa * qb - ab * ab) AS wa, (vy * qa - uy * ab) / (qa * qb - ab * ab) AS wb FROM q)
  SELECT p_partkey, round(my + wa * (p_size - ma) + wb * (p_partkey - mb), 4) AS prediction FROM s, w WHERE held"""


@query("m13_linear_regression_rounded", _held_plane_sql("0.0"))
def m13_held(t):
    return rounded(_fit_and_score(parts(t), ["p_partkey"], "LinearRegression", {}, "regression", by=()).select("p_partkey", "prediction"))


@query("m13_ridge_rounded", _held_plane_sql("1.0"))
def m13_ridge_held(t):
    return rounded(_fit_and_score(parts(t), ["p_partkey"], "Ridge", {"alpha": 1.0}, "regression", by=()).select("p_partkey", "prediction"))


@query("m13_least_squares_line", "SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 2) AS fitted FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)")
def m13_line(t):
    from pyspark.ml.regression import LinearRegression

    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("label")))
    out = LinearRegression(solver="normal").fit(d).transform(d)
    return rounded(out.select("l_orderkey", "l_linenumber", F.col("prediction").alias("fitted")), 2)


@query("m16_candidate_pools", "SELECT o_orderpriority AS pool, CASE left(o_orderpriority, 1) WHEN '1' THEN 16 WHEN '2' THEN 7 WHEN '3' THEN 5 WHEN '4' THEN 2 ELSE 13 END::BIGINT AS n_models, count(*)::BIGINT AS n_rows FROM orders GROUP BY 1")
def m16(t):
    """Pools are asked for by parameter: a tier 1-4, or 5 here for the small form of tier 1; the rows decide nothing."""
    out = []
    for row in t.orders.groupBy("o_orderpriority").count().collect():  # five priorities
        tier = int(row["o_orderpriority"][0])
        pool = registry.candidates("classification", tier if tier < 5 else 1, row["count"], small=tier == 5)
        out.append((row["o_orderpriority"], len(pool), row["count"]))
    return t.spark.createDataFrame(out, "pool string, n_models bigint, n_rows bigint")


def _small_pool(rows, key):
    pool = registry.candidates("classification", 1, rows, 2, key, names=["LogisticRegression", "DecisionTree", "GaussianNB"])
    grids = {"LogisticRegression": {"C": [0.1, 1.0]}, "DecisionTree": {"maxDepth": [3]}, "GaussianNB": {}}
    for c in pool:
        c.grid = grids[c.name]
    return pool


@query("m18_grid_search")
def m18(t):
    d = folds(documents(t), ["doc_id"], 3, ["label"])
    c = registry.candidates("classification", 1, d.count(), names=["LogisticRegression"])[0]
    best = search.search(c, d.persist(), 3)
    d.unpersist()
    return t.spark.createDataFrame([(best.name, str(best.params), best.mean, best.std)], "model string, params string, score double, std double")


_RIDGE_FOLDS = """WITH d AS (SELECT l_quantity AS a, l_discount AS b, l_extendedprice AS y, l_linenumber % 3 AS fold FROM lineitem),
  s AS (SELECT fold, count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS uy, sum(b * y) AS vy, sum(y * y) AS yy FROM d GROUP BY fold),
  t AS (SELECT f.fold, g.alpha, sum(n) AS n, sum(a) / sum(n) AS ma, sum(b) / sum(n) AS mb, sum(y) / sum(n) AS my, sum(aa) - sum(a) * sum(a) / sum(n) AS aa, sum(ab) - sum(a) * sum(b) / sum(n) AS ab,
     sum(bb) - sum(b) * sum(b) / sum(n) AS bb, sum(uy) - sum(a) * sum(y) / sum(n) AS uy, sum(vy) - sum(b) * sum(y) / sum(n) AS vy
     FROM s JOIN (SELECT fold FROM s) f ON s.fold <> f.fold, (SELECT unnest([0.1, 10.0, 10000.0])::DOUBLE AS alpha) g GROUP BY ALL),
  p AS (SELECT *, aa + alpha * aa / (n - 1) AS qa, bb + alpha * bb / (n - 1) AS qb FROM t),
  w AS (SELECT *, (uy * qb - vy * ab) / (qa * qb - ab * ab) AS wa, (vy * qa - uy * ab) / (qa * qb - ab * ab) AS wb FROM p)"""


@query("m18_ridge_path", _RIDGE_FOLDS + """ SELECT 'alpha=' || (CASE alpha WHEN 0.1 THEN '0.1' WHEN 10 THEN '10.0' ELSE '10000.0' END) AS params, w.fold::INT AS fold,
  round(1 - sum(pow(y - my - wa * (a - ma) - wb * (b - mb), 2)) / (var_pop(y) * count(*)), 6) AS score FROM w JOIN d ON d.fold = w.fold GROUP BY ALL""")
def m18_ridge(t):
    """Held-out scores of a ridge for three penalties and three folds, from one read of the table."""
    d = t.lineitem.select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_extendedprice")], (F.col("l_linenumber") % 3).alias("fold"))
    found = penalty_paths.paths(d, ["l_quantity", "l_discount"], "l_extendedprice", "fold", {"Ridge": {"alpha": [0.1, 10.0, 10000.0]}})
    return rounded(penalty_paths.path_table(d, found).select("params", "fold", "score"), 6)


@query("m19_final_fit")
def m19(t):
    d = documents(t)
    c = registry.candidates("classification", 1, d.count(), names=["RandomForest"])[0]
    model = search.final_fit(c, {"numTrees": 10, "maxDepth": 4}, d)
    return model.transform(d).select("doc_id", "label", "prediction")


@query("m20_hold_out")
def m20(t):
    d = documents(t)
    c = registry.candidates("classification", 4, d.count(), names=["SGDClassifier"])[0]
    best = search.hold_out(c, d, ["doc_id"], ["label"])
    return t.spark.createDataFrame([(best.name, str(best.params), best.mean)], "model string, params string, score double")


@query("m21_stacking")
def m21(t):
    d = documents(t)
    pool = _small_pool(d.count(), ["doc_id"])
    ranked = [(c, search.Trial(c.name, c.combinations()[0], 0.0, 0.0)) for c in pool]
    stack = ensemble.Stack.fit(ranked, d, ["doc_id"], ["label"])
    return stack.transform(d).select("doc_id", "label", "prediction")


@query("m22_distillation")
def m22(t):
    d = documents(t)
    c = registry.candidates("classification", 1, d.count(), names=["RandomForest"])[0]
    teacher = c.pipeline({"numTrees": 10, "maxDepth": 4}).fit(d)
    return ensemble.distill(teacher, d).transform(d.drop("label")).select("doc_id", "prediction")


@query("m26_leaderboard")
def m26(t):
    d = documents(t)
    return search.leaderboard(_small_pool(d.count(), ["doc_id"]), d, ["doc_id"], ["label"])[0]


@query("m24_batch_scoring")
def m24(t):
    d = documents(t)
    c = registry.candidates("classification", 1, d.count(), names=["LogisticRegression"])[0]
    scored = c.pipeline({"C": 1.0}).fit(d).transform(d)
    return automl.decode(scored, ["no", "yes"]).select("doc_id", "predicted", "confidence")


@query("m25_automl")
def m25(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "lang", "source", "n_chars", "text", "toxic")
    grids = {"GaussianNB": {}, "DecisionTree": {"maxDepth": [3]}}
    model, tables = automl.run(d, "toxic", ["doc_id"], names=list(grids), grids=grids)
    return tables["predictions"].select("doc_id", "label", "prediction", "predicted", "confidence")


CUSTOMERS = """SELECT c_custkey, c_acctbal, n_name AS nation, r_name AS region, c_mktsegment AS segment, coalesce(o.n, 0) AS n_orders, coalesce(o.total, 0) AS total, o.mean, o.lowest, o.highest, o.spread,
  o.high, o.medium, o.low, o.urgent, o.open, o.done, o.first_year, o.first_month, o.clerks, o.half, o.weekend, o.large, o.small, coalesce(o.late, 0) AS active
  FROM {customer} c JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey LEFT JOIN (
  SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, stddev_samp(o_totalprice) AS spread,
   sum(CASE WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority LIKE '3%' THEN 1 ELSE 0 END) AS medium, sum(CASE WHEN o_orderpriority LIKE '5%' THEN 1 ELSE 0 END) AS low,
   sum(CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done,
   min(year(o_orderdate)) AS first_year, min(month(o_orderdate)) AS first_month, count(DISTINCT o_orderpriority) AS clerks, sum(CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END) AS half,
   sum(CASE WHEN dayofweek(o_orderdate) = 1 THEN 1 ELSE 0 END) AS weekend, sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS large, sum(CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END) AS small,
   max(CASE WHEN year(o_orderdate) >= 2001 THEN 1 ELSE 0 END) AS late FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey"""


def customers(t):
    return t.sql(CUSTOMERS)


@query("m25_automl_customers")
def m25_customers(t):
    """All customers with 24 columns through the whole path: the seven families of tier 2 with their default grids, folds, stack, hold-out."""
    _, tables = automl.run(customers(t), "active", ["c_custkey"])
    return tables["summary"]


# --- metrics from prediction tables that both engines derive alike

SCORED = "SELECT doc_id, toxic AS label, CASE WHEN doc_id % 9 = 0 THEN 1 - toxic ELSE toxic END AS prediction, (toxic * 40 + doc_id % 70) / 110.0e0 AS score FROM {labels}"
SCORED_SQL = SCORED.replace("{labels}", "labels")


@query("v1_class_metrics", f"""WITH d AS ({SCORED_SQL}), c AS (SELECT k, count(*) FILTER (label = k AND prediction = k) AS tp, count(*) FILTER (label = k) AS a, count(*) FILTER (prediction = k) AS p FROM d, (SELECT unnest([0, 1]) AS k) GROUP BY k)
  SELECT (SELECT count(*) FROM d)::BIGINT AS n, round((SELECT avg((label = prediction)::INT) FROM d), 4) AS accuracy, round(avg(2.0 * tp / (a + p)), 4) AS f1_macro, 2::BIGINT AS n_classes FROM c""")
def v1(t):
    return rounded(evaluate.class_metrics(t.sql(SCORED)))


@query("v1_confusion", f"SELECT label, prediction, count(*)::BIGINT AS n FROM ({SCORED_SQL}) GROUP BY 1, 2")
def v1_confusion(t):
    return evaluate.confusion(t.sql(SCORED))


@query("v1_roc_auc", f"WITH d AS ({SCORED_SQL}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM d) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 4) AS roc_auc FROM r")
def v1_auc(t):
    return rounded(evaluate.roc_auc(t.sql(SCORED), "score"))


@query("v1_roc_auc_null_sliced", f"WITH d AS (SELECT * FROM ({SCORED_SQL}) WHERE doc_id % 5 > 0), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM d) SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 4) AS roc_auc FROM r")
def v1_auc_null_sliced(t):
    d = t.sql(SCORED).withColumn("score", F.when(F.col("doc_id") % 5 > 0, F.col("score")))
    return rounded(evaluate.roc_auc(d, "score", rows_per_slice=20))


@query("v2_regression_metrics", "SELECT count(*)::BIGINT AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM (SELECT p_retailprice AS y, p_retailprice * 0.9 + p_size AS p FROM part)")
def v2(t):
    d = t.part.select(F.col("p_retailprice").alias("label"), (F.col("p_retailprice") * 0.9 + F.col("p_size")).alias("prediction"))
    return rounded(evaluate.regression_metrics(d))


@query("v3_model_leaderboard")
def v3(t):
    d = documents(t)
    halves = split(d, ["doc_id"], by=["label"], name="part")
    train, test = halves.filter("part = 'train'").drop("part"), halves.filter("part = 'test'").drop("part")
    fitted = {c.name: c.pipeline(c.combinations()[0]).fit(train) for c in _small_pool(d.count(), ["doc_id"])}
    return evaluate.test_leaderboard(fitted, test)


@query("v8_feature_importance")
def v8(t):
    d = documents(t)
    c = registry.candidates("classification", 1, d.count(), names=["RandomForest"])[0]
    return explain.importance_table(d, c.pipeline({"numTrees": 10, "maxDepth": 4}).fit(d), TEXT_FEATURES)


@query("v10_linear_shapley", "WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, round(2.0 * (l_quantity - q), 4) AS shapley FROM lineitem, m UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', round(-3.0 * (l_discount - d), 4) FROM lineitem, m")
def v10(t):
    return rounded(explain.linear_shapley(t.lineitem, [2.0, -3.0], ["l_quantity", "l_discount"], ["l_orderkey", "l_linenumber"]))


@query("v10_sampled_shapley")
def v10_sampled(t):
    d = documents(t)
    c = registry.candidates("classification", 1, d.count(), names=["RandomForest"])[0]
    model = c.pipeline({"numTrees": 10, "maxDepth": 4}).fit(d)
    return explain.sampled_shapley(model, d, TEXT_FEATURES, ["doc_id"], evaluate.probability_of(), rows=500, rounds=4)
