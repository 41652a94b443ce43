"""Experience log, run ledger, drift and scoring queries. Runs and experiences are derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import plain, query, rounded
from tablelab.operators import drift, experience, ledger, scoring, reports
from tablelab.session import shared_folder
from tablelab.functions.fixed_values import ACTIONS

ACTION_CASE = "CASE user_id % 8 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ACTIONS)) + " END"
EXP = f"""SELECT CAST(floor(event_id / 5) AS BIGINT) AS run_id, event_id, ts, event_type AS agent, {ACTION_CASE} AS action,
  CASE WHEN value / 60 > 1 THEN 1.0 ELSE round(value / 60, 6) END AS reward, concat('b', user_id % 11) AS bucket, value FROM {{events}}"""
EXP_SQL = plain(EXP)
# Figures of a run: all from whole numbers, so that both engines see the same doubles.
RUNS = """SELECT event_id AS run_id, ts, event_type AS filename, 'y' AS target,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE (50 + (event_id * 7 + user_id) % 45) / 100.0e0 END AS cv_mean,
  ((event_id * 3) % 23) / 100.0e0 AS cv_std, (user_id % 4 = 0) AS overfitting, (event_id % 97 = 0) AS leakage_detected,
  (1000 + (user_id % 7) * 100) * 1.0e0 AS n_rows, CASE WHEN user_id % 50 = 0 THEN 21.0e0 ELSE 20.0e0 END AS n_cols, 2.0e0 AS n_classes,
  ((event_id * 13) % 29) * 1.0e0 AS overall_missing_pct, CASE user_id % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS confidence_label,
  CASE event_id % 5 WHEN 0 THEN 'XGBoost' WHEN 1 THEN 'Ridge' WHEN 2 THEN 'RandomForest' WHEN 3 THEN 'LightGBM' ELSE 'Stacking(Ridge+KNN)' END AS best_model,
  (event_id % 400 = 0) AS retrained FROM {events}"""
RUNS_SQL = plain(RUNS)
FLAT = """SELECT event_id, ts, event_type, user_id, CASE WHEN user_id % 3 = 0 THEN 'regression' ELSE 'classification' END AS problem_type,
  CASE event_id % 5 WHEN 0 THEN 'XGBoost' WHEN 1 THEN 'Ridge' WHEN 2 THEN 'RandomForest' WHEN 3 THEN 'LightGBM' ELSE 'Stacking(Ridge+KNN)' END AS best_model,
  (50 + (event_id * 7 + user_id) % 45) / 100.0e0 AS cv, (50 + (event_id * 11) % 43) / 100.0e0 AS acc, ((event_id * 3) % 23) / 100.0e0 AS sd,
  (user_id % 4 = 0) AS over, (event_id % 97 = 0) AS leak, (event_id % 31 = 0) AS alert, ((event_id * 5) % 90 + 10) / 100.0e0 AS conf,
  (10 + (user_id * 37) % 400) * 1.0e0 AS n_rows, (5 + user_id % 60) * 1.0e0 AS n_cols, ((event_id * 13) % 29) * 1.0e0 AS miss, (10 + user_id % 60) / 10.0e0 AS imb FROM {events}"""
FLAT_SQL = plain(FLAT)


def _experiences(t):
    return t.sql(EXP)


def _ledger(t):
    f = t.sql(FLAT)
    return f.select(
        F.col("event_id").alias("run_id"), "ts", F.col("event_type").alias("filename"), F.lit("y").alias("target"), "problem_type", "best_model",
        F.col("alert").alias("baseline_alert"),
        F.struct(
            F.col("cv").alias("cv_score_mean"), F.col("sd").alias("cv_score_std"), F.col("acc").alias("accuracy"), F.col("over").alias("overfitting"),
            F.col("leak").alias("leakage_detected"), F.col("conf").alias("confidence_score"),
        ).alias("metrics"),
        F.struct(
            F.col("n_rows"), F.col("n_cols"), F.col("miss").alias("overall_missing_pct"), F.col("imb").alias("imbalance_ratio"),
        ).alias("dataset_diagnostics"),
    )


@query("x1_make_experiences", "SELECT event_id AS run_id, event_type AS agent, round(CASE WHEN value / 60 > 1 THEN 1.0 WHEN value / 60 < 0 THEN 0.0 ELSE value / 60 END, 6) AS reward FROM events")
def x1(t):
    raw = t.events.select(F.col("event_id").cast("string").alias("run_id"), "ts", F.col("event_type").alias("agent"), (F.col("value") / 60).alias("reward"))
    return experience.make_experiences(raw).select(F.col("run_id").cast("bigint").alias("run_id"), "agent", "reward")


@query("x2_find", f"SELECT event_id, action, round(reward, 4) AS reward FROM (SELECT * FROM ({EXP_SQL}) WHERE agent = 'click' AND reward BETWEEN 0.2 AND 2.0 ORDER BY ts DESC, event_id DESC LIMIT 100)")
def x2(t):
    return rounded(experience.find(_experiences(t), agent="click", min_reward=0.2, n=100, tie=["event_id"]).select("event_id", "action", "reward"))


@query("x3_reward_stats", f"SELECT round(avg(reward), 4) AS mean, round(stddev_pop(reward), 4) AS std, round(min(reward), 4) AS min, round(max(reward), 4)::DOUBLE AS max, count(*)::BIGINT AS count FROM ({EXP_SQL})")
def x3(t):
    return experience.reward_stats(_experiences(t))


@query("x4_best_actions", f"SELECT action, round(avg(reward), 4) AS mean_reward, count(*)::BIGINT AS count, round(stddev_pop(reward), 4) AS std FROM ({EXP_SQL}) WHERE bucket = 'b3' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def x4(t):
    return experience.best_actions(_experiences(t), bucket="b3")


@query("x5_best_action_per_bucket", f"""WITH s AS (SELECT bucket, action, round(avg(reward), 4) AS m, count(*) AS n FROM ({EXP_SQL}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY m DESC, action) AS k FROM s)
  SELECT bucket, CASE WHEN n >= 3 THEN action ELSE 'NO_OVERRIDE' END AS action FROM r WHERE k = 1""")
def x5(t):
    return experience.best_action_per_bucket(_experiences(t))


@query("x6_training_set", "SELECT event_id AS run_id, value AS v, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE event_id END::DOUBLE AS w, 0.0::DOUBLE AS z, round(value / 60, 6) AS label FROM events")
def x6(t):
    d = t.events.select(
        F.col("event_id").alias("run_id"), F.create_map(F.lit("v"), F.col("value")).alias("state"),
        F.create_map(F.lit("w"), F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("event_id").cast("double"))).alias("outcome"),
        F.lit(None).cast("map<string,double>").alias("uncertainty"), F.round(F.col("value") / 60, 6).alias("reward"),
    )
    return experience.training_set(d, ["v", "w", "z"])


@query("x7_cross_agent", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY run_id, agent ORDER BY ts DESC, event_id DESC) AS k FROM ({EXP_SQL}))
  SELECT run_id, max(action) FILTER (agent = 'click') AS click_action, round(max(reward) FILTER (agent = 'click'), 4) AS click_reward, max(action) FILTER (agent = 'view') AS view_action, round(max(reward) FILTER (agent = 'view'), 4) AS view_reward FROM d WHERE k = 1 GROUP BY 1""")
def x7(t):
    d = _experiences(t).withColumn("uncertainty", F.create_map(F.lit("epistemic_uncertainty"), F.col("reward")))
    out = experience.cross_agent_features(d, ["click", "view"], tie="event_id")
    return rounded(out.select("run_id", "click_action", "click_reward", "view_action", "view_reward"))


@query("x8_log_summary", f"SELECT agent, count(*)::BIGINT AS n FROM ({EXP_SQL}) GROUP BY 1")
def x8(t):
    return experience.log_summary(_experiences(t))["agents"]


@query("x9_state_bucket", """SELECT event_id, concat('classification|t', 1 + user_id % 4, '|rows:', CASE WHEN r < 200 THEN 'tiny' WHEN r < 10000 THEN 'small' WHEN r < 100000 THEN 'medium' ELSE 'large' END, '|feat:',
  CASE WHEN f < 10 THEN 'low' WHEN f < 50 THEN 'medium' WHEN f < 200 THEN 'high' ELSE 'very_high' END, '|mis:', CASE WHEN m < 0.05 THEN 'clean' WHEN m < 0.2 THEN 'moderate' ELSE 'heavy' END, '|imb:',
  CASE WHEN s IS NULL THEN 'n/a' WHEN s < 0.6 THEN 'balanced' WHEN s < 0.8 THEN 'moderate' ELSE 'imbalanced' END) AS bucket
  FROM (SELECT event_id, user_id, user_id * user_id * 10 AS r, user_id % 300 AS f, (user_id % 40) / 100.0e0 AS m, CASE WHEN user_id % 5 = 0 THEN NULL ELSE (50 + user_id % 50) / 100.0e0 END AS s FROM events)""")
def x9(t):
    u = F.col("user_id")
    share = F.when(u % 5 != 0, (50 + u % 50) / F.lit(100.0))
    key = experience.state_bucket(u * u * 10, u % 300, (u % 40) / F.lit(100.0), share, F.lit("classification"), 1 + u % 4)
    return t.events.select("event_id", key.alias("bucket"))


@query("x10_action_values", f"SELECT bucket, action, count(*)::BIGINT AS trials, round(avg(reward), 4) AS avg_reward, round(coalesce(var_samp(reward), 0), 4) AS variance FROM ({EXP_SQL}) GROUP BY 1, 2")
def x10(t):
    return rounded(experience.action_values(_experiences(t)))


ACTIONS_SQL = "[" + ", ".join(f"'{a}'" for a in experience.ACTIONS) + "]"


X11_SQL = f"""WITH v AS (SELECT bucket, action, count(*) AS n, avg(reward) AS m, coalesce(var_samp(reward), 0) AS s FROM ({EXP_SQL}) WHERE action <> 'AGGRESSIVE_FS' GROUP BY 1, 2),
  b AS (SELECT bucket, max(m) AS hi, greatest(0.005, 0.05 * (max(m) - min(m))) AS band, sum(n) AS total, 1.41 * (1 + sqrt(avg(s))) AS c FROM v GROUP BY 1),
  r AS (SELECT v.bucket, v.action, n, CASE WHEN hi - m <= band THEN 1 ELSE 2 END AS g, CASE WHEN hi - m <= band THEN m + c * sqrt(ln(total) / n) ELSE m END AS score FROM v JOIN b USING (bucket)
   UNION ALL SELECT bucket, action, 0, 0, -i FROM b, (SELECT unnest({ACTIONS_SQL}) AS action, unnest(range(0, {len(experience.ACTIONS)})) AS i) a WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.bucket = b.bucket AND v.action = a.action))
  SELECT bucket, action, n::BIGINT AS trials, row_number() OVER (PARTITION BY bucket ORDER BY g, score DESC, action)::INTEGER AS rank FROM r"""


@query("x11_action_ranking", X11_SQL)
def x11(t):
    values = experience.action_values(_experiences(t).filter("action <> 'AGGRESSIVE_FS'"))
    return experience.rank_actions(values).select("bucket", "action", "trials", "rank")


@query("x11_choose_known", f"""WITH k AS ({X11_SQL}), d AS (SELECT c_custkey, concat('b', c_custkey % 13) AS bucket FROM customer)
  SELECT c_custkey, coalesce(action, 'NO_OVERRIDE') AS action, CASE WHEN action IS NULL THEN 'cold_start' ELSE 'learned' END AS source FROM d LEFT JOIN (SELECT bucket, action FROM k WHERE rank = 1) USING (bucket)""")
def x11_known(t):
    """States of known buckets take the first-ranked action, those of two unknown ones the rule."""
    values = experience.action_values(_experiences(t).filter("action <> 'AGGRESSIVE_FS'"))
    states = t.customer.select("c_custkey", F.concat(F.lit("b"), F.col("c_custkey") % 13).alias("bucket"), F.lit(5000).alias("rows"), F.lit(9).alias("features"),
                               F.lit(0.5).alias("majority"), F.lit("classification").alias("problem_type"))
    return experience.choose_actions(states, values).select("c_custkey", "action", "source")


@query("x11_choose_actions", """SELECT c_custkey, CASE WHEN s > 0.8 THEN 'AGGRESSIVE_FS' WHEN r >= 50000 THEN 'BOOST_ENSEMBLE' WHEN r < 500 THEN 'PRIORITISE_LINEAR' WHEN f > r THEN 'CONSERVATIVE_FS' WHEN r >= 10000 THEN 'PRIORITISE_BOOSTING' ELSE 'NO_OVERRIDE' END AS action, 'cold_start' AS source
  FROM (SELECT c_custkey, (c_custkey % 100) / 100.0e0 AS s, (c_custkey * 53) % 60000 AS r, c_custkey % 900 AS f FROM customer)""")
def x11_choose(t):
    k = F.col("c_custkey")
    states = t.customer.select("c_custkey", F.lit("unseen").alias("bucket"), ((k * 53) % 60000).alias("rows"), (k % 900).alias("features"), ((k % 100) / F.lit(100.0)).alias("majority"), F.lit("classification").alias("problem_type"))
    return experience.choose_actions(states, experience.action_values(_experiences(t))).select("c_custkey", "action", "source")


@query("x12_cold_start_classifier")
def x12(t):
    best = experience.best_action_per_bucket(_experiences(t))
    d = _experiences(t).join(best.withColumnRenamed("action", "best"), "bucket").select(
        "event_id", (F.substring("bucket", 2, 3).cast("double")).alias("x0"), F.col("value").alias("x1"), "best"
    )
    model = ledger.fit_classifier(d, "best", ["x0", "x1"], at_least=20)
    return ledger.classify(model, d).select("event_id", "predicted")


@query("x13_rewards", """SELECT event_id, round(greatest(0, least(1, conf - (CASE WHEN over THEN 0.20 ELSE 0 END + CASE WHEN leak THEN 0.15 ELSE 0 END + CASE WHEN alert THEN 0.10 ELSE 0 END))), 4)::DOUBLE AS reward FROM ("""
       + FLAT_SQL + ")")
def x13(t):
    f = t.sql(FLAT)
    return rounded(f.select("event_id", experience.reward(F.col("conf"), F.col("over"), F.col("leak"), F.col("alert")).alias("reward")))


@query("x14_system_stats", f"SELECT count(*)::BIGINT AS total_runs, round(avg(conf), 4) AS avg_reward, round(avg(CASE WHEN over THEN 1.0 ELSE 0.0 END), 4) AS retrain_rate, round(avg(CASE WHEN leak THEN 1.0 ELSE 0.0 END), 4) AS error_rate FROM ({FLAT_SQL})")
def x14(t):
    f = t.sql(FLAT).select(F.col("conf").alias("reward"), F.col("over").alias("retrained"), F.when(F.col("leak"), F.lit("e")).alias("error"))
    return experience.system_stats(f)


@query("x14_action_counts", f"SELECT action, count(*)::BIGINT AS n FROM ({EXP_SQL}) GROUP BY 1")
def x14_counts(t):
    return experience.action_counts(_experiences(t))


@query("x15_state_hints", f"""SELECT event_id AS run_id, event_type AS filename, coalesce(lag(n_rows) OVER w, 1000.0)::DOUBLE AS prev_rows, coalesce(lag(problem_type) OVER w, 'classification') AS prev_problem_type,
  CASE WHEN lag(event_id) OVER w IS NULL THEN 'neutral_default' ELSE 'ledger_match' END AS source FROM ({FLAT_SQL}) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def x15(t):
    return ledger.state_hints(_ledger(t)).select("run_id", "filename", F.col("prev_rows").cast("double").alias("prev_rows"), "prev_problem_type", "source")


@query("x15_state_hints_chunked", f"""SELECT event_id AS run_id, coalesce(lag(n_rows) OVER w, 1000.0)::DOUBLE AS prev_rows FROM ({FLAT_SQL}) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""")
def x15_chunked(t):
    return ledger.state_hints(_ledger(t), chunk=300).select("run_id", "prev_rows")


@query("x15_run_summary", f"SELECT event_id AS run_id, best_model, round(cv, 4) AS cv_mean, round(acc, 4) AS test_score, over AS overfitting FROM ({FLAT_SQL})")
def x15_summary(t):
    return rounded(ledger.summarise_runs(_ledger(t)).select("run_id", "best_model", "cv_mean", "test_score", "overfitting"))


@query("l1_size_penalty_weight", f"""SELECT round(greatest(0.05, least(0.5, sum(x * y) / (sum(x * x) + 1))), 4) AS weight FROM (SELECT 1 - n_rows / 200 AS x, least(1, greatest(0, cv - acc) / (1 - n_rows / 200)) AS y FROM ({FLAT_SQL}) WHERE n_rows < 200 AND 1 - n_rows / 200 >= 1e-6)""")
def l1(t):
    return rounded(t.spark.createDataFrame([(ledger.size_penalty_weight(_ledger(t)),)], "weight double"))


@query("l2_confidence_penalty_weights")
def l2(t):
    w = ledger.confidence_penalty_weights(_ledger(t))
    return rounded(t.spark.createDataFrame(list(w.items()), "name string, weight double"))


@query("l3_reward_penalty_weights", f"""WITH d AS (SELECT over::INT::DOUBLE AS a, leak::INT::DOUBLE AS b, alert::INT::DOUBLE AS c, greatest(0, conf - conf * acc) AS y FROM ({FLAT_SQL})),
  g AS (SELECT sum(a*a)+1 AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b)+1 AS bb, sum(b*c) AS bc, sum(c*c)+1 AS cc, sum(a*y) AS ay, sum(b*y) AS yb, sum(c*y) AS cy FROM d),
  k AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM g)
  SELECT 'overfitting' AS name, round(greatest(0, least(0.5, (ay*(bb*cc-bc*bc) - ab*(yb*cc-bc*cy) + ac*(yb*bc-bb*cy)) / det)), 4) AS weight FROM k
  UNION ALL SELECT 'leakage', round(greatest(0, least(0.5, (aa*(yb*cc-bc*cy) - ay*(ab*cc-bc*ac) + ac*(ab*cy-yb*ac)) / det)), 4) FROM k
  UNION ALL SELECT 'baseline_alert', round(greatest(0, least(0.5, (aa*(bb*cy-yb*bc) - ab*(ab*cy-yb*ac) + ay*(ab*bc-bb*ac)) / det)), 4) FROM k""")
def l3(t):
    f = t.sql(FLAT).select(F.col("conf").alias("confidence"), (F.col("conf") * F.col("acc")).alias("reward"), F.col("over").alias("overfitting"), F.col("leak").alias("leakage"), F.col("alert").alias("baseline_alert"))
    return rounded(t.spark.createDataFrame(list(ledger.reward_penalty_weights(f).items()), "name string, weight double"))


@query("l4_confidence_blend_weights")
def l4(t):
    w = ledger.confidence_blend_weights(_ledger(t))
    return rounded(t.spark.createDataFrame(list(enumerate(w)), "component int, weight double"))


@query("l5_learned_thresholds", f"""WITH d AS (SELECT cv_mean AS a, cv_std AS b, retrained::INT::DOUBLE AS y FROM ({RUNS_SQL}) WHERE cv_mean IS NOT NULL AND cv_std IS NOT NULL),
  m AS (SELECT covar_pop(a, y) * count(*) / (var_pop(a) * count(*) + 1) AS sa, covar_pop(b, y) * count(*) / (var_pop(b) * count(*) + 1) AS sb, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM d HAVING count(*) >= 30 AND sum(y) >= 3)
  SELECT 'drop_threshold' AS name, round(greatest(0.02, least(0.15, (0.5 - (my - sa * ma)) / sa)), 4) AS threshold FROM m WHERE abs(sa) > 1e-6 UNION ALL SELECT 'variance_threshold', round(greatest(0.04, least(0.2, (0.5 - (my - sb * mb)) / sb)), 4) FROM m WHERE abs(sb) > 1e-6""")
def l5(t):
    d = t.sql(RUNS).withColumn("label", F.col("retrained"))
    return rounded(t.spark.createDataFrame(list(ledger.learned_thresholds(d).items()), "name string, threshold double"))


NAMES = ["LogisticRegression", "RandomForest", "XGBoost", "GaussianNB"]


@query("l6_rule_priority", """WITH d AS (SELECT c_custkey, (c_custkey * 53) % 20000 AS r, c_custkey % 30 AS f FROM customer),
  s AS (SELECT c_custkey, 'LogisticRegression' AS model, (CASE WHEN r < 500 THEN 2.0 ELSE 0 END + CASE WHEN f > r THEN 1.5 ELSE 0 END) AS score FROM d
   UNION ALL SELECT c_custkey, 'RandomForest', (CASE WHEN r >= 10000 THEN 1.0 ELSE 0 END + CASE WHEN f <= 10 THEN 1.0 ELSE 0 END) FROM d
   UNION ALL SELECT c_custkey, 'XGBoost', (CASE WHEN r < 500 THEN -1.0 ELSE 0 END + CASE WHEN r >= 10000 THEN 2.0 ELSE 0 END + CASE WHEN f > r THEN -0.5 ELSE 0 END + CASE WHEN f <= 10 THEN 0.5 ELSE 0 END) FROM d
   UNION ALL SELECT c_custkey, 'GaussianNB', (CASE WHEN r < 500 THEN 1.5 ELSE 0 END) FROM d)
  SELECT c_custkey, model, score::DOUBLE AS score, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, model)::INTEGER AS rank FROM s""")
def l6(t):
    k = F.col("c_custkey")
    profiles = t.customer.select("c_custkey", ((k * 53) % 20000).alias("n_rows"), (k % 30).alias("n_features"))
    return ledger.rule_ranking(profiles, NAMES, "c_custkey").select("c_custkey", "model", "score", "rank")


@query("l6_learned_priority")
def l6_learned(t):
    model = ledger.fit_priority_scorer(_ledger(t))
    k = F.col("c_custkey")
    profiles = t.customer.select("c_custkey", ((k * 53) % 20000).cast("double").alias("n_rows"), (k % 30).cast("double").alias("n_features"), F.lit("classification").alias("problem_type"), F.lit(5.0).alias("missing_pct"))
    return ledger.learned_ranking(model, profiles, NAMES, "c_custkey")


PROFILE = """concat(problem_type, '|rows:', CASE WHEN n_rows < 200 THEN 'tiny' WHEN n_rows < 10000 THEN 'small' WHEN n_rows < 100000 THEN 'medium' ELSE 'large' END, '|feat:', CASE WHEN n_cols < 10 THEN 'low' WHEN n_cols < 50 THEN 'medium' WHEN n_cols < 200 THEN 'high' ELSE 'very_high' END,
  '|mis:', CASE WHEN miss < 5 THEN 'clean' WHEN miss < 20 THEN 'moderate' ELSE 'heavy' END, '|imb:', CASE WHEN imb < 1.5 THEN 'balanced' WHEN imb < 4 THEN 'moderate' ELSE 'severe' END)"""
META_SQL = f"SELECT *, {PROFILE} AS profile FROM ({FLAT_SQL})"


@query("l7_l8_meta_features", f"SELECT event_id AS run_id, profile, round(cv, 4) AS cv_mean, round(sd, 4) AS cv_std, over::INTEGER AS overfitting, leak::INTEGER AS leakage, alert::INTEGER AS baseline_alert, 1.0::DOUBLE AS fs_ratio FROM ({META_SQL})")
def l8(t):
    return rounded(ledger.meta_features(_ledger(t)).select("run_id", "profile", "cv_mean", "cv_std", "overfitting", "leakage", "baseline_alert", "fs_ratio"))


@query("l9_meta_table", f"SELECT profile, count(*)::BIGINT AS n_runs, count(*) FILTER (over)::BIGINT AS overfitting_count, count(*) FILTER (leak)::BIGINT AS leakage_count, count(*) FILTER (alert)::BIGINT AS baseline_alert_count, count(*) FILTER (best_model LIKE '%Stacking%')::BIGINT AS stacking_wins FROM ({META_SQL}) GROUP BY 1")
def l9(t):
    return ledger.meta_table(ledger.meta_features(_ledger(t)))


@query("l9_model_wins", f"SELECT profile, best_model AS model, count(*)::BIGINT AS wins, round(count(*) / sum(count(*)) OVER (PARTITION BY profile), 3) AS win_rate, row_number() OVER (PARTITION BY profile ORDER BY count(*) DESC, best_model)::INTEGER AS rank FROM ({META_SQL}) GROUP BY 1, 2")
def l9_wins(t):
    return ledger.model_wins(ledger.meta_features(_ledger(t)))


@query("l10_l12_profile_insights", f"""WITH m AS ({META_SQL}), s AS (SELECT profile, round(cv, 4) AS score, row_number() OVER (PARTITION BY profile ORDER BY ts DESC, event_id DESC) AS k FROM m),
  q AS (SELECT profile, count(*) AS n, round(avg(score), 4) AS mu, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi, stddev_samp(score) AS sd FROM s WHERE k <= 200 GROUP BY 1), c AS (SELECT profile, count(*) AS runs, count(*) FILTER (best_model LIKE '%Stacking%') AS st FROM m GROUP BY 1)
  SELECT profile, runs::BIGINT AS profile_match_count, CASE WHEN n >= 3 THEN round(lo, 4) ELSE mu END AS expected_cv_low, mu AS expected_cv_mean, CASE WHEN n >= 3 THEN round(hi, 4) ELSE mu END AS expected_cv_high, round(st / runs, 3) AS stacking_win_rate,
  CASE WHEN qual >= 0.65 THEN 'High' WHEN qual >= 0.3 THEN 'Medium' ELSE 'Low' END AS confidence FROM (SELECT *, least(runs, 20) / 20.0 * 0.6 + CASE WHEN n >= 2 THEN greatest(0, 1 - sd / 0.15) ELSE 0.5 END * 0.4 AS qual FROM q JOIN c USING (profile))""")
def l10(t):
    return ledger.profile_insights(ledger.meta_features(_ledger(t))).drop("risk_flags", "top_models")


@query("l11_risk_thresholds", f"""WITH c AS (SELECT profile, avg(over::INT) AS a, avg(leak::INT) AS b, avg(alert::INT) AS d FROM ({META_SQL}) GROUP BY 1)
  SELECT 'overfitting' AS flag, round(greatest(0.2, least(0.7, quantile_cont(a, 0.75))), 4)::DOUBLE AS threshold FROM c UNION ALL SELECT 'leakage', round(greatest(0.2, least(0.7, quantile_cont(b, 0.75))), 4)::DOUBLE FROM c UNION ALL SELECT 'baseline_alert', round(greatest(0.2, least(0.7, quantile_cont(d, 0.75))), 4)::DOUBLE FROM c""")
def l11(t):
    return rounded(ledger.risk_thresholds(ledger.meta_table(ledger.meta_features(_ledger(t)))))


@query("l13_recommendations", f"""WITH m AS ({META_SQL}), c AS (SELECT profile, avg((best_model LIKE '%Stacking%')::INT) AS rate FROM m GROUP BY 1)
  SELECT event_id AS run_id, profile, CASE WHEN leak THEN 'leakage_priority' WHEN alert THEN 'baseline_priority' WHEN over AND n_rows < 500 THEN 'overfit_small' WHEN rate >= 0.6 THEN 'stacking_wins' WHEN imb > 4 THEN 'severe_imbalance' WHEN sd > 0.08 THEN 'high_cv_variance' ELSE 'model_preference' END AS category FROM m JOIN c USING (profile)""")
def l13(t):
    return ledger.recommendations(ledger.meta_features(_ledger(t))).drop("text")  # the wording is ours


@query("l13_learned_recommendations")
def l13_learned(t):
    d = ledger.meta_features(_ledger(t)).withColumn("category", ledger.training_category())
    return ledger.classify(ledger.fit_classifier(d, "category"), d).select("run_id", "category", "predicted")


@query("l14_cold_start", f"""SELECT event_id AS run_id, (n_rows < 200) AS very_small, (miss > 20) AS high_missing, (imb > 4) AS severe, CASE WHEN n_rows >= 1000 THEN 'LightGBM' ELSE 'LogisticRegression' END AS first_model FROM ({FLAT_SQL})""")
def l14(t):
    flags = ledger.cold_start_flags(F.col("n_rows"), F.col("n_cols"), F.col("miss"), F.col("imb"))
    has = lambda k: F.array_contains(flags, k)
    return t.sql(FLAT).select(F.col("event_id").alias("run_id"), has("very_small").alias("very_small"), has("high_missing").alias("high_missing"), has("severe_imbalance").alias("severe"), ledger.cold_start_models(F.col("n_rows"))[0].alias("first_model"))


@query("l14_family_suggestions")
def l14_family(t):
    d = ledger.meta_features(_ledger(t)).withColumn("family", ledger.win_family(F.col("best_model"))).filter("family is not null")
    return ledger.classify(ledger.fit_classifier(d, "family", at_least=10), d, floor=0.0).select("run_id", "predicted", "p")


@query("l15_predicted_scores")
def l15(t):
    meta = ledger.meta_features(_ledger(t))
    return ledger.predict_scores(ledger.fit_score_regressor(meta), meta)


@query("l16_family_index", f"SELECT event_id, CASE best_model WHEN 'XGBoost' THEN 2 WHEN 'Ridge' THEN 0 WHEN 'RandomForest' THEN 1 WHEN 'LightGBM' THEN 2 ELSE 0 END::INTEGER AS family FROM ({FLAT_SQL})")
def l16(t):
    return t.sql(FLAT).select("event_id", ledger.family_index(F.col("best_model")).cast("int").alias("family"))


@query("l17_l18_run_scalars", f"""WITH d AS (SELECT *, least(1, greatest(0, (sd * 5 + least(1, greatest(0, 1 - log10(greatest(n_rows, 1)) / 7)) * 0.3) / 1.3)) AS epi, least(1, greatest(0, (1 - cv) * 0.6)) AS ale FROM ({FLAT_SQL}))
  SELECT event_id AS run_id, round(least(1, sd / 0.5), 4)::DOUBLE AS cv_std_n, round(least(1, log10(n_rows + 1) / 7), 4)::DOUBLE AS n_rows_norm, round(miss / 100, 4) AS missing_pct, round(epi, 4)::DOUBLE AS epistemic_uncertainty, round(ale, 4)::DOUBLE AS aleatoric_uncertainty,
  round(least(1, greatest(0, conf * 0.5 + (1 - epi) * 0.25 + (1 - ale) * 0.15 + 0.5 * 0.1)), 4)::DOUBLE AS calibrated_confidence FROM d""")
def l17(t):
    names = ["run_id", "cv_std_n", "n_rows_norm", "missing_pct", "epistemic_uncertainty", "aleatoric_uncertainty", "calibrated_confidence"]
    return rounded(ledger.run_scalars(_ledger(t)).select(*names))


@query("l19_run_vectors", f"SELECT event_id AS run_id, 20::INTEGER AS a, 18::INTEGER AS b, 12::INTEGER AS c, round(cv, 4) AS cv FROM ({FLAT_SQL})")
def l19(t):
    v = ledger.run_vectors(ledger.run_scalars(_ledger(t)))
    return rounded(v.select("run_id", F.size("state_vector").alias("a"), F.size("meta_vector").alias("b"), F.size("retrain_vector").alias("c"), F.col("meta_vector")[0].alias("cv")))


# --- drift

ROLL = "list_filter(list(cv_mean) OVER (PARTITION BY filename ORDER BY ts, run_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)[-20:]"
D_BASE = f"""WITH r AS ({RUNS_SQL}), a AS (SELECT *, {ROLL} AS v, list(n_rows) OVER w AS vr, list(overall_missing_pct) OVER w AS vm, list(n_cols) OVER w AS vc, list(cv_std) OVER w AS vs FROM r WINDOW w AS (PARTITION BY filename ORDER BY ts, run_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
  b AS (SELECT *, list_avg(v[1:greatest(1, len(v) // 2)]) AS cv_base, list_avg(vr[1:greatest(1, len(vr) // 2)]) AS nr_base, list_avg(vm[1:greatest(1, len(vm) // 2)]) AS ms_base, list_avg(vc[1:greatest(1, len(vc) // 2)]) AS nc_base, coalesce(list_avg(vs), cv_std) AS sd_ref FROM a),
  f AS (SELECT *, leakage_detected AS d2, coalesce(round(cv_base - cv_mean, 9) > 0.05, false) AS d3, coalesce(abs(n_cols - nc_base) > 0, false) AS d4, round(sd_ref, 9) > 0.16 AS d5,
   sum(overfitting::INT) OVER (PARTITION BY filename ORDER BY ts, run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS d6, coalesce(round(abs(n_rows - nr_base) / nr_base * 100, 9) > 30, false) AS d7, coalesce(round(overall_missing_pct - ms_base, 9) > 10, false) AS d8,
   sum((confidence_label = 'Low')::INT) OVER (PARTITION BY filename ORDER BY ts, run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS d9,
   coalesce(date_diff('day', coalesce(max(CASE WHEN retrained THEN ts END) OVER (PARTITION BY filename ORDER BY ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(ts) OVER (PARTITION BY filename))::DATE, ts::DATE) > 5, false) AS d10,
   (len(list(best_model) OVER w4) = 4 AND len(list_distinct(list(best_model) OVER w4)) = 4) AS d11 FROM b WINDOW w4 AS (PARTITION BY filename ORDER BY ts, run_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
"""
D_SELECT = """SELECT run_id, d2 AS fired_LEAKAGE_DETECTED, d3 AS fired_PERFORMANCE_DROP, d4 AS fired_DATA_SCHEMA_DRIFT, d5 AS fired_HIGH_VARIANCE, d6 AS fired_OVERFIT_STREAK, d7 AS fired_DATA_VOLUME_SHIFT, d8 AS fired_MISSING_RATE_SPIKE, d9 AS fired_CONFIDENCE_LOW, d10 AS fired_TIME_ELAPSED, d11 AS fired_MODEL_FLIP_STREAK FROM f"""
LIMITS = {"max_days_without_retrain": 5}


def _detected(t, chunk=100_000):
    return drift.detect(t.sql(RUNS), retrained="retrained", limits=LIMITS, chunk=chunk)


@query("d0_snapshots", f"SELECT event_id AS run_id, round(cv, 4) AS cv_mean, round(acc, 4) AS test_score, over AS overfitting, leak AS leakage_detected, alert AS baseline_alert, n_rows, best_model, 0.0::DOUBLE AS orig_features FROM ({FLAT_SQL})")
def d0(t):
    return rounded(drift.snapshots(_ledger(t)).select("run_id", "cv_mean", "test_score", "overfitting", "leakage_detected", "baseline_alert", "n_rows", "best_model", "orig_features"))


@query("d1_rolling", D_BASE + "SELECT run_id, round(cv_base, 4) AS cv_mean_base, round(list_avg(v), 4) AS cv_mean_roll, round(list_avg(vs), 4) AS cv_std_roll FROM f")
def d1(t):
    out = drift.rolling(t.sql(RUNS)).filter("not _extra")
    return rounded(out.select("run_id", "cv_mean_base", "cv_mean_roll", "cv_std_roll"))


@query("d2_d11_detectors", D_BASE + D_SELECT)
def d11(t):
    return _detected(t).select("run_id", *[drift.flag_name(n) for n, _ in drift.TRIGGERS])


@query("d2_d11_detectors_chunked", D_BASE + D_SELECT)
def d11_chunked(t):
    return _detected(t, chunk=500).select("run_id", *[drift.flag_name(n) for n, _ in drift.TRIGGERS])


GAPPED = RUNS.replace("event_type AS filename", "nullif(event_type, 'view') AS filename")


@query("d2_d11_null_chunked", D_BASE.replace(RUNS_SQL, plain(GAPPED)) + D_SELECT)
def d11_null_chunked(t):
    out = drift.detect(t.sql(GAPPED), retrained="retrained", limits=LIMITS, chunk=500)
    return out.select("run_id", *[drift.flag_name(n) for n, _ in drift.TRIGGERS])


@query("d13_alert_vectors_null_chunked", f"""SELECT run_id, leakage_detected::INT::DOUBLE AS a0, (cv_std > 0.08)::INT::DOUBLE AS a3,
  coalesce(lead(retrained) OVER (PARTITION BY filename ORDER BY ts, run_id), false)::INT::DOUBLE AS label FROM ({plain(GAPPED)})""")
def d13_null_chunked(t):
    runs = t.sql(GAPPED)
    return drift.alert_vectors(runs, runs.filter("retrained"), chunk=500).select("run_id", "a0", "a3", "label")


@query("d12_decisions", D_BASE + """SELECT run_id, CASE WHEN coalesce(cv_mean < 0.3, false) OR d2 THEN 'CRITICAL' WHEN NOT (d3 OR d4 OR d5 OR d6 OR d7 OR d8 OR d9 OR d10 OR d11) THEN 'NONE' WHEN d3 OR d4 THEN 'HIGH'
  WHEN d5::INT + d6::INT + d7::INT + d8::INT + d9::INT >= 2 THEN 'MEDIUM' WHEN d10::INT + d11::INT >= 3 THEN 'LOW' ELSE 'MILD' END AS severity FROM f""")
def d12(t):
    return drift.decide(_detected(t)).select("run_id", "severity")


@query("d13_learned_decisions")
def d13(t):
    runs = t.sql(RUNS)
    vectors = drift.alert_vectors(runs, runs.filter("retrained"))
    return drift.RetrainScorer.fit(vectors).transform(vectors).select("run_id", "label", "p_retrain", "verdict")


@query("d13_alert_vectors", f"""SELECT run_id, leakage_detected::INT::DOUBLE AS a0, (coalesce(cv_mean, 0.5) < 0.7)::INT::DOUBLE AS a1, (cv_std > 0.08)::INT::DOUBLE AS a3,
  coalesce(lead(retrained) OVER (PARTITION BY filename ORDER BY ts, run_id), false)::INT::DOUBLE AS label FROM ({RUNS_SQL})""")
def d13_vectors(t):
    runs = t.sql(RUNS)
    return drift.alert_vectors(runs, runs.filter("retrained"), chunk=500).select("run_id", "a0", "a1", "a3", "label")


@query("d14_alert_report", D_BASE + "SELECT trigger, severity, count(*) FILTER (fired)::BIGINT AS fired FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS trigger, '{s}' AS severity, d{i + 2} AS fired FROM f" for i, (n, s) in enumerate(drift.TRIGGERS)) + ") GROUP BY 1, 2")
def d14(t):
    return drift.alerts_long(_detected(t)).groupBy("trigger", "severity").agg(F.count_if("fired").alias("fired"))


_L5 = f"""l AS (WITH d AS (SELECT cv_mean AS a, cv_std AS b, retrained::INT::DOUBLE AS y FROM ({RUNS_SQL}) WHERE cv_mean IS NOT NULL AND cv_std IS NOT NULL),
  m AS (SELECT covar_pop(a, y) * count(*) / (var_pop(a) * count(*) + 1) AS sa, covar_pop(b, y) * count(*) / (var_pop(b) * count(*) + 1) AS sb, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM d HAVING count(*) >= 30 AND sum(y) >= 3)
  SELECT coalesce(max(CASE WHEN abs(sa) > 1e-6 THEN greatest(0.02, least(0.15, (0.5 - (my - sa * ma)) / sa)) END), 0.05) AS fall, coalesce(max(CASE WHEN abs(sb) > 1e-6 THEN greatest(0.04, least(0.2, (0.5 - (my - sb * mb)) / sb)) END), 0.08) AS wide FROM m), """


@query("d14_learned_report", ("WITH " + _L5 + D_BASE[5:]).replace("> 0.05, false) AS d3", "> (SELECT fall FROM l), false) AS d3").replace("> 0.16 AS d5", "> 2 * (SELECT wide FROM l) AS d5").replace("> 30, false) AS d7", "> 20, false) AS d7")
       + "SELECT trigger, severity, count(*) FILTER (fired)::BIGINT AS fired FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS trigger, '{s}' AS severity, d{i + 2} AS fired FROM f" for i, (n, s) in enumerate(drift.TRIGGERS)) + ") GROUP BY 1, 2")
def d14_learned(t):
    report = reports.alert_report(t.sql(RUNS), retrained="retrained", config={**LIMITS, "volume_shift_pct": 20.0})
    return report.groupBy("trigger", "severity").agg(F.count_if("fired").alias("fired"))


@query("d15_appended_retrains", D_BASE + """, s AS (SELECT run_id, ts, filename, CASE WHEN coalesce(cv_mean < 0.3, false) OR d2 THEN 'CRITICAL' WHEN NOT (d3 OR d4 OR d5 OR d6 OR d7 OR d8 OR d9 OR d10 OR d11) THEN 'NONE' WHEN d3 OR d4 THEN 'HIGH'
  WHEN d5::INT + d6::INT + d7::INT + d8::INT + d9::INT >= 2 THEN 'MEDIUM' WHEN d10::INT + d11::INT >= 3 THEN 'LOW' ELSE 'MILD' END AS severity FROM f)
  SELECT filename, count(*)::BIGINT AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_retrain FROM s WHERE severity NOT IN ('NONE', 'MILD') GROUP BY 1""")
def d15_appended(t):
    path = f"{shared_folder(t.spark)}/retrains"
    decided = drift.decide(_detected(t))
    for part in (decided.filter("run_id % 2 = 0"), decided.filter("run_id % 2 = 1"), decided.filter("run_id % 2 = 1")):  # the last one comes twice
        reports.append_retrain_events(part, path)
    events = reports.retrain_events(t.spark, path)
    last = reports.last_retrains(events, ["filename"]).select("filename", F.date_format("last_retrain", "yyyy-MM-dd HH:mm:ss").alias("last_retrain"))
    return events.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).join(last, "filename")


@query("d15_retrain_events", f"SELECT filename, run_id FROM ({RUNS_SQL}) WHERE retrained")
def d15(t):
    return t.sql(RUNS).filter("retrained").select("filename", "run_id")


PSI_SQL = """WITH d AS (SELECT value, ts < TIMESTAMP '2024-01-16' AS first FROM events), r AS (SELECT min(value) AS lo, max(value) AS hi FROM d), n AS (SELECT count(*) FILTER (first) AS nb, count(*) FILTER (NOT first) AS nc FROM d),
  h AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) FILTER (first) AS b, count(*) FILTER (NOT first) AS c FROM d, r GROUP BY 1),
  s AS (SELECT (coalesce(b, 0) + 1e-6) / nb AS pb, (coalesce(c, 0) + 1e-6) / nc AS pc FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN h USING (bin), n)
  SELECT 'value' AS "column", round(abs(sum((pc - pb) * ln(pc / pb))), 4) AS psi FROM s"""


@query("d16_psi", PSI_SQL)
def d16(t):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return rounded(drift.psi(t.events.filter(early), t.events.filter(~early), ["value"]))


RUN_PSI_SQL = f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY ts, run_id) AS a, row_number() OVER (ORDER BY ts DESC, run_id DESC) AS z FROM ({RUNS_SQL})),
  e AS (SELECT 'b' AS side, cv_mean, cv_std, n_rows FROM o WHERE a <= 20 UNION ALL SELECT 'c', cv_mean, cv_std, n_rows FROM o WHERE z <= 10),
  d AS (SELECT side, unnest(['cv_mean', 'cv_std', 'n_rows']) AS "column", unnest([cv_mean, cv_std, n_rows]) AS v FROM e),
  r AS (SELECT "column", min(v) AS lo, max(v) AS hi, count(*) FILTER (side = 'b' AND v IS NOT NULL) AS nb, count(*) FILTER (side = 'c' AND v IS NOT NULL) AS nc FROM d GROUP BY 1 HAVING min(v) < max(v)),
  h AS (SELECT "column", least(floor((v - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'c') AS c FROM d JOIN r USING ("column") WHERE v IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT "column", (coalesce(b, 0) + 1e-6) / greatest(nb, 1) AS pb, (coalesce(c, 0) + 1e-6) / greatest(nc, 1) AS pc FROM (SELECT *, unnest(range(10)) AS bin FROM r) LEFT JOIN h USING ("column", bin))
  SELECT "column", round(abs(sum((pc - pb) * ln(pc / pb))), 4) AS psi FROM s GROUP BY 1"""


@query("d16_run_drift", RUN_PSI_SQL)
def d16_runs(t):
    return rounded(drift.run_drift(t.sql(RUNS), ["cv_mean", "cv_std", "n_rows"]))


# --- score rules


@query("r1_effective_score", f"SELECT event_id, round(greatest(0, cv - 0.15 * least(1, greatest(0, acc - cv) / 0.1) - CASE WHEN sd > 0.05 THEN 0.5 * (sd - 0.05) ELSE 0 END), 4)::DOUBLE AS effective_score FROM ({FLAT_SQL})")
def r1(t):
    f = t.sql(FLAT)
    return rounded(f.select("event_id", scoring.effective_score(F.col("cv"), F.col("sd"), F.col("acc") - F.col("cv")).alias("effective_score")))


@query("r2_model_ranking", f"""WITH s AS (SELECT best_model AS model, count(*) AS n, avg(cv) AS m FROM ({FLAT_SQL}) GROUP BY 1), k AS (SELECT *, m + 1.41 * sqrt(ln(sum(n) OVER ()) / n) AS u, max(m) OVER () - m <= 0.005 AS near FROM s)
  SELECT model, n::BIGINT AS trials, round(m, 4) AS avg_score, round(u, 4) AS ucb, near AS near_best, row_number() OVER (ORDER BY near DESC, CASE WHEN near THEN u ELSE m END DESC, model)::INTEGER AS rank FROM k""")
def r2(t):
    return rounded(scoring.model_ranking(t.sql(FLAT), "best_model", "cv").withColumnRenamed("best_model", "model"))


@query("v5_overfit_flags", f"SELECT event_id, (acc - cv > 0.1) AS overfit FROM ({FLAT_SQL})")
def v5(t):
    return t.sql(FLAT).select("event_id", scoring.overfit(F.col("acc"), F.col("cv")).alias("overfit"))


@query("v6_confidence", f"""WITH s AS (SELECT event_id, round(greatest(0, cv - CASE WHEN sd > 0.05 THEN least(0.3, (sd - 0.05) * 2) ELSE 0 END - CASE WHEN n_rows * 4 < 200 THEN least(0.3, (1 - n_rows * 4 / 200) * 0.25) ELSE 0 END - CASE WHEN over THEN 0.2 ELSE 0 END), 4)::DOUBLE AS score FROM ({FLAT_SQL}))
  SELECT event_id, score, CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS label FROM s""")
def v6(t):
    s = scoring.confidence_score(F.col("cv"), F.col("sd"), F.col("n_rows") * 4, F.col("over"))
    return t.sql(FLAT).select("event_id", s.alias("score")).withColumn("label", scoring.confidence_label(F.col("score")))


@query("v7_ratings", f"SELECT event_id, CASE WHEN acc >= 0.9 AND acc - 0.5 >= 0.2 THEN 'Excellent' WHEN acc >= 0.75 AND acc - 0.5 >= 0.1 THEN 'Good' WHEN acc - 0.5 > 0.02 THEN 'Fair' ELSE 'Poor' END AS class_rating, CASE WHEN cv >= 0.9 THEN 'Excellent' WHEN cv >= 0.75 THEN 'Good' WHEN cv >= 0.5 THEN 'Fair' ELSE 'Poor' END AS fit_rating FROM ({FLAT_SQL})")
def v7(t):
    return t.sql(FLAT).select("event_id", scoring.class_rating(F.col("acc"), F.lit(0.5)).alias("class_rating"), scoring.fit_rating(F.col("cv")).alias("fit_rating"))


@query("v4_baseline_alerts", f"SELECT event_id, (cv - 0.6 <= 0.01) AS alert FROM ({FLAT_SQL})")
def v4_alerts(t):
    return t.sql(FLAT).select("event_id", scoring.baseline_alert(F.col("cv"), F.lit(0.6)).alias("alert"))


@query("v11_error_profile", """WITH c AS (SELECT quality AS label, toxic AS prediction, count(*) AS n FROM labels GROUP BY 1, 2), p AS (SELECT label, n / (sum(n) OVER (PARTITION BY label) + 1e-9) AS p FROM c), e AS (SELECT label, sum(-p * ln(p + 1e-9)) AS e FROM p GROUP BY 1)
  SELECT round(least(1, greatest(0, avg(e) / ln(greatest(count(*), 2)))), 5)::DOUBLE AS cm_entropy FROM e""")
def v11(t):
    c = t.labels.groupBy(F.col("quality").alias("label"), F.col("toxic").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.error_profile(c)


@query("v11_residual_profile", f"SELECT event_id, round(1 / (1 + acc), 5) AS mae, round(1 / (1 + cv), 5) AS rmse, round(cv, 5) AS r2, round(least(1, abs(cv - acc) / (acc + 1e-9) / 10), 5)::DOUBLE AS residual_spread FROM ({FLAT_SQL})")
def v11_residuals(t):
    parts = scoring.residual_profile(F.col("cv"), F.col("acc"), F.col("cv"))
    return t.sql(FLAT).select("event_id", *[c.alias(k) for k, c in parts.items()])


@query("m23_pooled_trials", f"SELECT best_model AS model, count(*)::BIGINT AS seeds, round(avg(cv), 4) AS mean_score, round(sqrt(avg(sd * sd) + var_pop(cv)), 4) AS pooled_std FROM ({FLAT_SQL}) GROUP BY 1")
def m23(t):
    d = t.sql(FLAT).select(F.col("best_model").alias("model"), F.col("cv").alias("score"), F.col("sd").alias("std"))
    return rounded(scoring.pooled_trials(d))
