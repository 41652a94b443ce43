import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelab.operators import drift, experience, ledger, scoring

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def runs(spark, changes, n=12):
    """A quiet history of n runs, then one run with the given changes."""
    base = dict(cv_mean=0.85, cv_std=0.03, n_rows=5000.0, n_cols=22.0, n_classes=2.0, overall_missing_pct=4.0, overfitting=False,
                leakage_detected=False, confidence_label="High", best_model="LightGBM")
    rows = []
    for i in range(n + 1):
        r = {**base, **(changes if i == n else {})}
        rows.append((i, START + i * DAY, "f", "t", *r.values()))
    names = "run_id int, ts timestamp, filename string, target string, cv_mean double, cv_std double, n_rows double, n_cols double, " \
            "n_classes double, overall_missing_pct double, overfitting boolean, leakage_detected boolean, confidence_label string, best_model string"
    return spark.createDataFrame(rows, names)


def verdict(spark, **changes):
    out = drift.decide(drift.detect(runs(spark, changes)))
    row = out.orderBy(F.desc("run_id")).first()
    return row["should_retrain"], row["severity"], set(row["fired_triggers"])


@pytest.mark.parametrize("changes,want", [
    ({}, (False, "NONE", set())),
    ({"leakage_detected": True}, (True, "CRITICAL", {"LEAKAGE_DETECTED"})),
    ({"cv_mean": 0.70}, (True, "HIGH", {"PERFORMANCE_DROP"})),
    ({"cv_mean": 0.10}, (True, "CRITICAL", {"PERFORMANCE_DROP"})),
    ({"n_cols": 23.0}, (True, "HIGH", {"DATA_SCHEMA_DRIFT"})),
    ({"n_rows": 9000.0}, (False, "MILD", {"DATA_VOLUME_SHIFT"})),
    ({"n_rows": 9000.0, "overall_missing_pct": 30.0}, (True, "MEDIUM", {"DATA_VOLUME_SHIFT", "MISSING_RATE_SPIKE"})),
])
def test_decisions(spark, changes, want):
    assert verdict(spark, **changes) == want


def test_chunks_do_not_change_results(spark):
    df = runs(spark, {"cv_mean": 0.7}, n=40)
    a = sorted(drift.detect(df).select("run_id", "cv_drop", "overfit_streak", "days_since_retrain").collect())
    import tablelab.operators.history as h

    b = sorted(drift.detect(df, chunk=h.HALO + 1).select("run_id", "cv_drop", "overfit_streak", "days_since_retrain").collect())
    assert a == b


def test_reward_and_scores(spark):
    df = spark.createDataFrame([(0.85, True, True, False)], "c double, o boolean, l boolean, b boolean")
    assert df.select(experience.reward(F.col("c"), F.col("o"), F.col("l"), F.col("b"))).first()[0] == pytest.approx(0.50)
    one = spark.createDataFrame([(0.9, 0.07, 100.0, True)], "cv double, sd double, n double, o boolean")
    score = one.select(scoring.confidence_score(F.col("cv"), F.col("sd"), F.col("n"), F.col("o"))).first()[0]
    assert score == pytest.approx(0.9 - 0.04 - 0.125 - 0.2)
    eff = one.select(scoring.effective_score(F.col("cv"), F.col("sd"), F.lit(0.05))).first()[0]
    assert eff == pytest.approx(0.9 - 0.075 - 0.01)


def test_action_values_match_running_update(spark):
    rewards = [0.8, 0.6, 0.9, 0.75]
    mean = m2 = 0.0
    for i, r in enumerate(rewards, 1):
        delta = r - mean
        mean += delta / i
        m2 += delta * (r - mean)
    df = spark.createDataFrame([("b", "A", r) for r in rewards] + [("b", "B", 0.5)], "bucket string, action string, reward double")
    got = {r["action"]: r for r in experience.action_values(df).collect()}
    assert got["A"]["avg_reward"] == pytest.approx(mean) and got["A"]["variance"] == pytest.approx(m2 / 3)
    assert got["B"]["variance"] == 0.0
    first = experience.rank_actions(experience.action_values(df), ["A", "B", "C"]).filter("rank = 1").first()
    assert first["action"] == "C"


def test_non_negative_ridge_is_optimal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = x @ np.array([1.0, -2.0, 0.3])
    w = ledger.ridge(x.T @ x, x.T @ y, non_negative=True)
    loss = lambda v: ((y - x @ v) ** 2).sum() + (v**2).sum()
    assert (w >= 0).all()
    for _ in range(200):
        assert loss(w) <= loss(np.clip(w + rng.normal(scale=0.05, size=3), 0, None)) + 1e-9


def test_family_and_profile(spark):
    df = spark.createDataFrame([("XGBClassifier",), ("Logistic_Regression",), ("Stack",), ("GaussianNB",)], "m string")
    assert [r[0] for r in df.select(ledger.family_index(F.col("m"))).collect()] == [2, 0, 4, 3]
    key = ledger.profile_key(F.lit("classification"), F.lit(5000), F.lit(22), F.lit(4.0), F.lit(1.2))
    assert df.select(key).first()[0] == "classification|rows:small|feat:medium|mis:clean|imb:balanced"


def test_psi(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"), F.lit(1.0).alias("flat"))
    assert drift.psi(a, a, ["v", "flat"]).first()["psi"] == pytest.approx(0.0)
    moved = a.withColumn("v", F.col("v") * 0.3)
    out = drift.drift_summary(drift.psi(a, moved, ["v"])).first()
    assert out["is_drifting"] and out["severity"] == "significant"


def test_small_history_keeps_defaults(spark):
    df = spark.createDataFrame([(0.9, 0.7, True)], "confidence double, reward double, overfitting boolean")
    df = df.withColumn("leakage", F.lit(False)).withColumn("baseline_alert", F.lit(False))
    assert ledger.reward_penalty_weights(df) == {"overfitting": 0.20, "leakage": 0.15, "baseline_alert": 0.10}
