"""Analytics over the experience log: rewards, action values, rankings and training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelab.functions.columns import banded, clamp, col, null_safe_join
from tablelab.functions.fixed_values import ACTIONS

NUMBERS = T.MapType(T.StringType(), T.DoubleType())
EXPERIENCES = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("agent", T.StringType()),
    T.StructField("state", NUMBERS), T.StructField("action", T.StringType()), T.StructField("outcome", NUMBERS),
    T.StructField("reward", T.DoubleType()), T.StructField("uncertainty", NUMBERS),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])


def make_experiences(df: DataFrame) -> DataFrame:
    """Records with the reward clamped to [0, 1] and rounded, maps never NULL."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    empty_text = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    have = set(df.columns)
    fields = []
    for f in EXPERIENCES.fields:
        c = col(f.name) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name == "reward":
            c = F.round(clamp(F.coalesce(c.cast("double"), F.lit(0.0))), 6)
        elif f.name == "meta":
            c = F.coalesce(c, empty_text)
        elif f.dataType == NUMBERS:
            c = F.coalesce(c, empty)
        fields.append(c.alias(f.name))
    return df.select(*fields)


def find(
    df: DataFrame, *, agent: str | None = None, action: str | None = None, run_id: str | None = None,
    min_reward: float = -1.0, max_reward: float = 2.0, n: int | None = None, tie: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Matching records in time order; the newest ``n`` when given."""
    out = df.filter(F.coalesce("reward", F.lit(0.0)).between(min_reward, max_reward))
    for name, value in (("agent", agent), ("action", action), ("run_id", run_id)):
        if value is not None:
            out = out.filter(col(name) == value)
    if n is not None:
        out = out.orderBy(F.desc("ts"), *[F.desc(t) for t in tie]).limit(n)
    return out.orderBy("ts", *tie)


def reward_stats(df: DataFrame, agent: str | None = None) -> DataFrame:
    """mean, population deviation, min, max and count; 0 without records."""
    base = df if agent is None else df.filter(col("agent") == agent)
    r = F.coalesce("reward", F.lit(0.0))
    zero = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0))
    return base.agg(
        zero(F.avg(r)).alias("mean"), zero(F.stddev_pop(r)).alias("std"), zero(F.min(r)).alias("min"),
        zero(F.max(r)).alias("max"), F.count(F.lit(1)).alias("count"),
    )


def best_actions(df: DataFrame, *, bucket: str | None = None, agent: str | None = None, top: int = 3) -> DataFrame:
    """Actions by mean reward."""
    base = df
    if agent is not None:
        base = base.filter(col("agent") == agent)
    if bucket is not None:
        base = base.filter(col("bucket") == bucket)
    r = F.coalesce("reward", F.lit(0.0))
    stats = base.groupBy("action").agg(
        F.round(F.avg(r), 4).alias("mean_reward"), F.count(F.lit(1)).alias("count"), F.round(F.stddev_pop(r), 4).alias("std")
    )
    return stats.orderBy(F.desc("mean_reward"), "action").limit(top)


def best_action_per_bucket(df: DataFrame, fallback: str = "NO_OVERRIDE", at_least: int = 3) -> DataFrame:
    """Best action of every bucket; with too few observations of it the fallback."""
    stats = df.groupBy("bucket", "action").agg(F.round(F.avg("reward"), 4).alias("m"), F.count(F.lit(1)).alias("n"))
    best = stats.groupBy("bucket").agg(F.min(F.struct((-F.col("m")).alias("k"), F.col("action"), F.col("n"))).alias("b"))
    return best.select("bucket", F.when(F.col("b.n") >= at_least, F.col("b.action")).otherwise(fallback).alias("action"))


def training_set(df: DataFrame, keys: Sequence[str], label: str = "reward") -> DataFrame:
    """One numeric column per key out of state, outcome and uncertainty; later maps win, gaps are 0."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    maps = [F.coalesce(col(m), empty) for m in ("uncertainty", "outcome", "state")]

    def value(k: str) -> Column:
        v = F.coalesce(*[F.try_element_at(m, F.lit(k)) for m in maps])
        return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v), F.lit(0.0))

    y = col("reward") if label == "reward" else F.try_element_at(F.coalesce(col("outcome"), empty), F.lit(label))
    usable = y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    return df.filter(usable).select("run_id", *[value(k).alias(k) for k in keys], y.alias("label"))


def cross_agent_features(df: DataFrame, agents: Sequence[str], tie: str = "ts") -> DataFrame:
    """One row per run: last action, reward and uncertainty of every agent."""
    figure = lambda k, d: F.coalesce(F.try_element_at(col("uncertainty"), F.lit(k)), F.lit(d))
    entry = F.struct(
        F.col("ts"), F.col(tie).alias("tie"), F.col("action"), F.col("reward"),
        figure("epistemic_uncertainty", 0.0).alias("epistemic"), figure("aleatoric_uncertainty", 0.0).alias("aleatoric"),
        figure("calibrated_confidence", 0.5).alias("confidence"),
    )
    last = df.groupBy("run_id").agg(*[F.max(F.when(col("agent") == a, entry)).alias(f"_{i}") for i, a in enumerate(agents)])
    parts = ("action", "reward", "epistemic", "aleatoric", "confidence")
    return last.select("run_id", *[F.col(f"_{i}.{p}").alias(f"{a}_{p}") for i, a in enumerate(agents) for p in parts])


def log_summary(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "total": df.agg(F.count(F.lit(1)).alias("total")),
        "agents": df.groupBy("agent").agg(F.count(F.lit(1)).alias("n")),
        "reward": reward_stats(df),
        "best_actions": best_actions(df, top=5),
    }


ROW_BANDS = ((200, "tiny"), (10_000, "small"), (100_000, "medium"))
FEATURE_BANDS = ((10, "low"), (50, "medium"), (200, "high"))
MISSING_BANDS = ((0.05, "clean"), (0.20, "moderate"))
SHARE_BANDS = ((0.60, "balanced"), (0.80, "moderate"))


def state_bucket(rows: Column, features: Column, missing: Column, majority: Column, problem: Column, tier: Column) -> Column:
    """Text key of a state: problem type, tier, rows, features, missing ratio and majority share."""
    share = F.when(majority.isNull(), F.lit("n/a")).otherwise(banded(majority, SHARE_BANDS, "imbalanced"))
    return F.concat(
        problem, F.lit("|t"), tier.cast("int").cast("string"),
        F.lit("|rows:"), banded(rows, ROW_BANDS, "large"), F.lit("|feat:"), banded(features, FEATURE_BANDS, "very_high"),
        F.lit("|mis:"), banded(missing, MISSING_BANDS, "heavy"), F.lit("|imb:"), share,
    )


def action_values(df: DataFrame) -> DataFrame:
    """Trials, mean and sample variance of the reward per bucket and action; variance 0 below two trials."""
    return df.groupBy("bucket", "action").agg(
        F.count(F.lit(1)).alias("trials"), F.avg("reward").alias("avg_reward"),
        F.coalesce(F.var_samp("reward"), F.lit(0.0)).alias("variance"),
    )


def rank_actions(values: DataFrame, actions: Sequence[str] = ACTIONS) -> DataFrame:
    """Every action of every known bucket in order of choice.

    Untried actions come first in their listed order, then the near-best band by its upper
    confidence bound, then the rest by mean reward. Each bucket has as many rows as actions.
    """
    order = F.create_map(*[x for i, a in enumerate(actions) for x in (F.lit(a), F.lit(i))])
    listed = values.filter(col("action").isin(list(actions)))
    every = listed.select("bucket").distinct().withColumn("action", F.explode(F.array(*[F.lit(a) for a in actions])))
    untried = null_safe_join(every, listed.select("bucket", "action"), ["bucket", "action"], "left_anti").select(
        "bucket", "action", F.lit(0).cast("bigint").alias("trials"), F.lit(None).cast("double").alias("avg_reward"),
        F.lit(None).cast("double").alias("variance"),
    )
    both = listed.select("bucket", "action", "trials", "avg_reward", "variance").unionByName(untried)
    w = Window.partitionBy("bucket")
    best, worst = F.max("avg_reward").over(w), F.min("avg_reward").over(w)
    c = 1.41 * (1.0 + F.sqrt(F.avg("variance").over(w)))
    tried = F.col("trials") > 0
    bound = F.col("avg_reward") + c * F.sqrt(F.log(F.sum("trials").over(w).cast("double")) / F.col("trials"))
    near = best - F.col("avg_reward") <= F.greatest(F.lit(0.005), 0.05 * (best - worst))
    scored = both.select("*", F.when(tried, bound).alias("ucb"), F.when(tried, near).alias("near_best"))
    ranking = Window.partitionBy("bucket").orderBy(
        F.when(~tried, 0).when(F.col("near_best"), 1).otherwise(2),
        F.when(~tried, F.try_element_at(order, F.col("action"))).otherwise(0),
        F.desc(F.when(F.col("near_best"), F.round("ucb", 9)).otherwise(F.round("avg_reward", 9))),
        "action",
    )
    return scored.withColumn("rank", F.row_number().over(ranking))


def cold_start_action(rows: Column, features: Column, majority: Column, problem: Column) -> Column:
    """Rule for buckets without any record."""
    return (
        F.when((problem == "classification") & (majority > 0.80), "AGGRESSIVE_FS")
        .when(rows >= 50_000, "BOOST_ENSEMBLE")
        .when(rows < 500, "PRIORITISE_LINEAR")
        .when(features > rows, "CONSERVATIVE_FS")
        .when(rows >= 10_000, "PRIORITISE_BOOSTING")
        .otherwise("NO_OVERRIDE")
    )


def choose_actions(states: DataFrame, values: DataFrame) -> DataFrame:
    """First-ranked action per state; states of unknown buckets take the cold-start rule."""
    first = rank_actions(values).filter("rank = 1").select(col("bucket").alias("_b"), col("action").alias("_a"))
    rule = cold_start_action(col("rows"), col("features"), col("majority"), col("problem_type"))
    joined = states.join(first, col("bucket").eqNullSafe(F.col("_b")), "left")
    return joined.withColumn("action", F.coalesce("_a", rule)).withColumn(
        "source", F.when(F.col("_a").isNull(), "cold_start").otherwise("learned")
    ).drop("_a", "_b")


def reward(
    confidence: Column, overfitting: Column, leakage: Column, alert: Column, weights: dict[str, float] | None = None
) -> Column:
    """Confidence minus the penalties of the three flags, clamped to [0, 1]."""
    w = {"overfitting": 0.20, "leakage": 0.15, "baseline_alert": 0.10, **(weights or {})}
    flag = lambda c, k: F.when(c, F.lit(w[k])).otherwise(0.0)
    penalty = flag(overfitting, "overfitting") + flag(leakage, "leakage") + flag(alert, "baseline_alert")
    return clamp(confidence - F.greatest(F.lit(0.0), penalty))


def system_stats(log: DataFrame) -> DataFrame:
    """Total runs, mean reward, retrain rate and error rate."""
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("total_runs"), F.round(F.avg("reward"), 4).alias("avg_reward"),
        F.round(F.try_divide(F.count_if(F.coalesce("retrained", F.lit(False))).cast("double"), n.cast("double")), 4).alias("retrain_rate"),
        F.round(F.try_divide(F.count_if(col("error").isNotNull()).cast("double"), n.cast("double")), 4).alias("error_rate"),
    )


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("action", F.lit("unknown")).alias("action")).agg(F.count(F.lit(1)).alias("n"))
