"""Drift and retrain monitoring: every run is judged against the runs before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelab.functions.columns import col, null_safe_join, one_row
from tablelab.functions.fixed_values import CATASTROPHIC_CV_FLOOR, DRIFT_LIMITS
from tablelab.operators import history as h
from tablelab.operators.counts import long_numbers
from tablelab.operators.eda import _ranges, bin_number

TRIGGERS = (
    ("LEAKAGE_DETECTED", "CRITICAL"), ("PERFORMANCE_DROP", "HIGH"), ("DATA_SCHEMA_DRIFT", "HIGH"),
    ("HIGH_VARIANCE", "MEDIUM"), ("OVERFIT_STREAK", "MEDIUM"), ("DATA_VOLUME_SHIFT", "MEDIUM"),
    ("MISSING_RATE_SPIKE", "MEDIUM"), ("CONFIDENCE_LOW", "MEDIUM"), ("TIME_ELAPSED", "LOW"), ("MODEL_FLIP_STREAK", "LOW"),
)


def flag_name(trigger: str) -> str:
    """Column that tells whether a detector fired."""
    return f"fired_{trigger}"


METRICS = ("cv_mean", "cv_std", "n_cols", "n_classes", "n_rows", "overall_missing_pct")
RING = 200


def snapshots(runs: DataFrame) -> DataFrame:
    """Flat snapshot of nested run records with their fallbacks."""
    m, d = "metrics", "dataset_diagnostics"
    pick = lambda *names: F.coalesce(*[col_path(runs, n) for n in names])
    return runs.select(
        "run_id", "ts", "filename", "target",
        pick(f"{m}.cv_score_mean").cast("double").alias("cv_mean"), pick(f"{m}.cv_score_std").cast("double").alias("cv_std"),
        pick(f"{m}.test_score", f"{m}.accuracy", f"{m}.R2").cast("double").alias("test_score"),
        pick(f"{m}.confidence_score").cast("double").alias("confidence_score"), pick(f"{m}.confidence_label").alias("confidence_label"),
        F.coalesce(pick(f"{m}.overfitting").cast("boolean"), F.lit(False)).alias("overfitting"),
        F.coalesce(pick(f"{m}.leakage_detected", "leakage_detected").cast("boolean"), F.lit(False)).alias("leakage_detected"),
        F.coalesce(pick(f"{m}.baseline_alert", "baseline_alert").cast("boolean"), F.lit(False)).alias("baseline_alert"),
        pick(f"{d}.n_rows", f"{m}.n_train").cast("double").alias("n_rows"), pick(f"{d}.n_cols").cast("double").alias("n_cols"),
        pick(f"{d}.overall_missing_pct").cast("double").alias("overall_missing_pct"),
        pick(f"{m}.n_classes", f"{d}.n_classes").cast("double").alias("n_classes"),
        pick(f"{d}.imbalance_ratio").cast("double").alias("imbalance_ratio"),
        F.coalesce(pick(f"{m}.original_features").cast("double"), F.lit(0.0)).alias("orig_features"),
        F.coalesce(pick("best_model").cast("string"), F.lit("unknown")).alias("best_model"),
        F.coalesce(pick("problem_type").cast("string"), F.lit("unknown")).alias("problem_type"),
        pick(f"{m}.scale_tier", "scale_tier").cast("double").alias("scale_tier"),
    )


def col_path(df: DataFrame, path: str) -> Column:
    """A nested field, or NULL where the table has no such field."""
    here = df.schema
    for part in path.split("."):
        if not hasattr(here, "names") or part not in here.names:
            return F.lit(None)
        here = here[part].dataType
    return F.col(path)


def gap_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at least one NULL."""
    got = df.agg(*[F.coalesce(F.bool_or(col(c).isNull()), F.lit(False)).alias(c) for c in columns]).first()
    return [c for c in columns if got[c]]


def rolling(
    runs: DataFrame, by: Sequence[str] = ("filename", "target"), time: str = "ts", tie: str = "run_id",
    limits: dict | None = None, chunk: int = h.CHUNK,
) -> DataFrame:
    """Rolling means, deviations and baselines of the numeric metrics before each run."""
    limits = {**DRIFT_LIMITS, **(limits or {})}
    n = int(limits["window_size"])
    gaps = gap_columns(runs, METRICS)
    out = h.chunked(runs, by, time, [tie], RING, chunk)
    out = out.select(*[col(c).cast("double").alias(c) if c in METRICS else col(c) for c in out.columns])
    out = h.last_values(out, {m: f"_{m}" for m in METRICS}, by, n, gaps, RING)
    return out.select(
        "*",
        *[h.baseline_of(F.col(f"_{m}")).alias(f"{m}_base") for m in METRICS],
        *[h.mean_of(F.col(f"_{m}")).alias(f"{m}_roll") for m in METRICS],
        *[h.std_of(F.col(f"_{m}")).alias(f"{m}_roll_std") for m in METRICS],
    ).drop(*[f"_{m}" for m in METRICS])


def detect(
    runs: DataFrame, by: Sequence[str] = ("filename", "target"), time: str = "ts", tie: str = "run_id",
    limits: dict | None = None, retrained: str | None = None, chunk: int = h.CHUNK,
) -> DataFrame:
    """One row per run with a flag per detector and the figures behind it.

    ``retrained`` names a boolean column that marks runs after which a retrain took place.
    """
    limits = {**DRIFT_LIMITS, **(limits or {})}
    out = rolling(runs, by, time, tie, limits, chunk)
    over_n, low_n, flip_n = (int(limits[k]) for k in ("overfit_streak_n", "confidence_streak_n", "model_flip_streak_n"))
    before = h.frame(by, -(over_n - 1), -1)
    streak = F.coalesce(F.sum(F.when(col("overfitting"), 1).otherwise(0)).over(before), F.lit(0))
    out = out.withColumn("overfit_streak", streak + F.when(col("overfitting"), 1).otherwise(0))
    gaps = gap_columns(runs, ["confidence_label", "best_model"])
    out = h.last_values(out, {"confidence_label": "_labels"}, by, low_n - 1, gaps, RING)
    out = h.last_values(out, {"best_model": "_models"}, by, flip_n - 1, gaps, RING)
    mark = F.when(col(retrained), col(time)) if retrained else F.lit(None).cast(dict(runs.dtypes)[time])
    out = h.carried_max(out.withColumn("_mark", mark), "_mark", by, "last_retrain")
    first = runs.groupBy(*[col(b) for b in by]).agg(F.min(col(time)).alias("_first"))
    first = first.select(*[col(b).alias(f"_f{i}") for i, b in enumerate(by)], "_first")
    out = out.join(first, [col(b).eqNullSafe(F.col(f"_f{i}")) for i, b in enumerate(by)])
    out = out.filter(~F.col("_extra"))
    low = F.size(F.filter("_labels", lambda v: v == "Low")) + F.when(col("confidence_label") == "Low", 1).otherwise(0)
    flips = F.concat("_models", F.array(col("best_model")))
    days = F.datediff(col(time), F.coalesce("last_retrain", "_first"))
    drop = F.col("cv_mean_base") - col("cv_mean")
    shift = F.when(F.col("n_rows_base") != 0, F.abs(col("n_rows") - F.col("n_rows_base")) / F.col("n_rows_base") * 100)
    spike = col("overall_missing_pct") - F.col("overall_missing_pct_base")
    changed = lambda m: F.coalesce(F.abs(col(m) - F.col(f"{m}_base")) > 0, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "LEAKAGE_DETECTED": yes(col("leakage_detected")),
        "PERFORMANCE_DROP": yes(F.round(drop, 9) > limits["drop_threshold"]),
        "DATA_SCHEMA_DRIFT": changed("n_cols") | changed("n_classes"),
        "HIGH_VARIANCE": yes(F.round(F.coalesce("cv_std_roll", "cv_std"), 9) > limits["variance_threshold"] * 2),
        "OVERFIT_STREAK": F.col("overfit_streak") >= over_n,
        "DATA_VOLUME_SHIFT": yes(F.round(shift, 9) > limits["volume_shift_pct"]),
        "MISSING_RATE_SPIKE": yes(F.round(spike, 9) > limits["missing_spike_pp"]),
        "CONFIDENCE_LOW": low >= low_n,
        "TIME_ELAPSED": yes(days > limits["max_days_without_retrain"]),
        "MODEL_FLIP_STREAK": (F.size(flips) >= flip_n) & (F.size(F.array_distinct(flips)) == F.size(flips)),
    }
    base = [col(c) for c in runs.columns]
    return out.select(
        *base, drop.alias("cv_drop"), shift.alias("volume_shift_pct"), spike.alias("missing_spike_pp"),
        F.coalesce("cv_std_roll", "cv_std").alias("variance_reference"), "overfit_streak", low.alias("low_streak"),
        days.alias("days_since_retrain"), *[f.alias(flag_name(t)) for t, f in flags.items()],
    )


def decide(detected: DataFrame) -> DataFrame:
    """should_retrain, severity and fired triggers per run. The catastrophic gate comes first."""
    fired = lambda s: sum(F.col(flag_name(t)).cast("int") for t, severity in TRIGGERS if severity == s)
    any_fired = F.greatest(*[F.col(flag_name(t)).cast("int") for t, _ in TRIGGERS]) > 0
    catastrophic = F.coalesce(F.col("cv_mean") < CATASTROPHIC_CV_FLOOR, F.lit(False)) | F.col(flag_name("LEAKAGE_DETECTED"))
    severity = (
        F.when(catastrophic, "CRITICAL").when(~any_fired, "NONE").when(fired("CRITICAL") > 0, "CRITICAL")
        .when(fired("HIGH") > 0, "HIGH").when(fired("MEDIUM") >= 2, "MEDIUM").when(fired("LOW") >= 3, "LOW")
        .otherwise("MILD")
    )
    names = F.array_compact(F.array(*[F.when(F.col(flag_name(t)), F.lit(t)) for t, _ in TRIGGERS]))
    out = detected.withColumn("severity", severity).withColumn("fired_triggers", names)
    return out.withColumn("should_retrain", ~F.col("severity").isin("NONE", "MILD"))


def alerts_long(detected: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Full report: one row per run and detector."""
    value = {
        "PERFORMANCE_DROP": "cv_drop", "HIGH_VARIANCE": "variance_reference", "OVERFIT_STREAK": "overfit_streak",
        "DATA_VOLUME_SHIFT": "volume_shift_pct", "MISSING_RATE_SPIKE": "missing_spike_pp", "CONFIDENCE_LOW": "low_streak",
        "TIME_ELAPSED": "days_since_retrain",
    }
    entries = [
        F.struct(
            F.lit(t).alias("trigger"), F.lit(s).alias("severity"), F.col(flag_name(t)).alias("fired"),
            (F.col(value[t]).cast("double") if t in value else F.lit(None).cast("double")).alias("value"),
        )
        for t, s in TRIGGERS
    ]
    return detected.select(*[col(k) for k in keys], F.explode(F.array(*entries)).alias("a")).select(
        *[col(k) for k in keys], "a.trigger", "a.severity", "a.fired", "a.value"
    )


def alert_vectors(
    runs: DataFrame, retrains: DataFrame, by: Sequence[str] = ("filename", "target"), time: str = "ts", tie: str = "run_id",
    chunk: int = h.CHUNK,
) -> DataFrame:
    """14 coarse alert features per run; the label tells whether the next run of the group is a retrain."""
    out = h.chunked(runs, by, time, [tie], 1, chunk)
    # The next row of the last row of a chunk lies in the next chunk, where the row is context.
    w = Window.partitionBy(*[col(b) for b in by], "_chunk").orderBy("row_index")
    nxt = out.withColumn("_next", F.lead(col(time)).over(w))
    best = nxt.groupBy(*[col(b) for b in by], "row_index").agg(F.max("_next").alias("_next"))
    rows = null_safe_join(out.filter(~F.col("_extra")), best, [*by, "row_index"])
    times = retrains.select(*[col(b) for b in by], col(time).alias("_next")).distinct().withColumn("_hit", F.lit(1.0))
    rows = null_safe_join(rows, times.filter("_next is not null"), [*by, "_next"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    cv, std = F.coalesce(col("cv_mean"), F.lit(0.5)), F.coalesce(col("cv_std"), F.lit(0.05))
    leak, over = flag(col("leakage_detected")), flag(col("overfitting"))
    drop, wide, low = flag(cv < 0.70), flag(std > 0.08), flag(col("confidence_label") == "Low")
    zero = F.lit(0.0)
    vector = [leak, drop, zero, wide, over, zero, zero, low, zero, zero, leak + drop + wide + over + low, leak, drop, wide + over + low]
    return rows.select(
        *[col(b) for b in by], col(tie), *[v.alias(f"a{i}") for i, v in enumerate(vector)],
        F.coalesce("_hit", F.lit(0.0)).alias("label"),
    )


class RetrainScorer:
    """Boosted trees over alert vectors; needs 25 runs, 3 retrains and 5 other runs."""

    FEATURES = [f"a{i}" for i in range(14)]
    FLOOR = 0.55

    def __init__(self, model=None):
        self.model = model

    @classmethod
    def fit(cls, vectors: DataFrame) -> RetrainScorer:
        got = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).first()
        if got["n"] < 25 or (got["y"] or 0) < 3 or got["n"] - got["y"] < 5:
            return cls()
        staged = VectorAssembler(inputCols=cls.FEATURES, outputCol="features").transform(vectors)
        return cls(GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, minInstancesPerNode=2, seed=42).fit(staged))

    def transform(self, vectors: DataFrame) -> DataFrame:
        """p_retrain and the verdict, NULL where the model is absent or unsure."""
        if self.model is None:
            return vectors.withColumn("p_retrain", F.lit(None).cast("double")).withColumn("verdict", F.lit(None).cast("boolean"))
        staged = VectorAssembler(inputCols=self.FEATURES, outputCol="features").transform(vectors)
        p = vector_to_array(F.col("probability"))[1]
        out = self.model.transform(staged).withColumn("p_retrain", p)
        sure = F.greatest(F.col("p_retrain"), 1 - F.col("p_retrain")) >= self.FLOOR
        return out.withColumn("verdict", F.when(sure, F.col("p_retrain") >= self.FLOOR)).drop(
            "features", "rawPrediction", "probability", "prediction"
        )


def psi(baseline: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per column between two tables, equal-width bins over the joint range."""
    names = list(columns)
    both = baseline.select(*[col(c) for c in names], F.lit("b").alias("_side")).unionByName(
        current.select(*[col(c) for c in names], F.lit("c").alias("_side"))
    )
    ranges = _ranges(both, names)
    flat = both.agg(*[(F.min(col(c)) == F.max(col(c))).alias(f"f{i}") for i, c in enumerate(names)]).first()
    names = [c for i, c in enumerate(names) if c in ranges and not flat[f"f{i}"]]
    schema = "column string, psi double"
    if not names:
        return baseline.sparkSession.createDataFrame([], schema)
    binned = F.coalesce(*[F.when(F.col("column") == c, bin_number(F.col("value"), *ranges[c], bins)) for c in names])
    counted = (
        long_numbers(both, names, keep=["_side"]).filter("value is not null")
        .groupBy("column", binned.alias("bin"))
        .agg(F.count_if(F.col("_side") == "b").alias("b"), F.count_if(F.col("_side") == "c").alias("c"))
    )
    spine = counted.select("column").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    filled = spine.join(counted, ["column", "bin"], "left").fillna(0, ["b", "c"])
    w = Window.partitionBy("column")  # a fixed number of bins per column
    pb = (F.col("b") + 1e-6) / F.greatest(F.sum("b").over(w), F.lit(1))
    pc = (F.col("c") + 1e-6) / F.greatest(F.sum("c").over(w), F.lit(1))
    return filled.select("column", ((pc - pb) * F.log(pc / pb)).alias("t")).groupBy("column").agg(F.abs(F.sum("t")).alias("psi"))


def drift_summary(scores: DataFrame, epistemic: float = 0.0) -> DataFrame:
    """Mean index over the columns, weighted by uncertainty, with its band."""
    raw = F.coalesce(F.avg("psi"), F.lit(0.0))
    return scores.agg(raw.alias("raw")).select(
        F.round(F.least(F.lit(1.0), F.col("raw") * (1.0 + epistemic)), 5).alias("drift_score"),
        (F.col("raw") > 0.10).alias("is_drifting"),
        F.when(F.col("raw") > 0.25, "significant").when(F.col("raw") > 0.10, "moderate").otherwise("none").alias("severity"),
    )


def run_drift(runs: DataFrame, columns: Sequence[str], time: str = "ts", tie: str = "run_id", first: int = 20, last: int = 10) -> DataFrame:
    """Index between the first 20 and the last 10 runs; empty with fewer than 30 runs."""
    oldest = runs.orderBy(col(time), col(tie)).limit(first)
    newest = runs.orderBy(F.desc(time), F.desc(tie)).limit(last)
    enough = runs.limit(first + last).count() >= first + last
    scores = psi(oldest, newest, columns)
    return scores if enough else scores.limit(0)
