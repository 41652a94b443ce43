"""Alert reports with learned and overridden limits, and the history of retrain events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.functions.columns import col
from tablelab.functions.fixed_values import DRIFT_LIMITS
from tablelab.operators import drift
from tablelab.operators.ledger import learned_thresholds
from tablelab.sources.writers import append_rows, read_rows


def limits_of(runs: DataFrame, retrained: str | None = None, config: dict[str, float] | None = None) -> dict[str, float]:
    """The fixed limits, replaced by learned ones where there are enough retrains, and these by the caller's."""
    learned = learned_thresholds(runs.withColumn("label", col(retrained))) if retrained else {}
    return {**DRIFT_LIMITS, **learned, **(config or {})}


def alert_report(
    runs: DataFrame, by: Sequence[str] = ("filename", "target"), time: str = "ts", tie: str = "run_id", retrained: str | None = None,
    config: dict[str, float] | None = None,
) -> DataFrame:
    """One row per run and detector under the limits that hold for the table."""
    return drift.alerts_long(drift.detect(runs, by, time, tie, limits_of(runs, retrained, config), retrained), [tie])


def append_retrain_events(decisions: DataFrame, path: str, keys: Sequence[str] = ("filename", "target"), time: str = "ts", tie: str = "run_id") -> None:
    """Append the runs after which a retrain is due to the history of retrain events."""
    events = decisions.filter("should_retrain").select(*[col(k) for k in keys], col(time), col(tie), "severity", "fired_triggers")
    append_rows(events, path)


def retrain_events(spark: SparkSession, path: str) -> DataFrame:
    """The history; an event appended twice counts once."""
    return read_rows(spark, path).distinct()


def last_retrains(events: DataFrame, keys: Sequence[str] = ("filename", "target"), time: str = "ts") -> DataFrame:
    return events.groupBy(*[col(k) for k in keys]).agg(F.max(col(time)).alias("last_retrain"))
