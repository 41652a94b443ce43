"""Streaming queries: each reads a given table as a stream and returns what its sink holds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from queries.base import query, rounded
from queries.monitoring import EXP_SQL
from tablelab.session import shared_folder
from tablelab.streaming import jobs


def _events(t):
    stream = jobs.read_table_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _experiences(t):
    v = F.col("value") / 60
    return _events(t).select(
        "event_id", "ts", F.when(v > 1, 1.0).otherwise(F.round(v, 6)).alias("reward"),
        F.concat(F.lit("b"), F.col("user_id") % 11).alias("bucket"), F.col("event_type").alias("action"),
    )


@query("st1_ingest_unique", "SELECT DISTINCT user_id, event_type FROM events")
def st1(t):
    folder = shared_folder(t.spark)
    doubled = _events(t).select("ts", "user_id", "event_type")
    unique = jobs.unique_records(doubled, ["user_id", "event_type"], delay="60 days")
    jobs.ingest(unique, f"{folder}/log", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/log").select("user_id", "event_type")


@query("st2_action_values", f"SELECT bucket, agent AS action, count(*)::BIGINT AS trials, round(avg(reward), 4) AS avg_reward, round(coalesce(var_samp(reward), 0), 4) AS variance FROM ({EXP_SQL}) GROUP BY 1, 2")
def st2(t):
    folder = shared_folder(t.spark)
    jobs.keep_changes(jobs.action_values(_experiences(t)), f"{folder}/out", f"{folder}/state").awaitTermination()
    return rounded(jobs.current(t.spark, f"{folder}/out", ["bucket", "action"]))


@query("st3_drift_monitor", """WITH b AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-16'), r AS (SELECT min(value) AS lo, max(value) AS hi FROM b),
  h AS (SELECT greatest(0, least(floor((value - lo) / ((hi - lo) / 10)), 9)) AS bin, count(*) AS n FROM events, r GROUP BY 1), g AS (SELECT greatest(0, least(floor((value - lo) / ((hi - lo) / 10)), 9)) AS bin, count(*) AS b FROM b, r GROUP BY 1),
  s AS (SELECT (coalesce(b, 0) + 1e-6) / (SELECT count(*) FROM b) AS pb, (coalesce(n, 0) + 1e-6) / (SELECT count(*) FROM events) AS pn FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN h USING (bin) LEFT JOIN g USING (bin))
  SELECT 'value' AS "column", round(abs(sum((pn - pb) * ln(pn / pb))), 4) AS psi FROM s""")
def st3(t):
    folder = shared_folder(t.spark)
    early = t.events.filter(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    monitor = jobs.DriftMonitor.fit(early, ["value"])
    jobs.keep_latest(monitor.counts(_events(t)), f"{folder}/out", f"{folder}/state", monitor.index).awaitTermination()
    return rounded(jobs.latest(t.spark, f"{folder}/out"))


@query("st4_time_buckets", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS start, event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def st4(t):
    folder = shared_folder(t.spark)
    buckets = jobs.time_buckets(_events(t), "ts", "value", by=["event_type"])
    jobs.keep_changes(buckets, f"{folder}/out", f"{folder}/state").awaitTermination()
    out = jobs.current(t.spark, f"{folder}/out", ["start", "event_type"])
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")))


@query("st5_stream_scoring", "SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 2) AS prediction FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)")
def st5(t):
    folder = shared_folder(t.spark)
    stages = [VectorAssembler(inputCols=["l_quantity"], outputCol="features"), LinearRegression(labelCol="l_extendedprice", solver="normal")]
    model = Pipeline(stages=stages).fit(t.lineitem)
    stream = jobs.read_table_stream(t.spark, t.folder, t.lineitem.schema, "lineitem.parquet")
    scored = jobs.score_stream(stream, model, ["l_orderkey", "l_linenumber", "prediction"])
    jobs.ingest(scored, f"{folder}/out", f"{folder}/state").awaitTermination()
    return rounded(t.spark.read.parquet(f"{folder}/out"), 2)
