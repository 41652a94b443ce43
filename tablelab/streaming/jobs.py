"""Streaming forms of the run log, action values, drift monitor, time buckets and scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablelab.functions.columns import col
from tablelab.operators.counts import long_numbers
from tablelab.operators.eda import bin_number
from tablelab.operators.experience import EXPERIENCES
from tablelab.session import checkpointed, discard


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType = EXPERIENCES, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of an append-only log."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_table_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def unique_records(stream: DataFrame, keys: Sequence[str] = ("run_id", "agent"), time: str = "ts", delay: str = "1 day") -> DataFrame:
    """First record per key; state older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until the available input is read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def action_values(stream: DataFrame) -> DataFrame:
    """Running trials, mean and sample variance of the reward per bucket and action."""
    return stream.groupBy("bucket", "action").agg(
        F.count(F.lit(1)).alias("trials"), F.avg("reward").alias("avg_reward"),
        F.coalesce(F.var_samp("reward"), F.lit(0.0)).alias("variance"),
    )


def keep_latest(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Write the full result of an aggregation with few groups after every batch; the folders of the last two batches stay.

    A batch is computed once, whatever ``shape`` does with it: every computation writes the state of the stream, and two at
    a time write over each other.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = checkpointed(batch)
        shape(once).write.mode("overwrite").parquet(f"{path}/batch={number}")
        discard(once)
        drop_folder(batch.sparkSession, f"{path}/batch={number - 2}")

    return (
        stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Result of the last finished batch."""
    df = spark.read.parquet(path)
    last = df.agg(F.max("batch")).first()[0]
    return df.filter(col("batch") == last).drop("batch")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it lies, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def keep_changes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write only the groups that a batch changed. Groups behind the watermark leave the state for good."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each group that keep_changes has written."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    newest = df.groupBy(*[col(k) for k in keys]).agg(F.max_by(F.struct(*[col(c) for c in rest]), "batch").alias("_row"))
    return newest.select(*[col(k) for k in keys], *[F.col("_row")[c].alias(c) for c in rest])


class DriftMonitor:
    """Bins of a reference table, and the index of a stream against them.

    The state is a counter per column and bin, so every executor adds up its own rows first.
    """

    def __init__(self, edges: dict[str, tuple[float, float]], reference: dict[str, list[int]], bins: int):
        self.edges, self.reference, self.bins = edges, reference, bins

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], bins: int = 10) -> DriftMonitor:
        got = df.agg(
            *[m for i, c in enumerate(columns) for m in (F.min(col(c)).cast("double").alias(f"a{i}"), F.max(col(c)).cast("double").alias(f"z{i}"))]
        ).first()
        edges = {c: (got[f"a{i}"], got[f"z{i}"]) for i, c in enumerate(columns) if got[f"a{i}"] is not None and got[f"a{i}"] < got[f"z{i}"]}
        monitor = cls(edges, {}, bins)
        rows = monitor.counts(df).collect()  # columns x bins
        monitor.reference = {c: [0] * bins for c in edges}
        for r in rows:
            monitor.reference[r["column"]][r["bin"]] = r["n"]
        return monitor

    def counts(self, df: DataFrame) -> DataFrame:
        """Rows per column and bin; values outside the reference range fall into the outer bins."""
        names = list(self.edges)
        if not names:  # nothing that varies: no bins
            none = df.select(F.lit("").alias("column"), F.lit(0).cast("bigint").alias("bin")).filter(F.lit(False))
            return none.groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
        place = F.coalesce(*[
            F.when(F.col("column") == c, F.greatest(bin_number(F.col("value"), lo, hi, self.bins), F.lit(0).cast("bigint")))
            for c, (lo, hi) in self.edges.items()
        ])
        long = long_numbers(df, names).filter("value is not null")
        return long.groupBy("column", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def index(self, counted: DataFrame) -> DataFrame:
        """Stability index per column from counted bins."""
        spark = counted.sparkSession
        rows = [(c, i, n) for c, ns in self.reference.items() for i, n in enumerate(ns)]
        base = spark.createDataFrame(rows, "column string, bin bigint, b bigint")
        both = base.join(counted, ["column", "bin"], "left").fillna(0, ["n"])
        totals = both.groupBy("column").agg(F.sum("b").alias("tb"), F.sum("n").alias("tn"))
        pb = (F.col("b") + 1e-6) / F.greatest("tb", F.lit(1))
        pn = (F.col("n") + 1e-6) / F.greatest("tn", F.lit(1))
        parts = both.join(totals, "column").select("column", ((pn - pb) * F.log(pn / pb)).alias("t"))
        return parts.groupBy("column").agg(F.abs(F.sum("t")).alias("psi"))


def time_buckets(stream: DataFrame, time: str, value: str, width: str = "1 hour", delay: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Count and mean per tumbling window and group; late rows are accepted up to the delay."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("w"), *[col(b) for b in by])
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("start"), *[col(b) for b in by], "n", "mean")
    )


def score_stream(stream: DataFrame, model, columns: Sequence[str]) -> DataFrame:
    """Predictions of a fitted pipeline on a stream."""
    return model.transform(stream).select(*columns)
