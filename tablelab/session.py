"""Session helpers."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task keeps in memory while a forest grows.
TASK_ROWS = 1_000_000
#: Rows for which a task of a pass is worth its start.
PASS_ROWS = 20_000


def local_session(cores: str = "8", app_name: str = "tablelab", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables and stream state.

    It lies below ``spark.checkpoint.dir``, the folder all executors share. Where that isn't set, a session whose
    executors are all in this process gets a folder of its own, once; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the table once to the shared folder and go on from there with a short plan.

    Unlike an in-memory copy it survives the loss of executors, and later passes read only the
    columns they need.
    """
    path = shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dealt(df: DataFrame, rows: int, key: Sequence[str], most: int = TASK_ROWS) -> DataFrame:
    """The table in parts of about ``most`` rows at the most, dealt out by a hash of the key if it has fewer parts.

    Stored tables are far smaller than what a model keeps of their rows in memory, so a part of a file can hold too many.
    """
    parts = math.ceil(rows / most)
    return df.repartition(parts, *[F.col(f"`{k}`") for k in key]) if df.rdd.getNumPartitions() < parts else df


def gathered(df: DataFrame, rows: int, least: int = PASS_ROWS) -> DataFrame:
    """The table in parts of at least about ``least`` rows, for models that pass over it hundreds of times.

    Every pass starts all tasks of a table, which takes longer than a few rows do. Parts are put together, never divided.
    """
    return df.coalesce(max(math.ceil(rows / least), 1))


def discard(df: DataFrame) -> None:
    """Remove a table that ``checkpointed`` wrote and that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path is not None:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session.sparkContext().hadoopConfiguration()).delete(at, True)
