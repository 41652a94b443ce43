import json
import os

import pytest
from pyspark.sql import functions as F

from tablelab.operators import experience
from tablelab.sources import catalog, readers, writers
from tablelab.streaming import jobs


def test_delimiters_and_dispatch(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    with open(path, "wb") as f:
        f.write(b"a;b;c\n1;x\x00y;2,5\n2;z;3,5\n")
    assert readers.sniff_delimiter(spark, path) == ";"
    df = readers.read_table(spark, path)
    assert df.columns == ["a", "b", "c"] and [r["b"] for r in df.orderBy("a").collect()] == ["xy", "z"]
    assert readers.count_rows(spark, path) == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.docx")
    assert readers.input_size(spark, path).first()["bytes"] == os.path.getsize(path)


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    for kind in ("parquet", "csv", "json"):
        writers.write_table(df, str(tmp_path / kind), kind)
    assert readers.read_csv(spark, str(tmp_path / "csv")).count() == 2
    assert readers.read_json(spark, str(tmp_path / "json"), multi_line=False).count() == 2
    assert readers.read_parquet(spark, str(tmp_path / "parquet")).count() == 2
    writers.append_rows(df, str(tmp_path / "rows"))
    writers.append_rows(df, str(tmp_path / "rows"))
    assert writers.read_rows(spark, str(tmp_path / "rows")).count() == 4


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(5).select(F.col("id").cast("string").alias("run_id"), F.timestamp_seconds(F.col("id") * 90000).alias("ts"), F.lit("a").alias("agent"))
    writers.append_log(experience.make_experiences(df), path)
    writers.append_log(experience.make_experiences(df), path)
    assert sorted(n for n in os.listdir(path) if n.startswith("day="))[0] == "day=1970-01-01"
    back = readers.read_log(spark, path, experience.EXPERIENCES, keep=3)
    assert back.count() == 3 and {r["run_id"] for r in back.collect()} == {"4", "3"}
    writers.compact_log(spark.read.schema(experience.EXPERIENCES).json(path), str(tmp_path / "short"), 2)
    assert spark.read.json(str(tmp_path / "short")).count() == 2


def test_catalog(spark):
    models = spark.createDataFrame([("m1", "a.csv", 0.91), ("m2", "b.csv", None)], "id string, dataset_filename string, accuracy double")
    datasets = spark.createDataFrame([("d1", "a.csv")], "id string, filename string")
    assert {r["id"]: r["dataset_id"] for r in catalog.link_dataset(models, datasets).collect()} == {"m1": "d1", "m2": ""}
    rest, existed = catalog.delete(models, "id", "m1")
    assert existed and rest.count() == 1 and not catalog.delete(models, "id", "zz")[1]
    assert catalog.best_accuracy(models).first()[0] == 91.0


def write_batches(tmp_path, records, name="in"):
    folder = tmp_path / name
    folder.mkdir()
    for i, batch in enumerate(records):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
    return str(folder)


def test_streams_equal_batches(spark, tmp_path):
    records = [
        [{"run_id": f"r{i}", "ts": f"2024-01-01T0{i % 10}:00:00Z", "agent": "a", "action": f"x{i % 2}", "reward": i / 20} for i in range(k, k + 8)]
        for k in (0, 5, 10)
    ]
    folder = write_batches(tmp_path, records)
    stream = jobs.read_log_stream(spark, folder, files_per_batch=1)
    jobs.ingest(jobs.unique_records(stream, delay="2 days"), str(tmp_path / "out"), str(tmp_path / "s1")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == 18 and stored.select("run_id").distinct().count() == 18
    live = stream.withColumn("bucket", F.col("agent"))
    jobs.keep_latest(jobs.action_values(live), str(tmp_path / "v"), str(tmp_path / "s2")).awaitTermination()
    batch = spark.read.schema(experience.EXPERIENCES).json(folder).withColumn("bucket", F.col("agent"))
    near = lambda df: sorted(tuple(r) for r in df.select("action", "trials", F.round("avg_reward", 9), F.round("variance", 9)).collect())
    assert near(jobs.latest(spark, str(tmp_path / "v"))) == near(experience.action_values(batch))


def test_drift_monitor_equals_batch(spark, tmp_path):
    base = spark.range(200).select((F.col("id") % 20).cast("double").alias("v"))
    monitor = jobs.DriftMonitor.fit(base, ["v"])
    assert monitor.index(monitor.counts(base)).first()["psi"] == pytest.approx(0.0)
    path = str(tmp_path / "p")
    base.select((F.col("v") + 9).alias("v")).repartition(3).write.parquet(path)
    stream = jobs.read_table_stream(spark, path, base.schema, files_per_batch=1)
    jobs.keep_latest(monitor.counts(stream), str(tmp_path / "o"), str(tmp_path / "s"), monitor.index).awaitTermination()
    live = jobs.latest(spark, str(tmp_path / "o")).first()["psi"]
    assert live == pytest.approx(monitor.index(monitor.counts(spark.read.parquet(path))).first()["psi"])


def test_time_buckets_over_several_batches(spark, tmp_path):
    """Each file is a batch: only changed buckets are written again, and the newest row of each counts."""
    from tablelab.streaming import jobs

    for day, rows in ((1, [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0)]), (2, [("2024-01-01 00:55:00", 5.0), ("2024-01-01 01:10:00", 7.0)])):
        spark.createDataFrame(rows, "ts string, v double").selectExpr("cast(ts AS timestamp) AS ts", "v").coalesce(1).write.parquet(str(tmp_path / f"in{day}.parquet"))
    stream = spark.readStream.schema("ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*.parquet"))
    jobs.keep_changes(jobs.time_buckets(stream, "ts", "v"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {str(r["start"]): (r["n"], r["mean"]) for r in jobs.current(spark, str(tmp_path / "out"), ["start"]).collect()}
    assert got == {"2024-01-01 00:00:00": (3, 3.0), "2024-01-01 01:00:00": (1, 7.0)}


def test_a_batch_is_computed_once_however_often_it_is_used(spark, tmp_path):
    spark.createDataFrame([(i % 3, 1.0 * i) for i in range(30)], "g int, v double").write.parquet(f"{tmp_path}/in")
    computed = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(n):
        computed.add(1)
        return n

    stream = jobs.read_table_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    groups = stream.groupBy("g").agg(F.count(F.lit(1)).alias("n")).select("g", counted("n").alias("n"))
    shape = lambda d: d.join(d.groupBy().agg(F.sum("n").alias("all")), F.lit(True))
    jobs.keep_latest(groups, f"{tmp_path}/out", f"{tmp_path}/state", shape).awaitTermination()
    assert sorted(tuple(r) for r in jobs.latest(spark, f"{tmp_path}/out").collect()) == [(0, 10, 30), (1, 10, 30), (2, 10, 30)]
    assert computed.value == 3


def test_drift_monitor_of_a_reference_that_does_not_vary(spark):
    for rows in ([], [(1.0,), (1.0,)]):
        monitor = jobs.DriftMonitor.fit(spark.createDataFrame(rows, "v double"), ["v"])
        assert monitor.index(monitor.counts(spark.createDataFrame([(2.0,)], "v double"))).collect() == []
