import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelab.operators import dashboard as dash
from tablelab.operators import eda, ranks
from tablelab.operators.moments import pair_correlations


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]), "x": rng.lognormal(0, 1, n).round(3), "y": rng.integers(0, 40, n).astype(float)})
    pdf.loc[::11, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df.cache()


def test_summary(numbers):
    pdf, df = numbers
    row = {r["column"]: r for r in eda.numeric_summary(df, ["x", "y"]).collect()}["x"]
    want = pdf["x"].describe()
    assert row["count"] == want["count"] and row["missing"] == pdf["x"].isna().sum()
    for ours, theirs in (("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert abs(row[ours] - want[theirs]) < 1e-9


@pytest.mark.parametrize("small", [ranks.SMALL_COLUMN, 0])
def test_sketched_quantiles_are_exact(numbers, monkeypatch, small):
    pdf, df = numbers
    monkeypatch.setattr(ranks, "SMALL_COLUMN", small)
    probs = [0.25, 0.5, 0.9]
    if small == 0:
        monkeypatch.setattr(ranks, "SKETCH_ACCURACY", 200)
    got = ranks.column_quantiles(df, ["x", "y"], probs, exact_rows=0)
    for c in ("x", "y"):
        assert np.allclose(got[c], pdf[c].dropna().quantile(probs))
    grouped = ranks.grouped_quantiles(df.filter("g = 'a'") if small == 0 else df, ["g"], "x", probs, ["a", "b", "c"], exact_rows=0)
    for r in grouped.collect():
        assert np.allclose(list(r)[1:], pdf[pdf.g == r["g"]]["x"].dropna().quantile(probs))


def test_sliced_totals_and_indexes(numbers):
    _, df = numbers
    counts = df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    a = sorted(ranks.running_totals(counts, "y", ["n"]).collect())
    b = sorted(ranks.running_totals(counts, "y", ["n"], rows_per_slice=5).collect())
    assert a == b
    keyed = df.withColumn("k", F.monotonically_increasing_id()).cache()
    keyed.count()
    a = sorted(ranks.ordered_index(keyed, "y", ["k"], ["g"]).select("k", "row_index").collect())
    b = sorted(ranks.ordered_index(keyed, "y", ["k"], ["g"], rows_per_slice=100).select("k", "row_index").collect())
    assert a == b
    a = sorted(ranks.hash_rank(keyed, ["k"], 1, ["g"]).select("k", "hash_rank").collect())
    b = sorted(ranks.hash_rank(keyed, ["k"], 1, ["g"], rows_per_slice=50).select("k", "hash_rank").collect())
    assert a == b


def test_correlations(numbers):
    pdf, df = numbers
    want = pdf["x"].corr(pdf["y"])
    assert abs(eda.correlation_pairs(df, ["x", "y"]).first()["correlation"] - want) < 1e-9
    assert abs(pair_correlations(df, ["x", "y"]).first()["correlation"] - want) < 1e-9
    spearman = eda.correlation_pairs(df, ["x", "y"], "spearman").first()["correlation"]
    both = pdf.dropna()
    assert abs(spearman - both["x"].rank().corr(both["y"].rank())) < 1e-9


@pytest.mark.parametrize("per_slice", [1_000_000, 20])
def test_kendall_against_brute_force(spark, per_slice):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 60), rng.integers(0, 9, 60)
    c = d = tx = ty = 0
    for i, j in itertools.combinations(range(60), 2):
        s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        c, d = c + (s > 0), d + (s < 0)
        tx, ty = tx + (x[i] == x[j]), ty + (y[i] == y[j])
    pairs = 60 * 59 / 2
    want = (c - d) / np.sqrt((pairs - tx) * (pairs - ty))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    row = eda.kendall(df, "x", "y", rows_per_slice=per_slice).first()
    assert (row["concordant"], row["discordant"]) == (c, d) and abs(row["correlation"] - want) < 1e-12


def test_constant_column_and_methods(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "x long, c long")
    assert eda.correlation_pairs(df).first()["correlation"] is None
    assert eda.correlation_matrix(df.select("x")).count() == 0
    with pytest.raises(ValueError):
        eda.eda_report(df, method="magic")
    with pytest.raises(TypeError):
        eda.eda_report("no table")


def test_histogram_edges(spark):
    df = spark.range(100).select(F.col("id").alias("v"))
    rows = sorted(eda.histogram(df, ["v"], 10).collect(), key=lambda r: r["bin"])
    assert [r["n"] for r in rows] == [10] * 10 and rows[0]["lower"] == 0 and rows[-1]["upper"] == 99
    none = spark.createDataFrame([(None,), (None,)], "x double")
    assert eda.histogram(none, ["x"]).count() == 0
    one = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert sum(r["n"] for r in eda.histogram(one, ["x"]).collect()) == 2


def test_report_sections(spark):
    rows = [(25, 50.0, "a"), (30, 60.0, "b"), (41, 55.0, "a")]
    df = spark.createDataFrame(rows, "age long, salary double, dept string")
    full = eda.eda_report(df)
    assert {"shape", "columns", "numeric", "categorical", "correlation", "histogram", "top_values"} <= set(full)
    assert tuple(full["shape"].first()) == (3, 3)
    assert set(eda.eda_report(df, summary=False, correlation=False, distribution=False)) == {"shape", "columns"}
    top = full["categorical"].first()
    assert (top["top"], top["freq"], top["unique"]) == ("a", 2, 2)


def test_density_integrates_to_one(numbers):
    _, df = numbers
    rows = sorted((r["x"], r["density"]) for r in dash.density(df, "y").collect())
    x, d = np.array(rows).T
    assert 0.85 < np.trapezoid(d, x) < 1.0


def test_empty_months_are_kept(spark):
    df = spark.createDataFrame([("2024-01-10", 1.0), ("2024-03-10", 3.0)], "d string, v double").withColumn("d", F.to_timestamp("d"))
    rows = sorted(tuple(r) for r in dash.time_means(df, "d", ["v"]).select("avg_v", "n").collect() if r["n"] is not None and r["avg_v"] is not None)
    assert rows == [(1.0, 1), (3.0, 1)] and dash.time_counts(df, "d").filter("n = 0").count() == 1


def test_row_numbers_of_many_small_slices_are_dealt_to_few_ranges(spark, monkeypatch):
    kept, ranges = ranks.checkpointed, []

    def counted(df):
        out = kept(df)
        ranges.append(out.select("_slice").distinct().count())
        return out

    monkeypatch.setattr(ranks, "checkpointed", counted)
    d = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("y"))
    got = {r["id"]: r["row_index"] for r in ranks.ordered_index(d, "y", ["id"], ["g"], rows_per_slice=2).collect()}
    want = {}
    for g in range(3):
        for at, i in enumerate(sorted((i for i in range(1000) if i % 3 == g), key=lambda i: (i * 7 % 11, i)), 1):
            want[i] = at
    assert got == want and ranges[0] <= 256
