import json

import pytest
from pyspark.sql import functions as F

from tablelab.functions import texts
from tablelab.functions.columns import normalize_nulls, to_number, to_time
from tablelab.plans import basic_cleaning as basic
from tablelab.plans.universal_cleaning import UniversalCleaning, part_of


def values(df, c):
    return [r[0] for r in df.select(F.col(f"`{c}`")).collect()]


def test_names_collide():
    assert basic.standard_names(["First Name", "first name", "FIRST NAME"]) == ["first_name", "first_name_2", "first_name_3"]
    assert basic.standard_names([" salary(USD) ", "$$$", "a__b"]) == ["salary_usd", "col", "a_b"]
    assert basic.training_names(["Order  Key ", "a-b!"]) == ["Order_Key", "ab"]


def test_dirty_table(spark):
    rows = [("Ann", 25.0, 100.0, "2020-01-01", "1"), ("Bob", None, 200.0, "2020-02-01", "2"), ("Bob", None, 200.0, "2020-02-01", "2"),
            (None, 30.0, 150.0, "2020-03-01", "3"), ("Eve", 200.0, 120.0, "2020-04-01", "4"), ("Zed", 28.0, 130.0, "2020-05-01", "5")]
    df = spark.createDataFrame(rows, "`First Name` string, ` Age ` double, `salary(USD)` double, joined string, score string")
    out, summary = basic.clean(df)
    assert out.columns == ["first_name", "age", "salary_usd", "joined", "score"]
    assert dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["joined"] == "timestamp"
    assert out.filter("first_name is null or age is null").count() == 0
    assert summary["duplicates_removed"] == 1 and summary["rows_after"] == 5
    assert summary["numeric_filled"] == {"age": 2} and summary["text_filled"] == {"first_name": 1}
    assert out.agg(F.max("age")).first()[0] < 200
    assert df.columns[0] == "First Name"


def test_median_mode_and_guards(spark):
    x = spark.createDataFrame([(1.0,), (None,), (3.0,), (None,), (5.0,)], "x double")
    assert basic.fit_numeric_fill(x) == {"x": 3.0}
    cat = spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("d",)], "cat string")
    assert basic.fit_text_fill(cat) == {"cat": "a"}
    empty = spark.createDataFrame([(None, None)] * 3, "a double, b double")
    assert basic.fit_numeric_fill(empty) == {} and basic.fit_clips(empty) == {}
    none = spark.createDataFrame([("x", None), ("y", None)], "normal string, gone string")
    assert basic.fit_text_fill(none) == {}


def test_clip(spark):
    v = spark.createDataFrame([(i,) for i in [*range(1, 21), 1000]], "v long")
    lo, hi = basic.fit_clips(v)["v"]
    assert (lo, hi) == (-9.0, 31.0)
    assert max(values(basic.apply_clips(v, {"v": [lo, hi]}), "v")) == 31.0
    flat = spark.createDataFrame([(5, i) for i in range(5)], "c long, v long")
    assert "c" not in basic.fit_clips(flat)


def test_numeric_strings_are_converted_before_the_clip(spark):
    s = spark.createDataFrame([("10",), ("11",), ("12",), ("13",), ("1000000",)], "salary string")
    out, summary = basic.clean(s)
    assert summary["types"] == {"salary": "number"} and out.agg(F.max("salary")).first()[0] < 1000000


def test_types(spark):
    df = spark.createDataFrame([("1", "2020-01-01", "1"), ("2", "2020-02-01", "x")], "n string, d string, m string")
    assert basic.fit_types(df) == {"n": "number", "d": "time"}


def test_switches_and_bad_input(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "`X Y` double, s string")
    out, _ = basic.clean(df, standardise=False, fill_numeric=False, duplicates=False, clip_outliers=False)
    assert out.columns == ["X Y", "s"] and out.count() == 3 and out.filter("`X Y` is null").count() == 1
    with pytest.raises(TypeError):
        basic.clean([1, 2])
    none = spark.createDataFrame([], "a double").select()
    assert basic.clean(none)[1]["rows_before"] == 0


def test_plan_replay(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else None) for i in range(30)], "v double, s string")
    plan = basic.BasicCleaning.fit(df)
    again = basic.BasicCleaning.from_dict(json.loads(json.dumps(plan.to_dict())))
    assert sorted(plan.transform(df).collect()) == sorted(again.transform(df).collect())


def test_number_and_time_texts(spark):
    df = spark.createDataFrame([("12",), ("12d",), ("nan",), (" -1.5e3 ",), ("Infinity",), (None,)], "t string")
    assert values(df.select(to_number(F.col("t")).alias("t")), "t") == [12.0, None, None, -1500.0, None, None]
    times = spark.createDataFrame([("03/10/2022",), ("2022-03-10",), ("Mar 5, 2021",), ("soon",)], "t string")
    got = values(times.select(to_time(F.col("t")).cast("string").alias("t")), "t")
    assert got == ["2022-03-10 00:00:00", "2022-03-10 00:00:00", "2021-03-05 00:00:00", None]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert values(normalize_nulls(odd), "v") == [None, None, 1.0]


@pytest.mark.parametrize("text,value", [
    ("two hundred five", 205.0), ("three thousand forty", 3040.0), ("one million two", 1000002.0), ("12", 12.0), ("hundred", 100.0),
    ("twenty 5", 25.0), ("cats", None), ("n/a", None), ("twenty-one", None), ("seven!", 7.0),
])
def test_word_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df.select(texts.word_number(F.col("t")).alias("t")), "t") == [value]


@pytest.mark.parametrize("text,value", [("1.234,56", 1234.56), ("$1,234.50", 1234.5), ("12,50 €", 12.5), ("1'000", 1000.0), ("free", None)])
def test_prices(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df.select(texts.price(F.col("t")).alias("t")), "t") == [value]


@pytest.mark.parametrize("text,value", [("10-20", 15.0), ("<5", 5.0), ("100+", 100.0), ("1,234", 1234.0), ("about", None)])
def test_capped(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert values(df.select(texts.capped(F.col("t")).alias("t")), "t") == [value]


def test_addresses(spark):
    df = spark.createDataFrame([("A@Gmail.com", "http://www.shop.co/x?a=1.2"), ("b@corp.org", "localhost/x"), ("odd", "ftp://a.b.c")], "m string, u string")
    got = df.select(texts.mail_host(F.col("m")), texts.mail_is_free(F.col("m")), texts.web_domain(F.col("u"))).collect()
    assert [tuple(r) for r in got] == [("gmail", 1, "shop"), ("corp", 0, "localhost"), ("unknown", 0, "b")]
    parts = spark.createDataFrame([("a::b::c",), ("plain",)], "s string")
    got = parts.select(part_of(F.col("s"), "::", 0), part_of(F.col("s"), "::", 1)).collect()
    assert [tuple(r) for r in got] == [("a", "b::c"), ("plain", None)]


def test_universal_plan_replays_and_drops(spark):
    rows = [(i, "yes" if i % 2 else "No", f"{i % 7} kg", f"x{i}y", None, "k", 999 if i % 9 == 0 else i % 50) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, flag string, weight string, code string, gone string, same string, age int")
    plan = UniversalCleaning.fit(df, target="id")
    assert plan.report["empty_dropped"] == ["gone"] and plan.report["constant_dropped"] == ["same"]
    assert plan.report["steps"] == {"flag": "binary", "weight": "units", "code": "near_unique"}
    assert plan.report["clamped"] == ["age"]
    out = plan.transform(df)
    again = UniversalCleaning.from_dict(json.loads(json.dumps(plan.to_dict()))).transform(df)
    assert sorted(out.collect()) == sorted(again.collect())
    assert out.columns == ["id", "flag", "weight", "age"]
    assert out.filter("age is null or age > 130").count() == 0
