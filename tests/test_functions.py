import random
import statistics
import struct
from datetime import datetime

import pytest
from conftest import column
from pyspark.sql import functions as F

from tallyhouse.functions import dates, display, measures, ranks, text


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def apply(spark, values, expression):
    return column(texts(spark, *values).orderBy("i").select(expression(F.col("t"))))


def test_clean_trims_all_white_space_and_drops_missing_words(spark):
    values = ["  a b\t", "", "   ", "nan", " None ", "NaN", " x\n", None]
    assert apply(spark, values, text.clean) == ["a b", None, None, None, None, "NaN", "x", None]


@pytest.mark.parametrize("value", [
    "t-shirt  don't", "T-SHIRT", "3d printer", "o'NEIL & sons", "café noir", "a", "x2y z",
    "ÉCOLE", "plain words here", "tab\there"])
def test_title_matches_python(spark, value):
    assert apply(spark, [value], text.title) == [value.title()]


def test_squeeze_then_title(spark):
    assert apply(spark, ["  T-SHIRT  don't "],
                 lambda c: text.title(text.squeeze(c))) == ["T-Shirt Don'T"]


def test_to_number(spark):
    cases = {"($1,234.50)": -1234.5, "$1,234.50": 1234.5, "50%": 50.0, "1e5": 15.0, "1-2": None,
             "1.2.3": None, "-": None, "": None, ".": None, "-.": None, "abc": None, "7": 7.0,
             "(5": 5.0, "-3.5": -3.5, "1.": 1.0}
    assert apply(spark, list(cases), text.to_number) == list(cases.values())


def test_categorize(spark):
    values = ["USB Tablet", "Table mug", None, "steamed", "blue anvil", "Face Wash"]
    assert apply(spark, values, text.categorize) == [
        "Electronics", "Home", "Other", "Grocery", "Other", "Beauty"]


def test_number_after(spark):
    message = "Qty = 3 unit  price: $120.5 hour 7"
    df = texts(spark, message, "price -4 units 2.5", "quantity of 3", "items:5 qty 6",
               "purchase  count 2.5", "purchase count 3.5")
    t = F.col("t")
    rows = df.orderBy("i").select(
        text.number_after(t, ["quantity", "qty", "units", "items"]).alias("q"),
        text.number_after(t, ["price", "unit price"]).alias("p"),
        text.number_after(t, ["purchase count"], as_int=True).alias("n")).collect()
    assert [tuple(r) for r in rows] == [
        (3.0, 120.5, None), (2.5, -4.0, None), (None, None, None), (6.0, None, None),
        (None, None, 2.0), (None, None, 4.0)]


def test_dates(spark):
    cases = {
        "2024-03-05": datetime(2024, 3, 5), "2024-03-05 14:30:10": datetime(2024, 3, 5, 14, 30, 10),
        "3/5/2024": datetime(2024, 3, 5), "25/12/2024": datetime(2024, 12, 25),
        "12/1/2010 8:26": datetime(2010, 12, 1, 8, 26), "2024/3/5": datetime(2024, 3, 5),
        "5-Mar-2024": datetime(2024, 3, 5), "Mar 5, 2024": datetime(2024, 3, 5),
        "20240305": datetime(2024, 3, 5), "2024-13-45": None, "12:30": None, "soon": None,
        "": None, None: None}
    assert apply(spark, list(cases), dates.to_timestamp_any) == list(cases.values())


def test_buckets(spark):
    day = F.to_date(F.lit("2024-02-14"))
    row = spark.range(1).select(*[dates.bucket(day, g).cast("string") for g in "MWD"]).first()
    assert list(row) == ["2024-02-29", "2024-02-18", "2024-02-14"]


def test_pearson_of_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 3.0), (3.0, 5.0, None)],
                               "x double, c double, y double")
    row = df.agg(measures.pearson(F.col("x"), F.col("c")).alias("a"),
                 measures.pearson(F.col("x"), F.col("y")).alias("b")).first()
    assert row["a"] is None and row["b"] == pytest.approx(1.0)


def shapes():
    rng = random.Random(7)
    yield [rng.gauss(0, 100) for _ in range(4001)]
    yield [float(rng.randrange(5)) for _ in range(4000)]
    yield [1.0] * 1999 + [2.0] * 2001
    yield [1.0] * 2000 + [2.0] * 2000
    yield [1.0] * 1500 + [3.0, 4.0, 5.0] + [9.0] * 1501
    yield [10.0 ** rng.uniform(-200, 200) for _ in range(3000)]
    yield [-0.0, 0.0, 5.0]
    yield [2.5]


@pytest.mark.parametrize("values", list(shapes()))
def test_exact_medians(spark, values):
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    assert ranks.exact_medians(df, ["v"])["v"] == statistics.median(values)


def test_median_of_missing_column(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a double, b double")
    assert ranks.exact_medians(df, ["a", "b"]) == {"a": None, "b": 1.0}


def test_grouped_medians_over_blocks(spark):
    rng = random.Random(3)
    # One group holds most of the rows and spans many blocks.
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", rng.gauss(5, 3),
             float(rng.randrange(4))) for _ in range(6000)] + [(None, 1.0, None), ("empty", None, 2.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    expected = {}
    for key in {r[0] for r in rows}:
        a = [r[1] for r in rows if r[0] == key and r[1] is not None]
        b = [r[2] for r in rows if r[0] == key and r[2] is not None]
        expected[key] = (statistics.median(a) if a else None, statistics.median(b) if b else None)
    found = ranks.grouped_medians(df, ["k"], ["a", "b"]).collect()
    assert {r["k"]: (r["a"], r["b"]) for r in found} == expected


def test_sort_keys_are_in_the_order_of_doubles(spark):
    rng = random.Random(7)
    values = [0.0, 1.0, 2.0 ** -1022, 5e-324, 3e-310, 1.7976931348623157e308, float("inf"), 0.1, 1 / 3, 2.0 ** 52 + 1]
    values += [struct.unpack("<d", struct.pack("<q", rng.randrange(0, 0x7FF0 << 48)))[0] for _ in range(2000)]
    values += [2.0 ** e * f for e in range(-1022, 1023, 31) for f in (1, 1 + 2.0 ** -52, 2 - 2.0 ** -52)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", ranks.sort_key(F.col("v") + F.lit(0.0)).alias("k")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(row["v"])))[0]
        assert row["k"] == (-bits if row["v"] < 0 else bits), row["v"]


def test_modes_prefer_the_smallest(spark):
    df = spark.createDataFrame([("b", "x", None), ("a", "x", None), (None, "y", None)],
                               "s string, t string, u string")
    assert ranks.modes(df, ["s", "t", "u"]) == {"s": "a", "t": "x", "u": None}


def test_grouped_modes(spark):
    df = spark.createDataFrame(
        [("p", "b"), ("p", "a"), ("p", None), ("p", None), ("p", None), ("q", None)],
        "k string, c string")
    assert dict(ranks.grouped_modes(df, "k", "c", "Other").collect()) == {"p": "a", "q": "Other"}


@pytest.mark.parametrize("partitions", [1, 7])
def test_number_rows_is_dense(spark, partitions):
    df = spark.range(500).withColumn("x", F.expr("hash(id)")).repartition(partitions)
    rows = ranks.number_rows(df, ["x", "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 501))
    assert [r["x"] for r in rows] == sorted(r["x"] for r in rows)


def test_format_value(spark):
    df = spark.createDataFrame(
        [(1234567.891, 12345, " a\nb ", True), (1200.0, -5, "", False), (None, None, None, None),
         (float("nan"), 0, "x|y", True), (float("inf"), 1, "z", True), (-0.125, 2, "z", True)],
        "d double, n int, s string, b boolean")
    shown = [tuple(r) for r in display.formatted(df).collect()]
    assert shown == [
        ("1,234,567.89", "12,345", "a b", "True"), ("1,200", "-5", "N/A", "False"),
        ("N/A",) * 4, ("N/A", "0", "x\\|y", "True"), ("N/A", "1", "z", "True"),
        ("-0.12", "2", "z", "True")]


def test_format_money_and_ratio(spark):
    df = spark.createDataFrame([(1234.5, 0.12345), (None, None), (-2.0, 12.5)], "m double, r double")
    rows = df.select(display.format_currency(F.col("m")), display.format_ratio(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [
        ("$1,234.50", "12.3%"), ("N/A", "N/A"), ("$-2.00", "1250.0%")]


def test_markdown_table(spark):
    df = spark.createDataFrame([("a|b", 1.5), ("c", 2.0)], "name string, v double").orderBy("name")
    assert display.markdown_table(df, 1) == "| name | v |\n| --- | --- |\n| a\\|b | 1.50 |"
    assert display.markdown_table(df.where("v > 9")) == display.NO_ROWS


def test_medians_of_a_written_table_make_no_copy(spark, monkeypatch):
    rows = [(None if i % 9 == 0 else float(i * 7919 % 10007), float(i % 3), -0.0) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    there = [r[0] for r in rows if r[0] is not None]
    expected = {"a": statistics.median(there), "b": 1.0, "c": 0.0}
    with monkeypatch.context() as patch:
        patch.setattr(ranks, "materialize", lambda *_: pytest.fail("a copy was made"))
        assert ranks.exact_medians(df, ["a", "b", "c"], written=True) == expected
        # Sketches that miss the middle ranks: digits of the values find them.
        patch.setattr(ranks, "materialize", lambda df, label: df)
        patch.setattr(ranks.F, "percentile_approx", lambda *_: ranks.F.array(ranks.F.lit(-2.0), ranks.F.lit(-1.0)))
        assert ranks.exact_medians(df, ["a", "b", "c"]) == expected


def test_election_looks_at_each_text_once(spark, monkeypatch):
    """Counts are of rows, but only distinct texts meet the expressions that tell their shape."""
    rows = [("31/12/2024",)] * 300 + [("01/02/2024",)] * 200 + [("12/31/2024",)] * 100 + [("soon",)] * 50 + [(None,)]
    seen = spark.sparkContext.accumulator(0)

    def shaped(text):
        seen.add(1)
        return "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in text)

    monkeypatch.setattr(dates, "text_shape", F.udf(shaped, "string").asNondeterministic())
    found = dates.elect_formats(spark.createDataFrame(rows, "d string"), ["d"])["d"]
    assert (found.order, found.ambiguous, found.unparsed) == ("day", 200, 50)
    assert seen.value == 4


def test_medians_of_few_values_are_not_counted_apart(spark, monkeypatch):
    """Where both ends of the middle are one value, no row is grouped by value."""
    def never(*args):
        raise AssertionError("rows were grouped")

    monkeypatch.setattr(ranks, "_between", never)
    df = spark.range(1001).select((F.col("id") % 3).alias("a"), F.lit(0).alias("b"),
                                  F.when(F.col("id") % 2 == 0, F.lit(2.5)).alias("c"))
    assert ranks.exact_medians(df, ["a", "b", "c"]) == {"a": 1.0, "b": 0.0, "c": 2.5}
