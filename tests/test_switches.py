"""Both sides of every size switch, missing cells of each kind, date orders, readers."""

import math

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import dates, ranks
from tallyhouse.operators import cleaning, distributions, modeling, profiling, requests
from tallyhouse.session import materialize, released
from tallyhouse.sources import files, synthetic

NAN = float("nan")


@pytest.mark.parametrize("case_terms", [0, 100])
def test_terms_by_text_whatever_the_ids(spark, case_terms):
    rows = [("m1", "about laptop"), ("m1", "about desk"), (None, "about lamp"), (None, "about lamp"),
            ("m2", None), ("m1", "ABOUT Laptop"), ("m3", "")]
    messages = spark.createDataFrame(rows, "msg_id string, text string")
    vocab = spark.createDataFrame([("Laptop",), ("Lap",), ("Desk",), ("Lamp",), ("LAMP",)], "term string")
    want = ["Laptop", "Desk", "LAMP", "LAMP", None, "Laptop", None]

    def key(r):
        return tuple((v is None, v or "") for v in r)

    expected = sorted(((*r, w) for r, w in zip(rows, want)), key=key)
    for found in (requests.match_terms(messages, vocab, "term", case_terms),
                  requests.match_known(messages, {"product": vocab}, case_terms).select(
                      "msg_id", "text", F.col("product").alias("term"))):
        assert sorted((tuple(r) for r in found.collect()), key=key) == expected


def test_grouped_medians_keep_every_group(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None), ("c", 5.0), (None, 7.0), (None, NAN),
            ("d", NAN), ("a", NAN), ("e", 2.0), ("e", 2.0), ("e", 3.0), ("e", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["v"] for r in ranks.grouped_medians(df, ["g"], ["v"]).collect()}
    assert got == {"a": 2.0, "b": None, "c": 5.0, None: 7.0, "d": None, "e": 2.5}


def test_medians_with_ties_and_gaps(spark):
    df = spark.createDataFrame([(v, None) for v in (1.0, 1.0, 1.0, 2.0, NAN, None, 5.0, 5.0)],
                               "v double, w double")
    assert ranks.exact_medians(df, ["v", "w"]) == {"v": 1.5, "w": None}


SPELLINGS = {
    "January 5, 2024": "2024-01-05 00:00", "Jan 5 2024": "2024-01-05 00:00", "jan 5, 2024": "2024-01-05 00:00",
    "1/5/2024 3:04 PM": "2024-01-05 15:04", "1/5/2024 3:04pm": "2024-01-05 15:04", "5-Jan-24": "2024-01-05 00:00",
    "05-JAN-99": "1999-01-05 00:00", "05/01/24": "2024-05-01 00:00", "12/1/10 8:26": "2010-12-01 08:26",
    "5.1.2024 10:00": "2024-01-05 10:00", "2024/01/05 10:00": "2024-01-05 10:00", "1/2/69": "1969-01-02 00:00",
    "1/2/68": "2068-01-02 00:00"}


def test_spellings_of_dates(spark):
    df = spark.createDataFrame([(t,) for t in SPELLINGS], "date string")
    read = cleaning.parse_dates(df).select(F.date_format("date", "yyyy-MM-dd HH:mm")).collect()
    assert [r[0] for r in read] == list(SPELLINGS.values())


@pytest.mark.parametrize("texts,want,ambiguous", [
    (["13/02/2024", "02/03/2024", None], ["2024-02-13", "2024-03-02", None], 1),
    (["02/13/2024", "02/03/2024", "x"], ["2024-02-13", "2024-02-03", None], 1),
    (["02/03/2024", "4/4/2024"], ["2024-02-03", "2024-04-04"], 1),
    (["31/12/2024 10:00:00", "1/2/2024"], ["2024-12-31", "2024-02-01"], 1)])
def test_one_order_of_month_and_day_per_column(spark, texts, want, ambiguous):
    df = spark.createDataFrame([(t,) for t in texts], "date string")
    read = cleaning.parse_dates(df).select(F.date_format("date", "yyyy-MM-dd")).collect()
    assert [r[0] for r in read] == want
    elected = dates.elect_formats(df, ["date"])["date"]
    assert elected.ambiguous == ambiguous and elected.unparsed == sum(t == "x" for t in texts)


def test_nan_is_missing_everywhere(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "a"), (None, None), (3.0, "b"), (1.0, "a")], "v double, t string")
    profile = {r["column"]: (r["missing"], r["unique_values"]) for r in profiling.column_profile(df).collect()}
    assert profile == {"v": (2, 2), "t": (1, 2)}
    assert {r["column"]: r["missing_values"] for r in profiling.missing_columns(df).collect()} == {"v": 2, "t": 1}
    bars = distributions.histograms(df, ["v"], bins=2).orderBy("bin").collect()
    assert [(r["bin_start"], r["count"]) for r in bars] == [(1.0, 2), (2.0, 1)]
    assert all(not math.isnan(r["bin_end"]) for r in bars)


def test_scatter_without_category(spark):
    df = spark.createDataFrame([(1, "W", 2.0, 9.0)], "order_id int, region string, quantity double, price double")
    assert distributions.scatter_points(df).columns == ["quantity", "price", "region"]


def test_quotes_inside_cells_do_not_join_lines(spark, tmp_path):
    path = tmp_path / "pipes.csv"
    path.write_text('name,size\n5" pipe,1\n"7"" pipe, long",2\n6" pipe,3\n')
    assert not files.probe_text(spark, str(path))["multi_line"]
    assert [tuple(r) for r in files.load_delimited(spark, str(path)).collect()] == [
        ('5" pipe', "1"), ('7" pipe, long', "2"), ('6" pipe', "3")]


def test_what_is_no_table_is_skipped(spark, tmp_path):
    book, binary, lines, good = (tmp_path / n for n in ("book.xlsx", "book.csv", "bad.json", "good.csv"))
    book.write_bytes(b"PK\x03\x04sheet")
    binary.write_bytes(b"PK\x03\x04\x00\x01,\x02\n")
    lines.write_text("no json\n")
    good.write_text("a\n1\n")
    for path in (book, binary, lines):
        with pytest.raises(files.UnreadableSource):
            files.read_any(spark, str(path))
    sources = [(p.name, str(p)) for p in (book, binary, lines, good)]
    assert files.first_available(spark, sources, synthetic.model_table, "made")[1] == "good.csv"


def test_more_categories_than_normal_equations_take(spark):
    train = spark.range(10_000).select(
        (F.col("id") % 7).cast("double").alias("quantity"),
        F.concat(F.lit("c"), F.col("id") % 5000).alias("category"),
        (F.col("id") % 7 * 3 + 1).cast("double").alias("sales"))
    scored = modeling.score(modeling.fit_linear(train), train.limit(50))
    assert scored.where("abs(prediction - sales) > 0.5").count() == 0


def test_forest_does_not_grow_with_the_table(spark):
    train = spark.range(4000).select(F.rand(1).alias("quantity"), F.rand(2).alias("sales"))
    model = modeling.fit_forest(train, trees=2, depth=20, least_share=0.05)
    assert all(t.numNodes <= 2 / 0.05 for t in model.stages[-1].trees)


def test_copies_are_deleted_when_their_block_ends(spark):
    from pathlib import Path

    with released(spark):
        written = materialize(spark.range(5), "test")
        path = Path(written.inputFiles()[0].removeprefix("file:")).parent
        assert path.exists() and written.count() == 5
    assert not path.exists()
    with pytest.raises(RuntimeError), released(spark):
        path = Path(materialize(spark.range(5), "test").inputFiles()[0].removeprefix("file:")).parent
        raise RuntimeError
    assert not path.exists()


def test_few_scans_for_all_tables_of_a_report(spark, fact):
    """Set-up passes and lazy tables together."""
    from tallyhouse.plans import analysis

    tables = analysis.insight_tables(fact)
    source = set(fact.inputFiles())
    reading = [n for n, t in tables.items() if set(t.inputFiles()) & source]
    assert set(reading) <= {"histograms"}, reading
    assert set(analysis.report_tables(tables).inputFiles()).isdisjoint(source)
