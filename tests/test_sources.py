import pytest
from pyspark.sql import functions as F

from tallyhouse.session import materialize, new_path, shared_folder, spread
from tallyhouse.sources import files, links, sinks, synthetic


@pytest.mark.parametrize("encoding,text", [
    ("utf-8-sig", "naïve €"), ("utf-8", "naïve €"), ("cp1252", "naïve €"), ("latin1", "na\x81ïve")])
@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_encodings_and_delimiters(spark, tmp_path, encoding, text, sep):
    path = tmp_path / "data.csv"
    lines = [sep.join(["Name", "Qty", "Note"])] + [sep.join(["plain", "1", "x"])] * 300
    lines += [sep.join([text, "NA", ""])]
    path.write_bytes("\n".join(lines).encode(encoding))
    df = files.load_delimited(spark, str(path))
    assert df.columns == ["Name", "Qty", "Note"] and df.count() == 301
    odd = df.where("Name <> 'plain'").first()
    assert tuple(odd) == (text, None, None)


def test_quoted_cells_over_lines(spark, tmp_path):
    path = tmp_path / "data.txt"
    path.write_text('a,b\n"x\ny","say ""hi"""\n1,2\n')
    assert [tuple(r) for r in files.read_any(spark, str(path)).collect()] == [
        ("x\ny", 'say "hi"'), ("1", "2")]
    assert files.probe_text(spark, str(path))["multi_line"]


def test_single_column_and_empty_file(spark, tmp_path):
    one, none = tmp_path / "one.csv", tmp_path / "none.csv"
    one.write_text("value\n1\n2\n")
    none.write_text("")
    assert files.load_delimited(spark, str(one)).count() == 2
    assert files.sniff_delimiter(spark, str(none)) == ","


def test_json_lines_and_arrays(spark, tmp_path):
    lines, array = tmp_path / "a.json", tmp_path / "b.JSON"
    lines.write_text('{"a": 1}\n{"a": 2}\n')
    array.write_text('[{"a": 1},\n {"a": 2}]')
    for path in (lines, array):
        assert sorted(r["a"] for r in files.read_any(spark, str(path)).collect()) == [1, 2]


def test_fallback_order(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("a\n1\n")
    sources = [("missing", str(tmp_path / "a.csv")), ("found", str(path))]
    assert files.first_available(spark, sources, synthetic.model_table, "made")[1] == "found"
    assert files.first_available(spark, sources[:1], synthetic.model_table, "made")[1] == "made"


def test_links(spark):
    html = """<p><!-- <a href="no.csv">x</a> --><script>'<a href="no2.csv">'</script>
      <A class="b" HREF='data/One.CSV'>1</A><a href="/two.json?x=1">no</a><a href="/two.json">2</a>
      <a data-href="no3.csv" id=x>n</a><a href=../up/three.txt>3</a><a href="data/One.CSV">again</a>
      <a href="//cdn.example.org/four.xls">4</a><a href="https://o.example.org/a&amp;b.xlsx">5</a></p>"""
    pages = spark.createDataFrame([(1, "https://example.org/x/y/page.html?q=1#top", html), (2, "u", None)],
                                  "page_id int, url string, html string")
    found = links.discover_links(pages).orderBy("first_pos").collect()
    assert [r["link"] for r in found] == [
        "https://example.org/x/y/data/One.CSV", "https://example.org/two.json",
        "https://example.org/x/up/three.txt", "https://cdn.example.org/four.xls",
        "https://o.example.org/a&b.xlsx"]
    assert links.discover_links(pages, None).count() == 6


@pytest.mark.parametrize("link", [
    "a.csv", "./a.csv", "../a.csv", "../../../a.csv", "/a.csv", "?x=1", "#f", "", "//h/p", "http://z/q",
    "b/../c/./d.txt", "b/..", "mailto:x@y", "/a/../b?u=/../c"])
@pytest.mark.parametrize("base", [
    "http://h.org/p/q/r.html?s=1#t", "http://h.org", "https://h.org/", "http://h.org/p/"])
def test_resolve_url_matches_python(spark, base, link):
    from urllib.parse import urljoin
    found = spark.range(1).select(links.resolve_url(F.lit(base), F.lit(link))).first()[0]
    assert found == urljoin(base, link)


@pytest.mark.parametrize("rows", [7, 1200, 5000])
def test_report_table(spark, rows):
    df = synthetic.report_table(spark, rows)
    unique = df.distinct()
    assert df.count() == rows + round(rows * 0.02) and unique.count() == rows
    gaps = unique.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in unique.columns]).first()
    for name, k in synthetic.GAPS.items():
        assert gaps[name] == max(1, rows // k), name
    padded = unique.where(F.col("region").startswith("  ")).count()
    assert max(1, rows // 20) - max(1, rows // 45) <= padded <= max(1, rows // 20)
    dollars = unique.where(F.col("price").startswith("$")).count()
    assert dollars <= max(1, rows // 25)
    limits = unique.agg(F.min("quantity"), F.max("quantity"), F.min("discount"), F.max("discount"),
                        F.min("date"), F.max("date")).first()
    assert limits[0] >= 1 and limits[1] <= 12 and limits[2] >= 0 and limits[3] < 0.3
    assert str(limits[4]) >= "2024-01-01" and str(limits[5]) <= "2025-12-31 00:00:00"


def test_report_table_distributions(spark):
    df = synthetic.report_table(spark, 40_000)
    mean = df.agg(F.avg("quantity")).first()[0]
    assert mean == pytest.approx(3.5, abs=0.05)
    shares = dict(df.where("region is not null").groupBy(F.upper(F.trim("region"))).count().collect())
    total = sum(shares.values())
    for name, weight in synthetic.REGIONS.items():
        assert shares[name.upper()] / total == pytest.approx(weight, abs=0.01)
    assert df.select("product").distinct().count() == 20
    assert df.select("customer_id").distinct().count() == 600


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    one = synthetic.report_table(spark, 500, seed=3)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        other = synthetic.report_table(spark, 500, seed=3)
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert not one.exceptAll(synthetic.report_table(spark, 500, seed=4)).isEmpty()


def test_model_table(spark):
    df = synthetic.model_table(spark, 1500)
    unique = df.distinct()
    assert (df.count(), unique.count()) == (1530, 1500)
    gaps = unique.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in unique.columns]).first()
    assert [gaps[c] for c in ("quantity", "unit_price", "country", "invoice_date")] == [15] * 4
    assert gaps["sales"] == gaps["customer_id"] == 0


def test_hand_off_and_export(spark):
    df = spark.sql("select timestamp'2024-05-06 07:08:09' as date, 1.5D as sales, 'a, \"b\"' as product")
    kept = sinks.write_clean(df, new_path(spark, "clean"))
    assert kept.first()["date"].hour == 7
    path = new_path(spark, "export")
    sinks.export_csv(df, path)
    again = sinks.read_export(spark, path).first()
    assert again["date"].hour == 0 and again["sales"] == 1.5 and again["product"] == 'a, "b"'


def test_shared_folder_and_spread(spark):
    assert new_path(spark, "x").startswith(shared_folder(spark))
    df = materialize(spark.range(100).coalesce(1), "one")
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide
