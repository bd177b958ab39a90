from datetime import datetime

import pytest
from conftest import AS_OF, FOLDER
from pyspark.sql import functions as F

from tallyhouse.operators import cleaning, joins, profiling
from tallyhouse.sources import warehouse


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_derived_measures(spark):
    df = spark.createDataFrame([(2.0, 10.0, None), (2.0, 10.0, 5.0), (None, 1.0, None), (0.0, 3.0, 4.0)],
                               "quantity double, price double, sales double")
    assert [r["sales"] for r in cleaning.derive_sales(df).collect()] == [20.0, 5.0, None, 0.0 + 4.0]
    assert "sales" in cleaning.derive_sales(df.drop("sales")).columns
    prices = cleaning.derive_price(df.drop("price")).collect()
    assert [r["price"] for r in prices] == [None, 2.5, None, None]
    quantities = cleaning.derive_quantity(df.drop("quantity")).collect()
    assert [r["quantity"] for r in quantities] == [None, 0.5, None, pytest.approx(4 / 3)]
    assert cleaning.derive_price(df).columns == df.columns
    assert cleaning.derive_quantity(df.select("quantity", "price")).columns == ["quantity", "price"]


def test_null_negatives_by_profile(spark):
    df = spark.createDataFrame([(-1.0, -2.0, -3.0, -4.0)],
                               "quantity double, price double, discount double, sales double")
    report = cleaning.null_negatives(df).first()
    model = cleaning.null_negatives(df, cleaning.NEGATIVE_IS_MISSING["model"]).first()
    assert tuple(report) == (None, None, None, -4.0) and tuple(model) == (None, None, -3.0, None)


def test_empty_rows_and_copies(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, None), (1, "a")], "a int, b string")
    assert rows(cleaning.drop_empty_rows(df)) == [(1, "a"), (1, None), (1, None)]
    assert rows(cleaning.dedupe(df)) == [(1, "a"), (1, None), (None, None)]
    assert rows(cleaning.count_copies(df).rows) == [(1, "a", 1), (1, None, 2)]


def test_imputation_values(spark):
    df = spark.createDataFrame(
        [(1.0, None, "b", None, datetime(2024, 1, 1)), (2.0, None, "a", None, datetime(2024, 1, 2)),
         (3.0, None, None, None, None), (10.0, None, None, None, None), (None,) * 5],
        "x double, y double, s string, t string, d timestamp")
    assert cleaning.impute_median(df, ["x", "y"]).collect()[4]["x"] == 2.5
    assert cleaning.impute_median(df, ["x", "y"]).collect()[0]["y"] == 0.0
    assert cleaning.impute_mode(df, ["s", "t"]).collect()[4][2:4] == ("a", "Unknown")
    assert cleaning.impute_median_ts(df, ["d"], AS_OF).collect()[4]["d"] == datetime(2024, 1, 1, 12)
    empty = df.withColumn("d", F.lit(None).cast("timestamp"))
    assert cleaning.impute_median_ts(empty, ["d"], AS_OF).first()["d"] == AS_OF


def test_time_features_and_clip(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 2, 15, 4), 0.2), (None, None)],
                               "date timestamp, quantity double")
    first, second = cleaning.time_features(df).collect()
    assert tuple(first)[2:] == (3, 5, 15, 1) and tuple(second)[2:] == (None, None, None, 0)
    assert [r["quantity"] for r in cleaning.clip_lower(df).collect()] == [1.0, None]


@pytest.mark.parametrize("hot", [None, [], [1, 2]])
def test_purchase_counts_with_hot_and_missing_customers(spark, hot):
    data = [(1, i) for i in range(300)] + [(2, i) for i in range(50)] + [(3, 0), (None, 1), (None, 2)]
    df = spark.createDataFrame(data, "customer_id int, line int").repartition(6)
    counted = cleaning.customer_purchase_count(df, hot)
    assert counted.count() == len(data)
    found = {r["customer_id"]: r["customer_purchase_count"] for r in counted.collect()}
    assert found == {1: 300, 2: 50, 3: 1, None: None}


def test_hot_keys_are_those_with_a_large_share(spark):
    df = spark.range(10_000).withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    assert joins.hot_keys(df, "k") == [-1]
    assert joins.hot_keys(df.where("id < 0"), "k") == []


def test_salted_join_spreads_a_hot_key(spark):
    df = spark.range(20_000).withColumn("k", F.when(F.col("id") >= 0, 7)).repartition(8)
    per_key = spark.createDataFrame([(7, "x"), (8, "y")], "k int, v string")
    # Small partitions would be merged again at this size.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.attach(df, per_key.hint("merge"), "k", [7])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 10_000


def test_defaults_for_absent_columns(spark):
    df = spark.createDataFrame([("Lamp", 3.0), ("Desk", 4.0)], "product string, sales double")
    row = cleaning.fill_role_defaults(df, AS_OF).where("product = 'Lamp'").first().asDict()
    assert row == {"product": "Lamp", "sales": 3.0, "date": AS_OF, "quantity": 1.0, "price": 1.0,
                   "region": "Unknown", "category": "Lamp"}
    model = cleaning.fill_role_defaults(df.withColumn("country", F.lit("X")), AS_OF, "model")
    found = {r["product"]: r.asDict() for r in model.collect()}
    assert found["Lamp"]["region"] == "X" and found["Lamp"]["customer_id"] == "Unknown"
    assert {r["order_id"] for r in found.values()} == {1, 2}


def test_model_frame_of_a_bare_table(spark):
    df = spark.createDataFrame([(" Lamp ", "2.0", None)], "`Product` string, `Quantity` string, `Category` string")
    row = cleaning.model_frame(df, AS_OF).first().asDict()
    assert row["quantity"] == 2.0 and row["price"] == 1.0 and row["sales"] == 2.0
    assert row["category"] == "Other" and row["customer_purchase_count"] == 1.0
    assert row["month"] == 1 and row["day_of_week"] == 0 and row["hour"] == 0


def test_prepare_fills_columns_of_any_type(spark):
    df = spark.sql("""select * from values
        (1.0D, date'2024-01-05', timestamp_ntz'2024-01-05 10:00:00', true, 3, 1.5BD),
        (2.0D, null, null, null, null, null) as t(sales, order_date, shipped, gift, boxes, weight)""")
    row = cleaning.prepare(df, AS_OF).cleaned.where("sales = 2.0").first()
    assert (row["date"], row["shipped"]) == (datetime(2024, 1, 5), datetime(2024, 1, 5, 10))
    assert (row["gift"], row["boxes"], row["weight"]) == (True, 3.0, 1.5)


def test_prepare_needs_sales(spark):
    with pytest.raises(ValueError, match="sales"):
        cleaning.prepare(spark.createDataFrame([("a",)], "region string"), AS_OF)


def test_prepare_raw_text_table(spark):
    df = spark.createDataFrame(
        [("o1", " c1 ", "2024-01-05", " small  LAMP ", "$1,200.00", "2"),
         ("o1", "c1", "2024-01-05", "Small Lamp", "1200", "2"),
         ("o2", None, "bad", "nan", "(5)", "4"), (None, "", " ", "None", "", "")],
        "OrderNumber string, Customer string, OrderDate string, Item string, UnitPrice string, Qty string")
    prepared = cleaning.prepare(df, AS_OF)
    found = sorted((r.asDict() for r in prepared.cleaned.collect()), key=lambda r: r["order_id"])
    assert [r["sales"] for r in found] == [2400.0, -20.0]
    assert found[1]["product"] == "Small Lamp" and found[1]["price"] == 1200.0
    assert found[1]["customer_id"] is None and found[1]["date"] == datetime(2024, 1, 5)
    quality = {r["metric"]: r["value"] for r in profiling.quality_summary(prepared).collect()}
    assert quality["rows_before"] == 4 and quality["rows_after"] == 2
    assert quality["duplicates_removed"] == 1 and quality["duplicates_before"] == 0
    with_ids = cleaning.prepare(df, AS_OF, impute_ids=True).cleaned
    assert with_ids.where("customer_id is null").count() == 0


def test_clean_is_idempotent_and_complete(dirty):
    once = cleaning.prepare(dirty, AS_OF).cleaned
    again = cleaning.prepare(once, AS_OF).cleaned
    assert rows(once) == rows(again)
    gaps = profiling.missing_columns(once).collect()
    assert {r["column"] for r in gaps} <= set(cleaning.IDS)


def test_clean_does_not_depend_on_partitions(dirty):
    assert rows(cleaning.prepare(dirty.repartition(3), AS_OF).cleaned) == rows(
        cleaning.prepare(dirty.coalesce(1), AS_OF).cleaned)


def test_model_profile(spark):
    frame = cleaning.prepare_for_model(warehouse.retail_dirty(spark, FOLDER), AS_OF)
    assert frame.where("quantity <= 0 or price <= 0").count() == 0
    assert frame.where("sales is null or category is null or month is null").count() == 0


def test_model_profile_without_ids_finds_duplicates(spark):
    df = spark.createDataFrame([("Lamp", 2.0, 3.0)] * 3 + [("Desk", 1.0, 4.0)],
                               "description string, quantity double, unit_price double")
    frame = cleaning.prepare_for_model(df, AS_OF)
    assert sorted(r["order_id"] for r in frame.collect()) == [1, 2]
    assert {r["product"]: r["category"] for r in frame.collect()} == {"Lamp": "Home", "Desk": "Office"}


def test_profile(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, None), (1.0, "a")], "x double, s string")
    found = [tuple(r) for r in profiling.column_profile(df).collect()]
    assert found == [("s", "string", 1, 1), ("x", "double", 0, 2)]
    assert profiling.column_profile(df, approx=True).count() == 2
    assert profiling.duplicate_rows(df.drop("x")).first()[0] == 1
