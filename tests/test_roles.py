from datetime import datetime

import pytest

from tallyhouse import roles


def test_normalize_name():
    names = {" Order Date ": "order_date", "InvoiceDate": "invoice_date", "UnitPrice": "unit_price",
             "CustomerID": "customer_id", "Total-Sales ($)": "total_sales", "%%": "column",
             "a__b": "a_b", "SKU": "sku"}
    assert {n: roles.normalize_name(n) for n in names} == names


def test_unique_labels_never_collide():
    assert roles.unique_labels(["a", "a", "a_2", "b"]) == ["a", "a_2", "a_2_2", "b"]


def test_public_retail_header_resolves():
    header = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
              "CustomerID", "Country"]
    names = [roles.normalize_name(c) for c in header]
    found = roles.assign_roles(names, roles.MODEL_ALIASES, "exact")
    assert found == {"date": "invoice_date", "sales": None, "quantity": "quantity",
                     "price": "unit_price", "product": "description", "region": "country",
                     "customer_id": "customer_id", "order_id": "invoice_no", "category": None}


@pytest.mark.parametrize("mode,column", [("fuzzy", "country"), ("token", None)])
def test_containment_by_substring_or_word(mode, column):
    assert roles.best_match(["country"], ["quantity", "count"], mode) == column


def test_containment_and_spelling():
    assert roles.best_match(["net_order_date_utc"], ["date", "order_date"]) == "net_order_date_utc"
    assert roles.best_match(["custmer_id", "x"], ["customer_id"]) == "custmer_id"
    assert roles.best_match(["x", "y"], ["customer_id"]) is None
    assert roles.best_match(["qty", "quantity"], ["quantity", "qty"]) == "quantity"


def test_a_column_serves_one_role():
    found = roles.assign_roles(["amount", "item", "order_date", "order"])
    assert found["sales"] == "amount" and found["product"] == "item"
    assert found["date"] == "order_date" and found["order_id"] == "order"


def test_fuzzy_mode_goes_through_the_roles_in_order():
    assert roles.assign_roles(["amount", "item"], mode="fuzzy")["quantity"] == "item"
    assert roles.closeness("unit", "units") == roles.CONTAINMENT_SCORE


def test_resolve_renames_and_keeps_the_rest(spark):
    df = spark.createDataFrame([(1.0, "x", "n")], "`Total Revenue` double, `Item` string, note string")
    resolved, found = roles.resolve_roles(df)
    assert resolved.columns == ["sales", "product", "note"]
    assert found["sales"] == "total_revenue" and found["date"] is None


def test_inferred_date_is_renamed(spark):
    df = spark.createDataFrame([("2024-01-05", 2.0), ("2024-02-05", 3.0)], "when_sold string, sales double")
    resolved, found = roles.resolve_roles(df)
    assert found["date"] == "when_sold" and "date" in resolved.columns


def test_typed_date_column_is_found_by_its_type(spark):
    df = spark.sql("select timestamp_ntz'2024-01-05 10:00:00' as created, 1.0D as sales, 'x' as note")
    resolved, found = roles.resolve_roles(df)
    assert found["date"] == "created"


def test_date_needs_enough_values(spark):
    df = spark.createDataFrame([("2024-01-05",), ("x",), ("y",)], "created_time string")
    assert roles.infer_date_column(df) is None
    half = spark.createDataFrame([("2024-01-05",), ("x",)], "created_time string")
    assert roles.infer_date_column(half) == "created_time"
    assert roles.infer_date_column(half, ["created_time"]) is None


def test_kinds_and_axes(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a", datetime(2024, 1, 1), 3)], "store_id int, margin double, shop string, at timestamp, n int")
    assert roles.column_kinds(df) == {
        "numeric": ["store_id", "margin", "n"], "datetime": ["at"], "categorical": ["shop"]}
    assert roles.metric_columns(df) == ["margin", "n"]
    assert roles.explorer_axes(df) == {"x": "store_id", "y": "margin", "z": "n", "color": "shop"}
    assert roles.ROLE_LABELS["customer_id"] == "Customer ID"
