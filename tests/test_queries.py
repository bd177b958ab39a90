"""Every registered query against its SQL, and the shape of its plan."""

import contextlib
import io

import pytest
from conftest import FOLDER

from checks.all_queries import ORACLES, QUERIES
from checks.compare import _rows, connect

# Joins without keys, Python workers, and sorts of a whole table in one task.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
            "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "ExistingRDD")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    plan = plan_of(df)
    # Rows made on the driver (answers, histogram edges, fill values) are few by design.
    shown = plan.replace("Scan ExistingRDD", "")
    for operator in UNWANTED:
        assert operator not in shown, plan
    got = _rows(df.columns, df.collect())
    assert got
    if name in ORACLES:
        result = db.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert got == _rows(names, result.fetchall())


@pytest.mark.parametrize("name,operator", [
    ("A1_top_product", "TakeOrderedAndProject"), ("A2_top_entities_product", "TakeOrderedAndProject"),
    ("A3_top_customers", "TakeOrderedAndProject"), ("A21_segment_category_top_product", "WindowGroupLimit"),
    ("A1_top_product", "SortMergeJoin"), ("A4_customer_kpis", "Subquery"),
    ("A13_monthly_sales", "partial_sum"), ("C10_dedupe", "HashAggregate")])
def test_plan_has(spark, name, operator):
    assert operator in plan_of(QUERIES[name](spark, FOLDER))


@pytest.mark.parametrize("name,columns", [
    ("A1_top_region", ["p_name", "l_tax"]), ("A13_monthly_sales", ["c_name", "l_shipdate"])])
def test_unused_columns_are_not_read(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, FOLDER)).splitlines()
    read = " ".join(line.split("ReadSchema")[1] for line in plan if "ReadSchema" in line)
    assert read and not any(column in read for column in columns)
