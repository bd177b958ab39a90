"""Totals, customers, revenue drivers, segments, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, ranks
from ..functions.measures import mean, pearson, share, total
from ..roles import ROLE_LABELS
from ..session import materialize, settled

DRIVERS = ("quantity", "price", "discount")


def _best_first(measure: str, *ties: str) -> list[Column]:
    return [F.desc(measure), *[F.asc_nulls_last(c) for c in ties]]


def group_totals(df: DataFrame, by: str, measure: str = "sales") -> DataFrame:
    return df.groupBy(by).agg(total(measure).alias(measure))


def top_groups(df: DataFrame, by: str, measure: str = "sales", k: int = 10) -> DataFrame:
    """A1: the k groups with the highest total; missing keys are a group."""
    return group_totals(df, by, measure).orderBy(*_best_first(measure, by)).limit(k)


def category_or_product(df: DataFrame) -> str | None:
    return next((c for c in ("category", "product") if c in df.columns), None)


def top_entities(df: DataFrame, entity: str, k: int = 10) -> DataFrame:
    """A2: the k best entities with sales, quantity and number of orders.

    Distinct orders are counted over (entity, order) pairs, so a hot entity is shared
    out by order; without an order id the rows count.
    """
    measures = [total("sales").alias("sales")]
    if "quantity" in df.columns:
        measures.append(total("quantity").alias("quantity"))
    orders = (F.count_distinct("order_id") if "order_id" in df.columns else F.count(F.lit(1)))
    return df.groupBy(entity).agg(*measures, orders.alias("orders")).orderBy(
        *_best_first("sales", entity)).limit(k)


def entity_totals(df: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Sales, quantity and orders of every value of each entity, written: one scan for all.

    ``_set`` tells the entities' rows apart; `of_entity` picks one.
    """
    measures = [F.sum(c).alias(c) for c in ("sales", "quantity") if c in df.columns]
    orders = (F.count_distinct("order_id") if "order_id" in df.columns else F.count(F.lit(1)))
    return materialize(df.groupingSets([[F.col(e)] for e in entities], *entities).agg(
        *measures, orders.alias("orders"), F.grouping_id().alias("_set")), "entities")


def of_entity(totals: DataFrame, entities: Sequence[str], entity: str) -> DataFrame:
    """One entity's rows of `entity_totals`: the entity, and its sums."""
    bits = len(entities)
    number = (1 << bits) - 1 ^ (1 << (bits - 1 - list(entities).index(entity)))
    return totals.where(F.col("_set") == number).drop(
        "_set", *[e for e in entities if e != entity])


def top_of(per_entity: DataFrame, entity: str, k: int = 10) -> DataFrame:
    """A2 from an entity's sums."""
    sums = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
            for c in ("sales", "quantity") if c in per_entity.columns]
    return per_entity.select(entity, *sums, "orders").orderBy(*_best_first("sales", entity)).limit(k)


def customer_totals(df: DataFrame) -> DataFrame:
    """A3: transactions, revenue and average order value of every customer."""
    return df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("transactions"), total("sales").alias("revenue"),
        mean("sales").alias("average_order_value"))


def top_customers(
    df: DataFrame, k: int = 10, customers: DataFrame | None = None
) -> DataFrame:
    """A3: the k customers with the highest revenue; ``customers`` are their totals if known."""
    return (customer_totals(df) if customers is None else customers).orderBy(*_best_first("revenue", "customer_id")).limit(k)


def customer_kpis(df: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """A4: one row about the customer base; the top-5 share is NULL for a zero total.

    The table of customers is written, so that the top 5 need no second pass over the rows.
    """
    if customers is None:
        customers = materialize(customer_totals(df), "customers")
    top5 = customers.orderBy(*_best_first("revenue", "customer_id")).limit(5)
    return customers.agg(
        F.count(F.lit(1)).alias("active_customers"),
        F.avg((F.col("transactions") > 1).cast("int")).alias("repeat_rate"),
        F.avg("transactions").alias("avg_orders_per_customer"),
        F.avg("revenue").alias("avg_spend_per_customer"),
        F.sum("revenue").alias("_all"),
    ).select(
        "active_customers", "repeat_rate", "avg_orders_per_customer", "avg_spend_per_customer",
        share(top5.agg(F.sum("revenue")).scalar(), F.col("_all")).alias("top_customer_share"))


def transaction_kpis(df: DataFrame) -> DataFrame:
    """A5: what to report where there is no customer: (metric, value)."""
    median = ranks.exact_medians(df, ["sales"])["sales"] if "sales" in df.columns else None
    nothing = F.lit(None).cast("double")
    sales = F.col("sales") if "sales" in df.columns else nothing
    quantity = F.col("quantity") if "quantity" in df.columns else nothing
    middle = F.lit(median).cast("double")
    # A missing amount is not above the median, but it is a transaction.
    above = F.coalesce((sales.cast("double") > middle).cast("int"), F.lit(0))
    if "sales" not in df.columns:
        above = F.lit(None).cast("int")
    return df.agg(
        mean(sales).alias("Average transaction value"),
        F.first(middle).alias("Median transaction value"),
        mean(quantity).alias("Average quantity per transaction"),
        F.avg(above).alias("Transactions above median value"),
    ).transform(lambda d: d.unpivot([], [F.col(f"`{c}`") for c in d.columns], "metric", "value"))


def revenue_drivers(df: DataFrame, drivers: tuple[str, ...] = DRIVERS) -> DataFrame:
    """Correlation of each driver with sales, strongest first; one pass.

    A driver that is constant, or never seen together with sales, is left out.
    """
    found = [c for c in drivers if c in df.columns]
    if not found:
        return df.sparkSession.createDataFrame([], "factor string, correlation_with_sales double")
    row = df.agg(*[pearson(F.col("sales"), F.col(c)).alias(ROLE_LABELS[c]) for c in found])
    return row.unpivot([], list(row.columns), "factor", "correlation_with_sales").where(
        "correlation_with_sales is not null"
    ).orderBy(F.desc(F.abs("correlation_with_sales")), "factor")


def correlation_matrix(
    df: DataFrame, cols: tuple[str, ...] = ("sales", "quantity", "price", "discount")
) -> DataFrame:
    """(x, y, corr) for every pair of measures, all pairs in one pass."""
    found = [c for c in cols if c in df.columns]
    pairs = [(x, y) for i, x in enumerate(found) for y in found[i:]]
    row = df.agg(*[pearson(F.col(x), F.col(y)).alias(f"{x}|{y}") for x, y in pairs])
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{x}|{y}`").alias("corr"))
             for x, y in pairs for a, b in dict.fromkeys([(x, y), (y, x)])]
    return row.select(F.inline(F.array(*cells)))


def drivers_of(matrix: DataFrame, drivers: tuple[str, ...] = DRIVERS) -> DataFrame:
    """A6 from a matrix of A7 that has sales and the drivers."""
    name = F.coalesce(*[F.when(F.col("y") == c, F.lit(ROLE_LABELS[c])) for c in drivers])
    return matrix.where((F.col("x") == "sales") & F.col("y").isin(*drivers)).select(
        name.alias("factor"), F.col("corr").alias("correlation_with_sales")).where(
            "correlation_with_sales is not null").orderBy(
                F.desc(F.abs("correlation_with_sales")), "factor")


def top_shares(df: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k best groups and their share of all sales."""
    groups = group_totals(df, by)
    everything = groups.agg(F.sum("sales")).scalar()
    return groups.orderBy(*_best_first("sales", by)).limit(k).withColumn(
        "share_of_sales", share(F.col("sales"), everything))


def concentration(df: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Total, best group, and the share of the k best, for one dimension."""
    groups = group_totals(df, by)
    top = groups.orderBy(*_best_first("sales", by)).limit(k)
    leader = F.min(F.struct((-F.col("sales")).alias("minus"), F.col(by).isNull().alias("gone"),
                            F.col(by).alias("label")))
    return top.agg(leader.alias("leader"), F.sum("sales").alias("top_sales")).select(
        F.lit(by).alias("dimension"),
        F.col("leader.label").cast("string").alias("best"),
        (-F.col("leader.minus")).alias("best_sales"),
        groups.agg(total("sales")).scalar().alias("total_sales"),
        share(F.col("top_sales"), groups.agg(F.sum("sales")).scalar()).alias("top_share"))


def dataset_overview(df: DataFrame) -> DataFrame:
    """One row: size, sales, date range, distinct labels (those that apply)."""
    measures = [F.count(F.lit(1)).alias("rows"),
                F.lit(len(df.columns)).cast("bigint").alias("columns")]
    if "sales" in df.columns:
        measures.append(total("sales").alias("total_sales"))
    if "date" in df.columns:
        measures += [F.to_date(F.min("date")).alias("first_date"),
                     F.to_date(F.max("date")).alias("last_date")]
    measures += [F.count_distinct(c).alias(name) for c, name in
                 (("category", "categories"), ("region", "regions")) if c in df.columns]
    return df.agg(*measures)


LABELS = ("product", "category", "region")
#: Names of a cell's sums, so that they do not take columns' places.
_ROWS, _SUM, _FILLED = "_rows", "_sum_", "_filled_"


def label_cells(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows and sums of every combination of labels, written: one scan, from which totals,
    vocabularies, segments and their leaders all come."""
    found = [c for c in labels if c in df.columns]
    measures = [c for c in ("sales", "quantity", "price") if c in df.columns]
    dates_ = [f(F.col("date")).alias(n) for f, n in ((F.min, "_first"), (F.max, "_last")) if "date" in df.columns]
    return materialize(df.groupBy(*found).agg(
        F.count(F.lit(1)).alias(_ROWS), *[F.sum(c).alias(_SUM + c) for c in measures],
        *[F.count(c).alias(_FILLED + c) for c in measures], *dates_), "cells")


def cell_totals(cells: DataFrame, by: str) -> DataFrame:
    """Sales of every value of a label, from `label_cells`."""
    return cells.groupBy(by).agg(total(_SUM + "sales").alias("sales"))


def top_of_cells(cells: DataFrame, by: str, k: int = 10) -> DataFrame:
    """A1 from `label_cells`."""
    return cell_totals(cells, by).orderBy(*_best_first("sales", by)).limit(k)


def overview_of(cells: DataFrame, columns: int) -> DataFrame:
    """A20 from `label_cells` of a table with so many columns."""
    measures = [F.coalesce(F.sum(_ROWS), F.lit(0)).alias("rows"), F.lit(columns).cast("bigint").alias("columns")]
    if _SUM + "sales" in cells.columns:
        measures.append(total(_SUM + "sales").alias("total_sales"))
    if "_first" in cells.columns:
        measures += [F.to_date(F.min("_first")).alias("first_date"), F.to_date(F.max("_last")).alias("last_date")]
    measures += [F.count_distinct(c).alias(name) for c, name in
                 (("category", "categories"), ("region", "regions")) if c in cells.columns]
    return cells.agg(*measures)


def _segment(by: str) -> Column:
    return F.lower(F.col(by).cast("string")).alias("segment")


def summary_of(cells: DataFrame, by: str) -> DataFrame:
    """A21 from `label_cells`."""
    measures = [F.sum(_ROWS).alias("rows")]
    if _SUM + "sales" in cells.columns:
        measures.append(total(_SUM + "sales").alias("total_sales"))
    measures += [F.try_divide(F.sum(_SUM + c).cast("double"), F.sum(_FILLED + c).cast("double")).alias(f"average_{c}")
                 for c in ("quantity", "price") if _SUM + c in cells.columns]
    return cells.where(F.col(by).isNotNull()).groupBy(_segment(by)).agg(*measures)


def leaders_of(cells: DataFrame, by: str, of: str, k: int = 5) -> DataFrame:
    """A21 from `label_cells`: the k best ``of`` inside every segment.

    The rank limit reaches below the shuffle (``WindowGroupLimit``): each task sends at
    most k rows per segment, however many labels a segment has.
    """
    totals = cells.where(F.col(by).isNotNull()).groupBy(_segment(by), F.col(of).alias("label")).agg(
        total(_SUM + "sales").alias("sales"))
    order = Window.partitionBy("segment").orderBy(*_best_first("sales", "label"))
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def segment_summary(df: DataFrame, by: str) -> DataFrame:
    """Rows, sales and means of every segment at once; case does not matter."""
    return summary_of(label_cells(df, [by]), by)


def segment_leaders(df: DataFrame, by: str, of: str, k: int = 5) -> DataFrame:
    """The k best ``of`` inside every segment: (segment, rank, label, sales)."""
    return leaders_of(label_cells(df, [by, of]), by, of, k)


def product_dimension(df: DataFrame) -> DataFrame:
    """Usual category, price and quantity of every product."""
    known = df.where("product is not null")
    parts = []
    if "category" in df.columns:
        parts.append(ranks.grouped_modes(known, "product", "category", "Other"))
    measures = [c for c in ("price", "quantity") if c in df.columns]
    if measures:
        parts.append(ranks.grouped_medians(known, ["product"], measures))
    if not parts:
        return known.select("product").distinct()
    return reduce(lambda a, b: a.join(b, "product", "full"), parts)


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values."""
    return df.where(F.col(col).isNotNull()).select(
        F.col(col).cast("string").alias("term")).distinct().orderBy("term")


def monthly_sales(df: DataFrame) -> DataFrame:
    """Sales of each calendar month that has rows."""
    return df.where("date is not null").groupBy(
        dates.month_label(F.col("date")).alias("month")).agg(total("sales").alias("sales"))


def data_context(frame: DataFrame, cells: DataFrame | None = None) -> dict[str, DataFrame]:
    """The lookup tables that requests are answered from, over a C20 frame.

    Vocabularies and top lists come from the frame's `label_cells`; months and products are
    written, so that no table reads the frame any more.
    """
    cells = label_cells(frame) if cells is None else cells
    context = {"cells": cells, "overview": overview_of(cells, len(frame.columns))}
    if "date" in frame.columns:
        context["monthly_sales"] = materialize(monthly_sales(frame), "monthly-sales")
    for col in LABELS:
        if col in frame.columns:
            context[f"known_{col}"] = vocabulary(cells, col)
            context[f"top_{col}"] = top_of_cells(cells, col)
    if "product" in frame.columns:
        context["product_dimension"] = settled(
            frame.sparkSession, lambda: product_dimension(frame), "product-dimension")
    return context
