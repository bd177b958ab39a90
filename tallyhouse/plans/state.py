"""Mergeable state of an analysis: partial aggregates, stored per part of a table and added up.

A part's state is a handful of tables whose rows are sums over keys, so the state of two parts is the
union of their rows, added up by key. Insight tables come from the state alone: new rows
cost a pass over the new rows, not over the table.

``entities``   (entity, value): rows, sales, quantity
``days``       (day): rows, sales
``customers``  (customer_id): transactions, revenue
``moments``    (x, y): n and the sums of x, y, x*x, y*y, x*y, each off a given origin
``bins``       (metric, bin): count, over bins of a given width
``orders``     (entity, value): a sketch of the distinct orders
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sales, timeline
from ..sources.sinks import publish, read_published

ENTITIES = ("product", "category", "region")
MEASURES = ("sales", "quantity", "price")
KEYS = {"entities": ("entity", "value"), "days": ("day",), "customers": ("customer_id",),
        "moments": ("x", "y"), "bins": ("metric", "bin"), "orders": ("entity", "value")}
SKETCH_BITS = 12


@dataclass(frozen=True)
class Settings:
    """What parts must have in common to be added up.

    ``origins`` should be near the measures' means, so that the sums of squares keep their digits.
    """

    widths: Mapping[str, float] = field(default_factory=lambda: {"sales": 1000.0, "quantity": 1.0, "price": 100.0})
    origins: Mapping[str, float] = field(default_factory=dict)


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(F.col(name).cast("double")), F.lit(0.0)).alias(name)


def state_of(df: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The state of a cleaned table; tables whose columns are absent are left out."""
    found: dict[str, DataFrame] = {}
    entities = [c for c in ENTITIES if c in df.columns]
    measures = [c for c in MEASURES if c in df.columns]
    if entities:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("value")) for e in entities])).alias("e"),
            *[c for c in ("sales", "quantity", "order_id") if c in df.columns]).select("e.*", "*").drop("e")
        found["entities"] = long.groupBy("entity", "value").agg(
            F.count(F.lit(1)).alias("rows"), *[_sum(c) for c in ("sales", "quantity") if c in df.columns])
        if "order_id" in df.columns:
            found["orders"] = long.where("order_id is not null").groupBy("entity", "value").agg(
                F.hll_sketch_agg(F.col("order_id").cast("string"), SKETCH_BITS).alias("sketch"))
    if "date" in df.columns:
        found["days"] = df.where("date is not null").groupBy(F.to_date("date").alias("day")).agg(
            F.count(F.lit(1)).alias("rows"), _sum("sales"))
    if "customer_id" in df.columns:
        found["customers"] = df.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("transactions"), _sum("sales").alias("revenue"))
    if measures:
        value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) - settings.origins.get(c, 0.0) for c in measures}
        pairs = [(x, y) for x in measures for y in measures if x <= y]
        cells = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), value[x].alias("a"),
                                             value[y].alias("b")) for x, y in pairs]))
        a, b = F.col("a"), F.col("b")
        found["moments"] = df.select(cells.alias("c")).select("c.*").where("a is not null and b is not null").groupBy(
            "x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"),
                          F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
        bins = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.floor(
            F.nanvl(F.col(c).cast("double"), F.lit(None)) / settings.widths[c]).alias("bin")) for c in measures]))
        found["bins"] = df.select(bins.alias("b")).select("b.*").where("bin is not null").groupBy(
            "metric", "bin").agg(F.count(F.lit(1)).alias("count"))
    return found


def merge(*states: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The state of several parts together, however they were cut."""
    out: dict[str, DataFrame] = {}
    for name in dict.fromkeys(n for s in states for n in s):
        parts = [s[name] for s in states if name in s]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
        keys = KEYS[name]
        sums = [F.hll_union_agg(c).alias(c) if c == "sketch" else F.sum(c).alias(c)
                for c in every.columns if c not in keys]
        out[name] = every.groupBy(*keys).agg(*sums)
    return out


def insights_of(state: Mapping[str, DataFrame], settings: Settings = Settings(), k: int = 10) -> dict[str, DataFrame]:
    """Insight tables from a state: top entities, shares, customers, trend, correlations, histograms."""
    tables: dict[str, DataFrame] = {}
    if "entities" in state:
        for entity in ENTITIES:
            own = state["entities"].where(F.col("entity") == entity).drop("entity")
            ranked = own.orderBy(F.desc("sales"), F.asc_nulls_last("value")).limit(k)
            if "orders" in state:
                counts = state["orders"].where(F.col("entity") == entity).select(
                    F.col("value").alias("_value"), F.hll_sketch_estimate("sketch").alias("orders"))
                ranked = ranked.join(counts, F.col("value").eqNullSafe(F.col("_value")), "left").drop("_value")
            tables[f"top_{entity}"] = ranked
    if "customers" in state:
        totals = state["customers"].withColumn("average_order_value", F.col("revenue") / F.col("transactions"))
        tables["customer_kpis"] = sales.customer_kpis(totals, totals)
        tables["top_customers"] = sales.top_customers(totals, k, totals)
    if "days" in state:
        days = state["days"].withColumn("date", F.col("day").cast("timestamp"))
        tables["monthly_sales"] = sales.monthly_sales(days)
        tables["month_pattern"] = timeline.month_pattern(days)
    if "moments" in state:
        n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
        spread = F.sqrt((F.col("sxx") - sx * sx / n) * (F.col("syy") - sy * sy / n))
        tables["correlations"] = state["moments"].select(
            "x", "y", F.try_divide(F.col("sxy") - sx * sy / n, spread).alias("correlation"))
    if "bins" in state:
        width = F.coalesce(*[F.when(F.col("metric") == c, F.lit(float(w))) for c, w in settings.widths.items()])
        tables["histograms"] = state["bins"].select(
            "metric", (F.col("bin") * width).alias("bin_start"), ((F.col("bin") + 1) * width).alias("bin_end"), "count")
    return tables


def add_part(spark: SparkSession, root: str, new: Mapping[str, DataFrame]) -> int:
    """Adds a part's state to what is published under ``root``, as a new version."""
    before = read_published(spark, root)
    return publish(spark, merge(before, new) if before else new, root)
