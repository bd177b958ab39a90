"""Totals, customers, drivers, time, distributions, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.cleaning_queries import AS_OF
from checks.registry import register, written_fact
from checks.sqltext import CLEAN, EVENTS, FACT, FRAME, query
from tallyhouse.functions import ranks
from tallyhouse.operators import cleaning, distributions, sales, timeline
from tallyhouse.plans import state
from tallyhouse.session import new_path
from tallyhouse.sources import sinks, warehouse

SALES = "cast(sum(sales) as double)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Ratios and means of doubles, cut to digits that do not depend on summing order."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def fact_of(spark, folder):
    return warehouse.retail_fact(spark, folder)


def cleaned_of(spark, folder):
    """The cleaned table with amounts as decimals, so sums are exact in any order."""
    cleaned = cleaning.prepare(warehouse.retail_dirty(spark, folder), AS_OF).cleaned
    return cleaned.withColumns({"sales": F.col("sales").cast("decimal(18,4)"),
                                "price": F.col("price").cast("decimal(18,4)")})


CLEAN_MONEY = CLEAN + """,
money as (select * replace (cast(sales as decimal(18,4)) as sales,
                            cast(price as decimal(18,4)) as price) from clean)"""


def _top_sql(by: str, source: str = "fact", k: int = 10) -> str:
    return (f"select {by}, {SALES} as sales from {source} group by {by} "
            f"order by sales desc, {by} limit {k}")


for _by in ("category", "product", "region"):
    register(f"A1_top_{_by}", query(FACT, _top_sql(_by)))(
        lambda spark, folder, by=_by: sales.top_groups(fact_of(spark, folder), by))


@register("A1_top_product_cleaned", query(CLEAN_MONEY, _top_sql("product", "money")))
def a1_cleaned(spark, folder):
    return sales.top_groups(cleaned_of(spark, folder), "product")


for _by in ("product", "region"):
    register(f"A2_top_entities_{_by}", query(FACT, f"""
select {_by}, {SALES} as sales, sum(quantity) as quantity, count(distinct order_id) as orders
from fact group by {_by} order by sales desc, {_by} limit 10"""))(
        lambda spark, folder, by=_by: sales.top_entities(fact_of(spark, folder), by))

CUSTOMERS = """,
customers as (select customer_id, count(*) as transactions, cast(sum(sales) as double) as revenue,
  cast(sum(sales) as double) / count(sales) as average_order_value from fact group by customer_id)"""


@register("A3_customer_totals", query(FACT + CUSTOMERS, """
select customer_id, transactions, revenue, average_order_value
from customers"""))
def a3_all(spark, folder):
    return sales.customer_totals(fact_of(spark, folder))


@register("A3_top_customers", query(FACT + CUSTOMERS, """
select customer_id, transactions, revenue, average_order_value
from customers order by revenue desc, customer_id limit 10"""))
def a3(spark, folder):
    return sales.top_customers(fact_of(spark, folder))


def _kpi_sql(customers: str) -> str:
    return f"""
select count(*) as active_customers,
  round(avg(case when transactions > 1 then 1 else 0 end), 6) as repeat_rate,
  round(avg(transactions), 6) as avg_orders_per_customer,
  round(avg(revenue), 4) as avg_spend_per_customer,
  round((select sum(revenue) from (select revenue from {customers}
    order by revenue desc, customer_id limit 5)) / sum(revenue), 6) as top_customer_share
from {customers}"""


def _kpis(df: DataFrame) -> DataFrame:
    kpis = rounded(sales.customer_kpis(df), "repeat_rate", "avg_orders_per_customer",
                   "top_customer_share")
    return rounded(kpis, "avg_spend_per_customer", digits=4)


@register("A4_customer_kpis", query(FACT + CUSTOMERS, _kpi_sql("customers")))
def a4(spark, folder):
    return _kpis(fact_of(spark, folder))


@register("A4_customer_kpis_by_order", query(FACT + """,
orders_once as (select order_id as customer_id, count(*) as transactions,
  cast(sum(sales) as double) as revenue from fact group by order_id)""",
                                              _kpi_sql("orders_once")))
def a4_orders(spark, folder):
    """Orders in the customer role: here many have one row, so the repeat rate is below 1."""
    fact = fact_of(spark, folder).drop("customer_id")
    return _kpis(fact.withColumnRenamed("order_id", "customer_id"))


@register("A5_transaction_kpis", query(FACT, """
select 'Average transaction value' as metric, round(avg(cast(sales as double)), 4) as value
  from fact union all
select 'Median transaction value', round(median(cast(sales as double)), 4) from fact union all
select 'Average quantity per transaction', round(avg(quantity), 4) from fact union all
select 'Transactions above median value', round(avg(case when cast(sales as double) >
  (select median(cast(sales as double)) from fact) then 1 else 0 end), 4) from fact"""))
def a5(spark, folder):
    fact = fact_of(spark, folder).drop("customer_id")
    return rounded(sales.transaction_kpis(fact), "value", digits=4)


@register("A6_revenue_drivers", query(FACT, " union all ".join(
    f"select '{c.title()}' as factor, round(corr(cast(sales as double), cast({c} as double)), 6) "
    "as correlation_with_sales from fact" for c in sales.DRIVERS)))
def a6(spark, folder):
    return rounded(sales.revenue_drivers(fact_of(spark, folder)), "correlation_with_sales")


_MEASURES = ("sales", "quantity", "price", "discount")


@register("A7_correlation_matrix", query(FACT, " union all ".join(
    f"select '{x}' as x, '{y}' as y, round(corr(cast({x} as double), cast({y} as double)), 6) "
    "as corr from fact" for x in _MEASURES for y in _MEASURES)))
def a7(spark, folder):
    return rounded(sales.correlation_matrix(fact_of(spark, folder)), "corr")


_MODEL_MEASURES = ("sales", "quantity", "price", "customer_purchase_count")


@register("A7_correlation_matrix_model", query(FRAME, " union all ".join(
    f"select '{x}' as x, '{y}' as y, round(corr({x}, {y}), 6) as corr from frame"
    for x in _MODEL_MEASURES for y in _MODEL_MEASURES)))
def a7_model(spark, folder):
    frame = cleaning.model_frame(written_fact(spark, folder), AS_OF)
    return rounded(sales.correlation_matrix(frame, _MODEL_MEASURES), "corr")


for _by in ("category", "region"):
    register(f"A8_top_shares_{_by}", query(FACT, f"""
select {_by}, sales, round(sales / total, 6) as share_of_sales from (
  select {_by}, {SALES} as sales, (select {SALES} from fact) as total from fact group by {_by}
  order by sales desc, {_by} limit 5)"""))(
        lambda spark, folder, by=_by: rounded(
            sales.top_shares(fact_of(spark, folder), by), "share_of_sales"))


@register("A9_concentration", query(FACT, " union all ".join(f"""
select '{by}' as dimension, first({by} order by sales desc, {by}) as best,
  max(sales) as best_sales, round((select {SALES} from fact), 2) as total_sales,
  round(sum(sales) / (select {SALES} from fact), 6) as top_share
from (select {by}, {SALES} as sales from fact group by {by} order by sales desc, {by} limit 5)
""" for by in ("product", "category", "region"))))
def a9(spark, folder):
    fact = written_fact(spark, folder)
    parts = [sales.concentration(fact, by) for by in ("product", "category", "region")]
    return rounded(rounded(reduce(DataFrame.unionByName, parts), "top_share"),
                   "total_sales", digits=2)


def _grain_sql(source: str) -> str:
    return f"""
select span_days, days, case when span_days is null or span_days > 730 or days > 365 then 'M'
  when span_days > 120 or days > 90 then 'W' else 'D' end as grain
from (select cast(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000) as bigint)
  as span_days, count(distinct cast(date as date)) as days from {source})"""


@register("A10_time_grain", query(FACT, _grain_sql("fact")))
def a10(spark, folder):
    return timeline.time_grain(fact_of(spark, folder))


@register("A10_time_grain_events", query(EVENTS, _grain_sql("event_fact")))
def a10_events(spark, folder):
    return timeline.time_grain(warehouse.event_fact(spark, folder))


def _trend_sql(source: str, grain: str) -> str:
    bucket = {"M": "last_day(cast(date as date))",
              "W": "cast(date_trunc('week', date) as date) + 6",
              "D": "cast(date as date)"}[grain]
    spine = {
        "M": "select last_day(cast(p as date)) as bucket from range_of, unnest(generate_series("
             "date_trunc('month', lo), date_trunc('month', hi), interval 1 month)) s(p)",
        "W": "select cast(p as date) as bucket from range_of, "
             "unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), "
             "interval 7 day)) s(p)",
        "D": "select cast(p as date) as bucket from range_of, "
             "unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), "
             "interval 1 day)) s(p)"}[grain]
    return f""",
buckets as (select {bucket} as bucket, cast(sum(cast(sales as decimal(18,4))) as double) as sales
  from {source} where date is not null and sales is not null group by 1),
range_of as (select min(bucket) as lo, max(bucket) as hi from buckets),
spine as ({spine}),
trend as (select spine.bucket, coalesce(sales, 0.0) as sales from spine left join buckets
  on spine.bucket = buckets.bucket)"""


def events_of(spark, folder):
    return warehouse.event_fact(spark, folder).withColumn(
        "sales", F.col("sales").cast("decimal(18,4)"))


for _grain, _label in (("M", "monthly"), ("W", "weekly"), ("D", "daily")):
    register(f"A11_sales_trend_{_label}", query(
        FACT + _trend_sql("fact", _grain), "select bucket, sales from trend"))(
        lambda spark, folder, grain=_grain: timeline.sales_trend(fact_of(spark, folder), grain))


@register("A11_sales_trend_events", query(
    EVENTS + _trend_sql("event_fact", "D"), "select bucket, sales from trend"))
def a11_events(spark, folder):
    return timeline.sales_trend(events_of(spark, folder))


@register("A12_trend_extremes", query(FACT + _trend_sql("fact", "M"), """
select first(bucket order by sales desc, bucket) as peak, max(sales) as peak_sales,
  first(bucket order by sales, bucket) as low, min(sales) as low_sales from trend"""))
def a12(spark, folder):
    return timeline.extremes(timeline.sales_trend(fact_of(spark, folder)), "bucket")


@register("A13_monthly_sales", query(FACT, f"""
select strftime(date, '%Y-%m') as month, {SALES} as sales from fact group by 1"""))
def a13(spark, folder):
    return sales.monthly_sales(fact_of(spark, folder))


@register("A14_month_pattern", query(FACT, f"""
select cast(month(date) as int) as month, {SALES} as sales from fact group by 1"""))
def a14(spark, folder):
    return timeline.month_pattern(fact_of(spark, folder))


@register("A14_month_extremes", query(FACT, f"""
select first(month order by sales desc, month) as peak, max(sales) as peak_sales,
  first(month order by sales, month) as low, min(sales) as low_sales
from (select cast(month(date) as int) as month, {SALES} as sales from fact group by 1)"""))
def a14_extremes(spark, folder):
    return timeline.extremes(timeline.month_pattern(fact_of(spark, folder)), "month")


@register("A15_first_and_last_period", query(FACT, f"""
select min(month) as first_period, max(month) as last_period,
  first(sales order by month) as first_period_sales,
  first(sales order by month desc) as last_period_sales
from (select strftime(date, '%Y-%m') as month, {SALES} as sales from fact group by 1)"""))
def a15(spark, folder):
    return timeline.first_and_last_period(fact_of(spark, folder))


def _histogram_sql(column: str, bins: str) -> str:
    return f"""
select '{column}' as metric, cast(s.bin as int) as bin, lo + s.bin * ((hi - lo) / bins) as bin_start,
  lo + (s.bin + 1) * ((hi - lo) / bins) as bin_end, coalesce(n, 0) as count
from (select min(v) as lo, max(v) as hi, {bins} as bins
      from (select cast({column} as double) as v from fact)) l,
  unnest(range(bins)) s(bin) left join (
    select least(cast(floor((v - lo) * bins / (hi - lo)) as int), bins - 1) as bin, count(*) as n
    from (select cast({column} as double) as v from fact),
      (select min(cast({column} as double)) as lo, max(cast({column} as double)) as hi,
       {bins.replace('(v)', f'({column})')} as bins from fact) group by 1) c on c.bin = s.bin"""


_ROOT = "least(30, greatest(10, cast(floor(sqrt(count(v))) as int)))"
for _name, _bins, _fixed in (("A16_histograms", _ROOT, None), ("A16_histograms_30", "30", 30)):
    register(_name, query(FACT, " union all ".join(
        _histogram_sql(c, _bins) for c in ("sales", "quantity", "price"))))(
        lambda spark, folder, bins=_fixed: distributions.histograms(
            written_fact(spark, folder), bins=bins))


def _density_sql(column: str) -> str:
    return f"""
select '{column}' as metric, cast(point as int) as point, round(any_value(x), 6) as x,
  round(any_value(hi - lo) * sum(n * exp(-0.5 * ((x - v) / width) * ((x - v) / width)))
    / any_value(total * width * sqrt(2 * pi())), 6) as density
from (
  select g.point, v, n, lo, hi, total, width, lo + g.point * ((hi - lo) / 199.0) as x
  from (select v, count(*) as n from (select cast({column} as double) as v from fact) group by v),
    (select min(v) as lo, max(v) as hi, cast(count(*) as double) as total,
      stddev_samp(v) * pow(count(*), -0.2) as width, count(distinct v) as d
     from (select cast({column} as double) as v from fact)),
    range(200) g(point) where d > 10)
group by point"""


@register("A17_densities", query(FACT, " union all ".join(
    _density_sql(c) for c in ("sales", "quantity", "price"))))
def a17(spark, folder):
    fact = written_fact(spark, folder)
    curves = distributions.densities(fact)
    # Densities of wide measures are tiny: scale by the range before rounding.
    spans = {c: fact.agg((F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")))).scalar()
             for c in ("sales", "quantity", "price")}
    span = F.coalesce(*[F.when(F.col("metric") == c, s) for c, s in spans.items()])
    return curves.select("metric", "point", F.round("x", 6).alias("x"),
                         F.round(F.col("density") * span, 6).alias("density"))


def _binned_sql(column: str) -> str:
    return f"""
select '{column}' as metric, cast(point as int) as point, round(any_value(x), 6) as x,
  round(any_value(hi - lo) * sum(w * exp(-0.5 * ((x - c) / width) * ((x - c) / width)))
    / any_value(total * width * sqrt(2 * pi())), 6) as density
from (
  select g.point, b.w, lo, hi, total, width, lo + g.point * ((hi - lo) / 199.0) as x,
    lo + b.at * ((hi - lo) / 2047.0) as c
  from (select bin + side as at, sum(case side when 0 then 1 - over else over end) as w
        from (select least(floor(place), 2046) as bin, place - least(floor(place), 2046) as over
              from (select (cast({column} as double) - lo) / ((hi - lo) / 2047.0) as place
                    from fact, (select min(cast({column} as double)) as lo,
                                  max(cast({column} as double)) as hi from fact))
              where place is not null), range(2) s(side) group by 1) b,
    (select min(v) as lo, max(v) as hi, cast(count(*) as double) as total,
      stddev_samp(v) * pow(count(*), -0.2) as width, count(distinct v) as d
     from (select cast({column} as double) as v from fact)),
    range(200) g(point) where d > 10)
group by point"""


@register("A17_binned_densities", query(FACT, " union all ".join(
    _binned_sql(c) for c in ("sales", "quantity", "price"))))
def a17_binned(spark, folder):
    """On 2,048 points, whatever the number of values."""
    fact = written_fact(spark, folder)
    spans = {c: fact.agg((F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")))).scalar()
             for c in ("sales", "quantity", "price")}
    span = F.coalesce(*[F.when(F.col("metric") == c, s) for c, s in spans.items()])
    return distributions.binned_densities(fact).select(
        "metric", "point", F.round("x", 6).alias("x"), F.round(F.col("density") * span, 6).alias("density"))


@register("A18_sampled_points", query(FACT, """
select quantity, sales, category, price, product, region, customer_id from fact
qualify row_number() over (partition by category order by md5(h)) <= 50"""))
def a18_sampled(spark, folder):
    """The 50 rows of each category whose hash is least."""
    return distributions.scatter_points(fact_of(spark, folder), points=50, key="h")


@register("A18_scatter_points", query(FACT, """
select quantity, sales, category, price, product, region, customer_id from fact"""))
def a18(spark, folder):
    return distributions.scatter_points(fact_of(spark, folder))


@register("A18_cloud_points", query(CLEAN.replace("clean as (", "unused as ("), r"""
select quantity, try_cast(regexp_replace(regexp_replace(price, '\(([^)]+)\)', '-\1', 'g'),
    '[^0-9.\-]', '', 'g') as double) as price,
  try_cast(regexp_replace(sales, '[^0-9.\-]', '', 'g') as double) as sales,
  case when category is null or category = 'nan' then 'Unknown' else category end as category,
  product, region, customer_id
from dirty where quantity is not null and price is not null and sales is not null"""))
def a18_cloud(spark, folder):
    dirty = warehouse.retail_dirty(spark, folder)
    return distributions.cloud_points(dirty, "quantity", "price", "sales", "category")


@register("A20_dataset_overview", query(FACT, f"""
select count(*) as rows, cast(11 as bigint) as columns, {SALES} as total_sales,
  cast(min(date) as date) as first_date, cast(max(date) as date) as last_date,
  count(distinct category) as categories, count(distinct region) as regions from fact"""))
def a20(spark, folder):
    return sales.dataset_overview(fact_of(spark, folder))


for _by in ("product", "category", "region"):
    register(f"A21_segment_{_by}", query(FACT, f"""
select lower({_by}) as segment, count(*) as rows, {SALES} as total_sales,
  round(avg(quantity), 4) as average_quantity,
  round(avg(cast(price as double)), 4) as average_price from fact group by 1"""))(
        lambda spark, folder, by=_by: rounded(
            sales.segment_summary(fact_of(spark, folder), by),
            "average_quantity", "average_price", digits=4))

for _by, _of in (("category", "product"), ("region", "product"), ("product", "region"),
                 ("category", "region")):
    register(f"A21_segment_{_by}_top_{_of}", query(FACT, f"""
select segment, label, sales, rank from (
  select lower({_by}) as segment, {_of} as label, {SALES} as sales,
    cast(row_number() over (partition by lower({_by}) order by {SALES} desc, {_of}) as int)
      as rank from fact group by 1, 2) where rank <= 5"""))(
        lambda spark, folder, by=_by, of=_of: sales.segment_leaders(
            fact_of(spark, folder), by, of))


def _dimension_sql(source: str) -> str:
    return f"""
select product, category, price, quantity from (
  select product, category from (
    select product, category, row_number() over (partition by product
      order by count(*) desc, category) as r from {source} group by 1, 2) where r = 1)
join (select product, median(cast(price as double)) as price, median(quantity) as quantity
      from {source} group by 1) using (product)"""


@register("A22_product_dimension", query(FACT, _dimension_sql("fact")))
def a22(spark, folder):
    return sales.product_dimension(fact_of(spark, folder))


@register("A22_grouped_medians", query(FACT, """
select customer_id, median(cast(price as double)) as price, median(quantity) as quantity,
  median(cast(sales as double)) as sales from fact group by 1"""))
def a22_spread(spark, folder):
    """Many groups and several columns at once."""
    return ranks.grouped_medians(fact_of(spark, folder), ["customer_id"], ["price", "quantity", "sales"])


@register("A22_medians_with_empty_groups", query(FACT, """
select g, median(quantity) as quantity, median(price) as price from (
  select case when substr(h, 1, 1) = '0' then null else substr(h, 1, 1) end as g,
    case when substr(h, 1, 1) = '3' then null else quantity end as quantity,
    case when substr(h, 2, 1) < '8' then null else cast(price as double) end as price
  from fact) group by g"""))
def a22_empty(spark, folder):
    """A group without values, and one without a key."""
    first = F.substring("h", 1, 1)
    holes = fact_of(spark, folder).select(
        F.when(first != "0", first).alias("g"), F.when(first != "3", F.col("quantity")).alias("quantity"),
        F.when(F.substring("h", 2, 1) >= "8", F.col("price").cast("double")).alias("price"))
    return ranks.grouped_medians(holes, ["g"], ["quantity", "price"])


@register("A23_vocabularies", query(FACT, " union all ".join(
    f"select distinct '{c}' as vocabulary, {c} as term from fact"
    for c in ("product", "category", "region"))))
def a23(spark, folder):
    fact = fact_of(spark, folder)
    return reduce(DataFrame.unionByName, [
        sales.vocabulary(fact, c).select(F.lit(c).alias("vocabulary"), "term")
        for c in ("product", "category", "region")])


def _listing(df: DataFrame, section: str, label: str, value: str | None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.col(label).cast("string").alias("label"),
        (F.col(value) if value else F.lit(None)).cast("double").alias("value"))


@register("A24_data_context", query(FRAME, " union all ".join(
    [f"select 'top_{c}' as section, {c} as label, v as value from (select {c}, "
     f"cast(sum(cast(sales as decimal(18,4))) as double) as v from frame group by {c} "
     f"order by v desc, {c} limit 10)"
     for c in ("product", "category", "region")]
    + [f"select distinct 'known_{c}', {c}, cast(null as double) from frame"
       for c in ("product", "category", "region")]
    + ["select 'monthly_sales', strftime(date, '%Y-%m'), "
       "cast(sum(cast(sales as decimal(18,4))) as double) from frame group by 2"]
    + [f"select 'product_{m}', product, median({m}) from frame group by product"
       for m in ("price", "quantity")])))
def a24(spark, folder):
    frame = cleaning.model_frame(written_fact(spark, folder), AS_OF)
    exact = frame.withColumn("sales", F.col("sales").cast("decimal(18,4)"))
    context = sales.data_context(exact)
    parts = []
    for c in ("product", "category", "region"):
        parts += [_listing(context[f"top_{c}"], f"top_{c}", c, "sales"),
                  _listing(context[f"known_{c}"], f"known_{c}", "term", None)]
    parts.append(_listing(context["monthly_sales"], "monthly_sales", "month", "sales"))
    dimension = context["product_dimension"]
    parts += [_listing(dimension, f"product_{m}", "product", m) for m in ("price", "quantity")]
    return reduce(DataFrame.unionByName, parts)


def _merged_state(spark, folder):
    """The state of two halves of the fact: one published, the other added to it, read back."""
    fact = written_fact(spark, folder)
    low = F.substring("h", 1, 1) < "7"
    root = new_path(spark, "state")
    state.add_part(spark, root, state.state_of(fact.where(low)))
    state.add_part(spark, root, state.state_of(fact.where(~low)))
    return sinks.read_published(spark, root)


@register("W1_merged_entities", query(FACT, " union all ".join(
    f"select '{c}' as entity, {c} as value, count(*) as rows, cast(sum(sales) as double) as sales, "
    f"cast(sum(quantity) as double) as quantity from fact group by {c}" for c in ("product", "category", "region"))))
def w1_entities(spark, folder):
    merged = _merged_state(spark, folder)["entities"]
    return merged.select("entity", "value", "rows", F.round("sales", 4).alias("sales"), "quantity")


@register("W1_merged_insights", query(FACT, """
select 'monthly_sales' as section, strftime(date, '%Y-%m') as label, cast(sum(sales) as double) as value
from fact where date is not null group by 2
union all select 'customers', 'active_customers', cast(count(distinct customer_id) as double) from fact
union all select 'correlations', 'price/sales', round(corr(cast(price as double), cast(sales as double)), 6) from fact
union all select 'correlations', 'quantity/sales', round(corr(quantity, cast(sales as double)), 6) from fact
union all select 'quantity', cast(cast(floor(quantity) as bigint) as varchar), cast(count(*) as double) from fact
  where quantity is not null group by 2"""))
def w1_insights(spark, folder):
    """Insight tables from the state of two halves, against those of the whole."""
    tables = state.insights_of(_merged_state(spark, folder))
    parts = [
        tables["monthly_sales"].select(F.lit("monthly_sales").alias("section"), F.col("month").alias("label"),
                                       F.round("sales", 4).alias("value")),
        tables["customer_kpis"].select(F.lit("customers"), F.lit("active_customers"),
                                       F.col("active_customers").cast("double")),
        tables["correlations"].where("y = 'sales' and x <> 'sales'").select(
            F.lit("correlations"), F.concat_ws("/", "x", "y"), F.round("correlation", 6)),
        tables["histograms"].where("metric = 'quantity'").select(
            F.lit("quantity"), F.col("bin_start").cast("long").cast("string"), F.col("count").cast("double"))]
    return reduce(DataFrame.unionAll, parts)
