"""C1-C22 and P1-P3."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import register, written_dirty, written_fact
from checks.sqltext import (CLEAN, DEDUPED, DIRTY, EVENTS, FACT, FRAME, TYPED, cleaned_text,
                            median_time, mode_of, number, query, titled)
from tallyhouse.functions import ranks, text
from tallyhouse.operators import cleaning, profiling
from tallyhouse.roles import column_kinds, date_shares, rename_normalized
from tallyhouse.session import kept, materialize, released
from tallyhouse.sources import warehouse

AS_OF = datetime(2024, 1, 1)


def frame_of(spark, folder):
    """The model frame of the fact, which is deleted when that is written."""
    with released(spark):
        fact = written_fact(spark, folder)
        with kept():
            return cleaning.model_frame(fact, AS_OF)


def day_time(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps without a zone, as the SQL side has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols or ("date",)})


@register("C1_clean_text", query(DIRTY, f"""
select h, {cleaned_text('product')} as product, {cleaned_text('category')} as category,
  {cleaned_text('region')} as region, {cleaned_text('price')} as price from dirty"""))
def c1(spark, folder):
    dirty = warehouse.retail_dirty(spark, folder)
    return cleaning.clean_text(dirty).select("h", "product", "category", "region", "price")


@register("C2_title_case", query(DIRTY, f"""
select h, {titled(cleaned_text('product'))} as product,
  {titled(cleaned_text('category'))} as category, {titled(cleaned_text('region'))} as region
from dirty"""))
def c2(spark, folder):
    dirty = cleaning.clean_text(warehouse.retail_dirty(spark, folder))
    return cleaning.title_case(dirty).select("h", "product", "category", "region")


@register("C3_numbers", query(DIRTY, f"""
select h, {number('price')} as price, {number('sales')} as sales, quantity, discount
from dirty"""))
def c3(spark, folder):
    dirty = warehouse.retail_dirty(spark, folder)
    return cleaning.numbers(dirty).select("h", "price", "sales", "quantity", "discount")


@register("C4_parse_dates", query(DIRTY, "select h, try_cast(date as timestamp) as date from dirty"))
def c4(spark, folder):
    return day_time(cleaning.parse_dates(warehouse.retail_dirty(spark, folder)).select("h", "date"))


@register("C5_derive_sales", query(TYPED, """
select h, coalesce(sales, quantity * price) as sales, quantity * price as computed from typed"""))
def c5(spark, folder):
    """Both cases: sales with gaps, and (as ``computed``) no sales column at all."""
    typed = cleaning.numbers(warehouse.retail_dirty(spark, folder))
    renamed = typed.withColumnRenamed("sales", "given")
    computed = cleaning.derive_sales(renamed).withColumnRenamed("sales", "computed")
    return cleaning.derive_sales(computed.withColumnRenamed("given", "sales")).select(
        "h", "sales", "computed")


@register("C6_derive_price", query(TYPED, """
select h, case when quantity <> 0 then sales / quantity end as price from typed"""))
def c6(spark, folder):
    typed = cleaning.numbers(warehouse.retail_dirty(spark, folder)).drop("price")
    return cleaning.derive_price(typed).select("h", "price")


@register("C7_derive_quantity", query(TYPED, """
select h, case when price <> 0 then sales / price end as quantity from typed"""))
def c7(spark, folder):
    typed = cleaning.numbers(warehouse.retail_dirty(spark, folder)).drop("quantity")
    return cleaning.derive_quantity(typed).select("h", "quantity")


@register("C8_null_negatives", query(TYPED, """
select h, case when quantity >= 0 then quantity end as quantity,
  case when price >= 0 then price end as price,
  case when discount >= 0 then discount end as discount from typed"""))
def c8(spark, folder):
    typed = cleaning.numbers(warehouse.retail_dirty(spark, folder))
    return cleaning.null_negatives(typed).select("h", "quantity", "price", "discount")


@register("C9_drop_empty_rows", query(DIRTY, f"""
select * from (select {cleaned_text('category')} as category, {cleaned_text('region')} as region
  from dirty) where coalesce(category, region) is not null"""))
def c9(spark, folder):
    """Two columns with gaps of their own, so that some rows have nothing."""
    dirty = warehouse.retail_dirty(spark, folder).select("category", "region")
    return cleaning.drop_empty_rows(cleaning.clean_text(dirty))


@register("C10_dedupe", query(DIRTY, "select distinct * from dirty"))
def c10(spark, folder):
    return cleaning.dedupe(warehouse.retail_dirty(spark, folder))


@register("C11_impute_median", query(TYPED, """
select h, coalesce(quantity, (select median(quantity) from typed)) as quantity,
  coalesce(price, (select median(price) from typed)) as price,
  coalesce(sales, (select median(sales) from typed)) as sales from typed"""))
def c11(spark, folder):
    typed = cleaning.numbers(warehouse.retail_dirty(spark, folder))
    measures = ["quantity", "price", "sales"]
    return cleaning.impute_median(typed.select("h", *measures), measures)


@register("C12_impute_median_ts", query(TYPED, f"""
select h, coalesce(date, {median_time('typed')}) as date from typed"""))
def c12(spark, folder):
    typed = cleaning.parse_dates(warehouse.retail_dirty(spark, folder)).select("h", "date")
    return day_time(cleaning.impute_median_ts(typed, ["date"], AS_OF))


@register("C13_impute_mode", query(TYPED, f"""
select h, coalesce(product, {mode_of('typed', 'product')}) as product,
  coalesce(category, {mode_of('typed', 'category')}) as category,
  coalesce(region, {mode_of('typed', 'region')}) as region from typed"""))
def c13(spark, folder):
    labels = list(cleaning.LABELS)
    dirty = warehouse.retail_dirty(spark, folder).select("h", *labels)
    cased = cleaning.title_case(cleaning.clean_text(dirty, labels))
    return cleaning.impute_mode(cased, labels)


@register("C14_keep_positive", query(TYPED, """
select h, quantity, price from typed where quantity > 0 and price > 0"""))
def c14(spark, folder):
    typed = cleaning.numbers(warehouse.retail_dirty(spark, folder))
    return cleaning.keep_positive(typed).select("h", "quantity", "price")


def _rules_sql(column: str) -> str:
    cases = " ".join(
        "when " + " or ".join(f"contains(lower({column}), '{w}')" for w in words)
        + f" then '{name}'" for name, words in text.CATEGORY_RULES.items())
    return f"case {cases} else 'Other' end"


@register("C15_categorize", f"""
select doc_id, {_rules_sql('text')} as category from documents""")
def c15(spark, folder):
    documents = warehouse.table(spark, folder, "documents")
    return documents.select("doc_id", text.categorize(F.col("text")).alias("category"))


@register("C16_role_defaults", """
with event_fact as (select event_type as product, value as sales, ts as date from events)
select product, sales, date, 1.0::double as quantity, 1.0::double as price,
  'Unknown' as region, product as category from event_fact""")
def c16(spark, folder):
    events = warehouse.event_fact(spark, folder).select(
        F.col("category").alias("product"), "sales", "date")
    return day_time(cleaning.fill_role_defaults(events, AS_OF))


@register("C16_order_numbers", """
select product, sales, date, 'Unknown' as customer_id,
  row_number() over (order by event_id) as order_id, event_id
from (select event_id, event_type as product, value as sales, ts as date from events)""")
def c16_numbers(spark, folder):
    events = warehouse.event_fact(spark, folder).select(
        F.col("order_id").alias("event_id"), F.col("category").alias("product"), "sales", "date")
    return day_time(cleaning.fill_role_defaults(events, AS_OF, "model"))


@register("C17_time_features", query(EVENTS, """
select order_id, cast(month(date) as int) as month, cast(isodow(date) - 1 as int) as day_of_week,
  cast(hour(date) as int) as hour, case when isodow(date) > 5 then 1 else 0 end as is_weekend
from event_fact"""))
def c17(spark, folder):
    events = cleaning.time_features(warehouse.event_fact(spark, folder))
    return events.select("order_id", "month", "day_of_week", "hour", "is_weekend")


@register("C18_customer_purchase_count", query(FACT, """
select h, customer_id, count(*) over (partition by customer_id) as customer_purchase_count
from fact"""))
def c18(spark, folder):
    fact = written_fact(spark, folder).select("h", "customer_id")
    return cleaning.customer_purchase_count(fact)


@register("C19_clip_lower", query(TYPED, """
select h, case when quantity is not null then greatest(quantity, 1.0) end as quantity,
  case when price is not null then greatest(price, 0.01) end as price,
  case when sales is not null then greatest(sales, 0.01) end as sales from typed"""))
def c19(spark, folder):
    typed = cleaning.numbers(warehouse.retail_dirty(spark, folder))
    return cleaning.clip_lower(typed).select("h", "quantity", "price", "sales")


@register("C20_model_frame", query(FRAME, "select * from frame"))
def c20(spark, folder):
    return day_time(cleaning.model_frame(written_fact(spark, folder), AS_OF))


@register("C21_prepare", query(CLEAN, "select * from clean"))
def c21(spark, folder):
    return day_time(cleaning.prepare(warehouse.retail_dirty(spark, folder), AS_OF).cleaned)


MODEL_ROWS = TYPED.replace("typed as (", "raw_typed as (") + f""",
standard as (
  select distinct order_id, customer_id, try_cast(trim(date) as timestamp) as date,
    trim(product) as product, coalesce(trim(category), 'Other') as category,
    trim(region) as region, quantity, {number('price')} as price, discount,
    coalesce({number('sales')}, quantity * {number('price')}) as sales, h from dirty),
signed as (
  select order_id, customer_id, date, {titled(cleaned_text('product'))} as product,
    {titled(cleaned_text('category'))} as category, {titled(cleaned_text('region'))} as region,
    case when quantity >= 0 then quantity end as quantity,
    case when price >= 0 then price end as price, discount,
    case when sales >= 0 then sales end as sales, h from standard),
typed as (select * replace (coalesce(sales, quantity * price) as sales) from signed),
filled as (
  select order_id, customer_id, coalesce(date, {median_time('typed')}) as date,
    coalesce(product, {mode_of('typed', 'product')}) as product,
    coalesce(category, {mode_of('typed', 'category')}) as category,
    coalesce(region, {mode_of('typed', 'region')}) as region,
    coalesce(quantity, (select median(quantity) from typed)) as quantity,
    coalesce(price, (select median(price) from typed)) as price, discount,
    coalesce(sales, (select median(sales) from typed)) as sales, h from typed)"""


@register("C22_prepare_for_model", query(MODEL_ROWS, """
select *, cast(month(date) as int) as month, cast(isodow(date) - 1 as int) as day_of_week,
  cast(hour(date) as int) as hour, case when isodow(date) > 5 then 1 else 0 end as is_weekend,
  count(*) over (partition by customer_id) as customer_purchase_count
from filled where quantity > 0 and price > 0"""))
def c22(spark, folder):
    return day_time(cleaning.prepare_for_model(warehouse.retail_dirty(spark, folder), AS_OF))


#: Names as files have them, by the roles they stand for.
STRANGE_NAMES = {"order_id": "Order Number", "customer_id": "ClientID", "date": "InvoiceDate",
                 "product": " product-name ", "category": "Product Category", "region": "Market",
                 "quantity": "Qty", "price": "Unit Price", "discount": "Discount %",
                 "sales": "Total Revenue", "h": "h"}
STRANGE_MODEL_NAMES = {"order_id": "InvoiceNo", "customer_id": "CustomerID", "date": "InvoiceDate",
                       "product": "Description", "category": "Segment", "region": "Country",
                       "quantity": "QTY", "price": "UnitPrice", "discount": "discount",
                       "sales": "Amount", "h": "h"}


def _renamed(spark, folder, names):
    dirty = warehouse.retail_dirty(spark, folder)
    return dirty.toDF(*[names[c] for c in dirty.columns])


@register("SC2_prepare_strange_names", query(CLEAN, "select * from clean"))
def sc2(spark, folder):
    raw = _renamed(spark, folder, STRANGE_NAMES)
    return day_time(cleaning.prepare(raw, AS_OF).cleaned)


@register("SC3_prepare_for_model_strange_names", query(MODEL_ROWS, """
select *, cast(month(date) as int) as month, cast(isodow(date) - 1 as int) as day_of_week,
  cast(hour(date) as int) as hour, case when isodow(date) > 5 then 1 else 0 end as is_weekend,
  count(*) over (partition by customer_id) as customer_purchase_count
from filled where quantity > 0 and price > 0"""))
def sc3(spark, folder):
    raw = _renamed(spark, folder, STRANGE_MODEL_NAMES)
    return day_time(cleaning.prepare_for_model(raw, AS_OF))


@register("SC1_SC5_names_and_kinds", """
select * from (values ('date', 'datetime'), ('order_id', 'numeric'), ('order_id_2', 'numeric'),
  ('order_id_3', 'numeric'), ('unit_price', 'numeric'), ('column', 'categorical'))
  as t("column", kind)
where (select count(*) from orders) > 0""")
def sc1(spark, folder):
    """Names made alike are numbered; kinds go by type. Read from the orders."""
    orders = warehouse.table(spark, folder, "orders")
    named = rename_normalized(orders.select(
        F.col("o_orderdate").alias("Date"), F.col("o_orderkey").alias("Order ID"),
        F.col("o_custkey").alias("order-id"), F.col("o_orderkey").alias("OrderId"),
        F.col("o_totalprice").alias(" unitPrice"), F.col("o_orderpriority").alias("??")))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"))
        for kind, cols in column_kinds(named).items() for c in cols]))
    return named.limit(1).select(kinds.alias("k")).select("k.*")


DIRTY_COLUMNS = ("order_id customer_id date product category region quantity price discount "
                 "sales h").split()


def _missing_sql(source: str) -> str:
    return " + ".join(f"count(*) - count({c})" for c in DIRTY_COLUMNS).join(
        ["(select ", f" from {source})"])


QUALITY_ROWS = f"""
select 'rows_before' as metric, (select count(*) from dirty) as value union all
select 'columns_before', 11 union all
select 'missing_before', {_missing_sql('dirty')} union all
select 'duplicates_before', (select count(*) from dirty)
  - (select count(*) from (select distinct * from dirty)) union all
select 'rows_after', (select count(*) from clean) union all
select 'columns_after', 11 union all
select 'missing_after', {_missing_sql('clean')} union all
select 'duplicates_removed', (select count(*) from nonempty) - (select count(*) from deduped)
union all select 'dates_unparsed', (select count(*) from dirty
  where date is not null and try_cast(date as timestamp) is null)
union all select 'dates_ambiguous', (select count(*) from dirty where contains(date, '/'))"""


@register("P1_quality_summary", query(CLEAN, QUALITY_ROWS))
def p1(spark, folder):
    dirty = written_dirty(spark, folder)
    with released(spark):  # the summary needs what was counted, not the rows
        prepared = cleaning.prepare(dirty, AS_OF)
    return profiling.quality_summary(prepared)


@register("P1_imputations", query(DEDUPED, " union all ".join(
    [f"""select '{c}' as "column", 'median' as kind,
      cast((select median({c}) from deduped) as varchar) as value"""
     for c in ("price", "quantity")]
    + [f"select 'date', 'median', strftime({median_time('deduped')}, '%Y-%m-%d %H:%M:%S')"]
    + [f"select '{c}', 'mode', {mode_of('deduped', c)}" for c in ("category", "region")]
    + ["select 'sales', 'median', cast((select median(sales) from deduped) as varchar) "
       "where (select count(*) - count(sales) from deduped) > 0"])))
def p1_fills(spark, folder):
    prepared = cleaning.prepare(warehouse.retail_dirty(spark, folder), AS_OF)
    return profiling.imputations(prepared)


MISSING_ROWS = " union all ".join(
    f"""select '{c}' as "column", count(*) - count({c}) as missing_values from dirty
    having count(*) > count({c})""" for c in DIRTY_COLUMNS)


@register("P2_missing_columns", query(DIRTY, MISSING_ROWS))
def p2(spark, folder):
    return profiling.missing_columns(warehouse.retail_dirty(spark, folder))


_DTYPES = dict(zip(DIRTY_COLUMNS, ("bigint bigint string string string string double string "
                                   "double string string").split()))


@register("P3_column_profile", query(DIRTY, " union all ".join(
    f"""select '{c}' as "column", '{_DTYPES[c]}' as dtype, count(*) - count({c}) as missing,
    count(distinct {c}) as unique_values from dirty""" for c in DIRTY_COLUMNS)))
def p3(spark, folder):
    return profiling.column_profile(warehouse.retail_dirty(spark, folder))


@register("SC4_date_shares", query(DIRTY, " union all ".join(
    f"""select '{c}' as "column", round(cast(count(case when regexp_matches({c},
    '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') then try_cast({c} as timestamp) end) as double)
    / count({c}), 6) as parsed_share from dirty"""
    for c in ("date", "product", "category", "region", "price"))))
def sc4(spark, folder):
    dirty = warehouse.retail_dirty(spark, folder)
    shares = date_shares(dirty, ["date", "product", "category", "region", "price"])
    return shares.select("column", F.round("parsed_share", 6).alias("parsed_share"))


@register("C11_exact_medians", query(FACT, """
select median(quantity) as quantity, median(cast(price as double)) as price,
  median(cast(sales as double)) as sales from fact"""))
def exact_medians(spark, folder):
    """The selection by itself, over several columns at once."""
    fact = written_fact(spark, folder)
    found = ranks.exact_medians(fact, ["quantity", "price", "sales"])
    return spark.createDataFrame([found], "quantity double, price double, sales double")


_SPELLINGS = ("d/M/yyyy", "M/d/yy h:mm a", "MMMM d, yyyy", "d-MMM-yy", "M/d/yyyy H:mm", "d.M.yyyy")


@register("C4_date_spellings", query(FACT, "select h, " + ", ".join(
    f"strftime(date, '%Y-%m-%d %H:%M:%S') as d{i}" for i in range(len(_SPELLINGS))) + " from fact"))
def c4_spellings(spark, folder):
    """Every column is read in its own order of month and day."""
    fact = warehouse.retail_fact(spark, folder)
    written = fact.select("h", *[F.date_format("date", f).alias(f"d{i}")
                                 for i, f in enumerate(_SPELLINGS)])
    names = [f"d{i}" for i in range(len(_SPELLINGS))]
    read = cleaning.parse_dates(written, names)
    return read.select("h", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in names])


@register("P3_profile_with_nan", query("t as (select event_id, case when event_id % 7 = 0 "
                                       "then null else value end as value from events)", """
select 'event_id' as "column", 'bigint' as dtype, count(*) - count(event_id) as missing,
  count(distinct event_id) as unique_values from t union all
select 'value', 'double', count(*) - count(value), count(distinct value) from t"""))
def p3_nan(spark, folder):
    """NaN counts as missing, like NULL."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return profiling.column_profile(events.select("event_id", F.when(
        F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")))


@register("P3_merged_sketches", query(DIRTY, " union all ".join(
    f"""select '{c}' as "column", count(*) - count({c}) as missing, true as close from dirty""" for c in DIRTY_COLUMNS)))
def p3_sketches(spark, folder):
    """Sketches of two parts, written and merged: missing cells exact, distinct values within 2 %."""
    dirty = warehouse.retail_dirty(spark, folder)
    part = F.substring("h", 1, 1) < "8"
    stored = [materialize(profiling.column_sketches(dirty.where(side), name), "sketches")
              for name, side in (("low", part), ("high", ~part))]
    merged = profiling.merged_sketches(stored[0].unionByName(stored[1]))
    exact = profiling.column_profile(dirty).select("column", F.col("unique_values").alias("exact"))
    off = F.abs(F.col("unique_values") - F.col("exact")) / F.greatest("exact", F.lit(1))
    return merged.join(exact, "column").select("column", "missing", (off <= 0.02).alias("close"))
