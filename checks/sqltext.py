"""SQL building blocks for the oracles: the fact, dirty and cleaned tables as CTEs."""

from __future__ import annotations

FACT = """
places as (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey),
fact as (
  select o_orderkey as order_id, o_custkey as customer_id, o_orderdate as date,
    p_name as product, p_type as category, r_name as region, l_quantity as quantity,
    cast(cast(cast((cast(round(l_extendedprice*100) as bigint)
        - cast(round(l_extendedprice*100) as bigint) % cast(l_quantity as bigint))
        / cast(l_quantity as bigint) as bigint) as decimal(16,0))
        * cast(0.01 as decimal(3,2)) as decimal(18,2)) as price,
    l_discount + 0.0 as discount,
    cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))
        as decimal(18,4)) as sales,
    md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
        cast(l_partkey as varchar), cast(l_suppkey as varchar),
        cast(cast(l_quantity as int) as varchar),
        cast(cast(round(l_extendedprice*100) as bigint) as varchar))) as h
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join places on c_nationkey = n_nationkey join part on l_partkey = p_partkey)"""

EVENTS = """
event_fact as (
  select event_id as order_id, user_id as customer_id, ts as date, event_type as category,
    value as sales from events)"""

DIRTY = FACT + """,
dirty_once as (
  select order_id, customer_id,
    case when substr(h,1,2) < '05' then null
         else strftime(date, '%Y-%m-%d') end as date,
    case when substr(h,3,2) < '08' then concat('  ', upper(product), ' ')
         else product end as product,
    case when substr(h,5,2) < '06' then null when substr(h,5,2) < '08' then 'nan'
         else category end as category,
    case when substr(h,7,2) < '06' then null
         when substr(h,7,2) < '13' then concat('  ', upper(region), '  ')
         else region end as region,
    case when substr(h,9,2) < '08' then null when substr(h,9,2) < '0b' then -quantity
         else quantity end as quantity,
    case when substr(h,11,2) < '07' then null
         when substr(h,11,2) < '11' then concat('$', cast(price as varchar))
         when substr(h,11,2) < '14' then concat('(', cast(price as varchar), ')')
         else cast(price as varchar) end as price,
    discount,
    case when substr(h,13,2) < '05' then null
         when substr(h,13,2) < '0f' then concat('$', cast(sales as varchar))
         else cast(sales as varchar) end as sales,
    h
  from fact),
dirty as (
  select * from dirty_once union all select * from dirty_once where substr(h,15,2) < '05')"""


def cleaned_text(x: str) -> str:
    return f"nullif(nullif(nullif(trim({x}), ''), 'nan'), 'None')"


def titled(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), ' ')")


def number(x: str) -> str:
    return (rf"try_cast(regexp_replace(regexp_replace({x}, '\(([^)]+)\)', '-\1', 'g'), "
            rf"'[^0-9.\-]', '', 'g') as double)")


def mode_of(source: str, column: str, default: str = "Unknown") -> str:
    return (f"coalesce((select {column} from (select {column}, count(*) as n from {source} "
            f"where {column} is not null group by {column}) order by n desc, {column} limit 1), "
            f"'{default}')")


def median_time(source: str, column: str = "date") -> str:
    return (f"(select make_timestamp(cast(trunc(median(epoch_us({column}))) as bigint)) "
            f"from {source})")


# C1-C4 on the dirty table.
TYPED = DIRTY + f""",
typed as (
  select order_id, customer_id, try_cast({cleaned_text('date')} as timestamp) as date,
    {titled(cleaned_text('product'))} as product, {titled(cleaned_text('category'))} as category,
    {titled(cleaned_text('region'))} as region, quantity, {number('price')} as price,
    discount, {number('sales')} as sales, h
  from dirty)"""

# C5-C10.
DEDUPED = TYPED + """,
nonempty as (
  select order_id, customer_id, date, product, category, region,
    case when quantity >= 0 then quantity end as quantity,
    case when price >= 0 then price end as price,
    case when discount >= 0 then discount end as discount,
    coalesce(sales, quantity * price) as sales, h
  from typed),
deduped as (select distinct * from nonempty)"""

# C11-C13.
CLEAN = DEDUPED + f""",
clean as (
  select order_id, customer_id, coalesce(date, {median_time('deduped')}) as date,
    coalesce(product, {mode_of('deduped', 'product')}) as product,
    coalesce(category, {mode_of('deduped', 'category')}) as category,
    coalesce(region, {mode_of('deduped', 'region')}) as region,
    coalesce(quantity, (select median(quantity) from deduped)) as quantity,
    coalesce(price, (select median(price) from deduped)) as price,
    coalesce(discount, (select median(discount) from deduped)) as discount,
    coalesce(sales, (select median(sales) from deduped)) as sales, h
  from deduped)"""

# C20 on the fact: every role is present and complete, so only counts and bounds remain.
FRAME = FACT + """,
counts as (select customer_id, count(*) as n from fact group by customer_id),
frame as (
  select f.*, cast(month(date) as int) as month, cast(isodow(date) - 1 as int) as day_of_week,
    cast(hour(date) as int) as hour, case when isodow(date) > 5 then 1 else 0 end as is_weekend,
    cast(n as double) as customer_purchase_count
  from (select order_id, customer_id, date, product, category, region,
      greatest(quantity, 1.0) as quantity, greatest(cast(price as double), 0.01) as price,
      discount, greatest(cast(sales as double), 0.01) as sales, h from fact) f
    join counts using (customer_id))"""


def query(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body.strip()}"
