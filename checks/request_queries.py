"""Requests, over one message per order line."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cleaning_queries import AS_OF, day_time, frame_of
from checks.insight_queries import fact_of, rounded
from checks.model_queries import FEATURES, split_frame
from checks.registry import register, written_fact
from checks.sqltext import EVENTS, FACT, FRAME, query
from tallyhouse.operators import cleaning, modeling, requests, sales
from tallyhouse.plans import training
from tallyhouse.session import kept, released, settled
from tallyhouse.sources import warehouse

_MESSAGES = """,
messages as (select h as msg_id, case substr(h,3,1)
    when '0' then 'Show model metrics' when '1' then 'What are the top products?'
    when '2' then 'What are the top regions?' when '3' then 'help'
    when '4' then concat('Tell me about ', category, ' in ', region, ' region')
    when '5' then concat('Estimate sales for product ', product, ' in ', region, ' region')
    when '6' then 'Show the monthly trend'
    when '7' then concat('Qty = ', cast(cast(quantity as int) as varchar), ' unit  price: $',
      cast(price as varchar), ' hour 14 purchase count 7')
    when '8' then 'Give me a dataset overview' when '9' then 'hello' when 'a' then '   '
    else concat('Predict sales for quantity ', cast(cast(quantity as int) as varchar), ' price ',
      cast(price as varchar), ' category ', category, ' region ', region, ' date ',
      strftime(date, '%Y-%m-%d')) end as text
  from fact)"""


def _known_sql(role: str) -> str:
    return f""",
{role}_found as (select msg_id, first(term order by length(term) desc, term) as {role}
  from messages join (select distinct {role} as term from fact)
    on contains(lower(text), lower(term)) group by msg_id)"""


MESSAGES = FACT + _MESSAGES
_MATCHED = "".join(map(_known_sql, requests.KNOWN)) + """,
matched as (select m.msg_id, text, product, category, region from messages m
  left join product_found p on p.msg_id = m.msg_id
  left join category_found c on c.msg_id = m.msg_id
  left join region_found r on r.msg_id = m.msg_id)"""
MATCHED = MESSAGES + _MATCHED


def _any(words) -> str:
    return "(" + " or ".join(f"contains(lower(trim(text)), '{w}')" for w in words) + ")"


def _cases(rules) -> str:
    return " ".join(f"when {_any(words)} then '{intent}'" for intent, words in rules)


_EMPTY = "when trim(text) = '' then 'empty'"
_DEFAULT = (f"case {_EMPTY} when {_any(requests.PREDICT_VERBS)} then 'predict' "
            f"{_cases(requests.NOTEBOOK_RULES)} else 'predict' end")
_NOTEBOOK = f"case {_EMPTY} {_cases(requests.NOTEBOOK_RULES)} else 'predict' end"
_DASHBOARD = (f"case {_EMPTY} {_cases(requests.DASHBOARD_FIRST)} "
              + " ".join(f"when {c} is not null then 'segment_{c}'" for c in requests.KNOWN)
              + f" {_cases(requests.DASHBOARD_LAST)} else 'fallback' end")


def messages_of(spark, folder):
    return warehouse.request_messages(fact_of(spark, folder))


def matched_of(fact, case_terms=requests.CASE_TERMS, cells=None):
    words = {c: sales.vocabulary(fact if cells is None else cells, c) for c in requests.KNOWN}
    return requests.match_known(warehouse.request_messages(fact), words, case_terms)


def matched_alone(spark, folder, **options):
    """The matched messages; the fact goes when they are written."""
    with released(spark):
        fact = written_fact(spark, folder)
        with kept():
            return matched_of(fact, **options)


for _ruleset, _sql in (("default", _DEFAULT), ("notebook", _NOTEBOOK)):
    register(f"T1_route_{_ruleset}", query(
        MESSAGES, f"select msg_id, {_sql} as intent from messages"))(
        lambda spark, folder, ruleset=_ruleset: requests.route(
            messages_of(spark, folder), ruleset).select("msg_id", "intent"))


@register("T2_route_dashboard", query(MATCHED, f"select msg_id, {_DASHBOARD} as intent from matched"))
def t2(spark, folder):
    return requests.route(matched_alone(spark, folder), "dashboard").select("msg_id", "intent")


@register("T3_match_terms", query(MATCHED, "select * from matched"))
def t3(spark, folder):
    return matched_alone(spark, folder)


@register("T3_match_terms_by_join", query(MATCHED, "select * from matched"))
def t3_join(spark, folder):
    """The path for vocabularies too large for one expression, forced at this size."""
    return matched_alone(spark, folder, case_terms=0)


def _number_sql(labels) -> str:
    found = ", ".join(
        "nullif(regexp_extract(text, '(?i)" + r"\s+".join(label.split())
        + r"\s*[:=]?\s*\$?(-?\d+(?:\.\d+)?)', 1), '')" for label in labels)
    return f"try_cast(coalesce({found}) as double)"


NUMBERS = {c: (f"round_even({_number_sql(labels)}, 0)" if c in requests.WHOLE_NUMBERS
               else _number_sql(labels)) for c, labels in requests.NUMBER_LABELS.items()}


@register("T4_extract_numbers", query(MESSAGES, "select msg_id, " + ", ".join(
    f"{sql} as {c}_given" for c, sql in NUMBERS.items()) + " from messages"))
def t4(spark, folder):
    return requests.extract_numbers(messages_of(spark, folder)).drop("text")


_FOUND = r"regexp_extract(text, '\b(20\d{2}-\d{2}-\d{2})\b', 1)"
_DATE = f"try_strptime(nullif({_FOUND}, ''), '%Y-%m-%d')"
_NOTE = (f"case when {_DATE} is not null then concat('Used date ', {_FOUND}, "
         f"' to derive time features.') when {_FOUND} = '' and contains(lower(text), 'date') "
         f"then '{requests.NO_DATE_NOTE}' end")


@register("T5_extract_date", query(MESSAGES, f"""
select msg_id, {_DATE} as date_given, {_NOTE} as date_note from messages"""))
def t5(spark, folder):
    return day_time(requests.extract_date(messages_of(spark, folder)).drop("text"), "date_given")


def _common(column: str) -> str:
    return (f"(select {column} from frame group by {column} "
            f"order by count(*) desc, {column} limit 1)")


DEFAULTS = f"""
select {_common('category')} as category, {_common('region')} as region,
  cast(trunc(median(month)) as bigint) as month,
  cast(trunc(median(day_of_week)) as bigint) as day_of_week, cast(0 as bigint) as hour,
  cast(case when median(day_of_week) >= 5 then 1 else 0 end as bigint) as is_weekend,
  median(customer_purchase_count) as customer_purchase_count, median(quantity) as quantity,
  median(price) as price from frame"""

DEFAULTS_NOTEBOOK = f"""
select {_common('category')} as category, {_common('region')} as region,
  month(middle) as month, isodow(middle) - 1 as day_of_week, hour(middle) as hour,
  cast(case when isodow(middle) > 5 then 1 else 0 end as bigint) as is_weekend,
  trunc(n) as customer_purchase_count, q as quantity, p as price
from (select make_timestamp(cast(trunc(median(epoch_us(date))) as bigint)) as middle,
  median(customer_purchase_count) as n, median(quantity) as q, median(price) as p from frame)"""


for _profile, _sql in (("dashboard", DEFAULTS), ("notebook", DEFAULTS_NOTEBOOK)):
    register(f"T6_feature_defaults_{_profile}", query(FRAME, _sql))(
        lambda spark, folder, profile=_profile: spark.createDataFrame(
            [requests.feature_defaults(frame_of(spark, folder), profile)]))


def _scenarios_sql(defaults: str) -> str:
    numbers = ", ".join(f"{sql} as {c}_given" for c, sql in NUMBERS.items())
    return FRAME + _MESSAGES + _MATCHED + f""",
dimension as (select product, category as usual_category, price as usual_price,
    quantity as usual_quantity from (
  select product, category, row_number() over (partition by product
    order by count(*) desc, category) as r from frame group by 1, 2)
  join (select product, median(price) as price, median(quantity) as quantity
    from frame group by 1) using (product) where r = 1),
defaults as ({defaults}),
given as (select *, {numbers}, {_DATE} as day, {_NOTE} as date_note from matched),
scenarios as (select g.msg_id, g.text, g.product,
  coalesce(quantity_given, usual_quantity, d.quantity) as quantity,
  coalesce(price_given, usual_price, d.price) as price,
  coalesce(g.category, usual_category, d.category) as category,
  coalesce(g.region, d.region) as region,
  cast(coalesce(month(day), d.month) as int) as month,
  cast(coalesce(isodow(day) - 1, d.day_of_week) as int) as day_of_week,
  cast(coalesce(hour(day), hour_given, d.hour) as int) as hour,
  cast(coalesce(case when day is not null then case when isodow(day) > 5 then 1 else 0 end end,
    d.is_weekend) as int) as is_weekend,
  coalesce(customer_purchase_count_given, d.customer_purchase_count) as customer_purchase_count,
  (case when g.product is not null then 3 else 0 end)
    + (case when g.category is not null then 1 else 0 end)
    + (case when g.region is not null then 1 else 0 end)
    + (case when quantity_given is not null then 1 else 0 end)
    + (case when price_given is not null then 1 else 0 end)
    + (case when customer_purchase_count_given is not null then 1 else 0 end)
    + (case when hour_given is not null then 1 else 0 end)
    + (case when day is not null then 1 else 0 end) as signal_count,
  concat_ws(chr(10), 'Detected product ''' || g.product || '''.', date_note) as notes
  from given g left join dimension m on m.product = g.product, defaults d)"""


def scenarios_from(fact, frame, profile="dashboard"):
    """Scenarios read the matched messages and the usual values of products, which are written;
    neither the fact nor the frame."""
    return requests.build_scenarios(
        matched_of(fact), sales.product_dimension(frame),
        requests.feature_defaults(frame, profile), profile)


def fact_and_frame(spark, folder):
    """What both the models and the requests start from, made once."""
    fact = written_fact(spark, folder)
    return fact, cleaning.model_frame(fact, AS_OF)


def scenarios_of(spark, folder, profile="dashboard"):
    return scenarios_and_model(spark, folder, None, profile)[0]


def scenarios_and_model(spark, folder, fit, profile="dashboard"):
    """Scenarios, and the model that ``fit`` makes of the frame's training rows; the tables that
    both start from are deleted when neither needs them any more."""
    with released(spark):
        fact, frame = fact_and_frame(spark, folder)
        model = None
        if fit:
            with released(spark):
                model = fit(frame)
        with kept():
            return scenarios_from(fact, frame, profile), model


def baseline_of(frame):
    return modeling.fit_baseline(split_frame(frame)[0])


for _profile, _sql in (("dashboard", DEFAULTS), ("notebook", DEFAULTS_NOTEBOOK)):
    register(f"T7_scenarios_{_profile}", query(
        _scenarios_sql(_sql), "select * from scenarios"))(
        lambda spark, folder, profile=_profile: scenarios_of(spark, folder, profile))


@register("T8_score_scenarios", query(_scenarios_sql(DEFAULTS), """
select s.*, round(start + slope * quantity, 3) as prediction from scenarios s,
  (select regr_slope(sales, quantity) as slope, regr_intercept(sales, quantity) as start
   from frame where substr(md5(h), 1, 2) >= '33') where signal_count > 0"""))
def t8(spark, folder):
    """A line over one feature, so that SQL has the same."""
    def line(frame):
        return modeling.fit_linear(split_frame(frame, "quantity")[0].select("quantity", "sales"))

    scenarios, model = scenarios_and_model(spark, folder, line)
    return rounded(requests.score_scenarios(scenarios, model), "prediction", digits=3)


@register("T8_score_baseline", query(_scenarios_sql(DEFAULTS), """
select *, (select median(sales) from frame where substr(md5(h), 1, 2) >= '33') as prediction
from scenarios where signal_count > 0"""))
def t8_baseline(spark, folder):
    return requests.score_scenarios(*scenarios_and_model(spark, folder, baseline_of))


def _value(x: str) -> str:
    return (f"case when abs({x} - round({x})) < 1e-9 then format('{{:,}}', "
            f"cast(round({x}) as bigint)) else format('{{:,.2f}}', {x}) end")


_SHOWN = {c: c if c in modeling.CATEGORICAL else _value(f"cast({c} as double)")
          for c in modeling.FEATURES}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@register("T8_prediction_answers", query(_scenarios_sql(DEFAULTS), f"""
select msg_id, 'predict' as intent, concat_ws(chr(10) || chr(10),
  'Predicted sales: $' || format('{{:,.2f}}', (select median(sales) from frame
    where substr(md5(h), 1, 2) >= '33')), 'Model: Baseline Median',
  'Inputs used:' || chr(10) || concat_ws(chr(10), {', '.join(
      f"'{c}: ' || {sql}" for c, sql in _SHOWN.items())}),
  'Notes:' || chr(10) || '- ' || case when notes = '' then '{requests.DEFAULTS_NOTE}'
    else replace(notes, chr(10), chr(10) || '- ') end) as answer
from scenarios where signal_count > 0
union all select msg_id, 'needs_input', {_quoted(requests.STATIC_ANSWERS["needs_input"])}
from scenarios where signal_count = 0"""))
def t8_answers(spark, folder):
    scenarios, model = scenarios_and_model(spark, folder, baseline_of)
    scored = requests.score_scenarios(scenarios, model)
    return requests.prediction_answers(scored, modeling.BASELINE).unionByName(
        requests.refusals(scenarios))


def _money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', cast({x} as double))"


def _top_text(column: str, title: str, lines: int = 10) -> str:
    return f"""(select '{title}' || chr(10) || string_agg({column} || ': ' || {_money('s')},
      chr(10) order by s desc, {column}) from (select {column}, cast(sum(sales) as double) as s
      from fact group by {column} order by s desc, {column} limit {lines}))"""


def _leaders_text(by: str, of: str) -> str:
    return f"""(select segment, string_agg({of} || ': ' || {_money('s')}, chr(10)
        order by s desc, {of}) as top_{of} from (
      select lower({by}) as segment, {of}, cast(sum(sales) as double) as s,
        row_number() over (partition by lower({by}) order by sum(sales) desc, {of}) as r
      from fact group by 1, 2) where r <= 5 group by segment)"""


def _segments_sql(by: str) -> str:
    others = [of for of in ("product", "region") if of != by]
    tops = " ".join(f"join {_leaders_text(by, of)} using (segment)" for of in others)
    texts = " || ".join(f"chr(10) || 'Top {of}s:' || chr(10) || top_{of}" for of in others)
    return f"""select 'segment_{by}:' || segment as topic,
  '{by.title()} summary for ' || segment || chr(10) || 'Rows: ' || format('{{:,}}', n) || chr(10)
  || 'Total sales: ' || {_money('total')} || chr(10) || 'Average quantity: '
  || format('{{:,.2f}}', q) || chr(10) || 'Average price: ' || {_money('p')} || {texts} as answer
from (select lower({by}) as segment, count(*) as n, sum(sales) as total,
    sum(quantity) / count(quantity) as q,
    cast(sum(price) as double) / count(price) as p from fact group by 1) {tops}"""


_FIXED = " ".join(f"when '{k}' then {_quoted(v)}" for k, v in requests.STATIC_ANSWERS.items()
                  if k != "metrics")

ANSWERS = FEATURES + _MESSAGES + _MATCHED + f""",
routed as (select msg_id, product, category, region, {_DASHBOARD} as intent from matched),
segments as ({' union all '.join(map(_segments_sql, requests.KNOWN))}),
asked as (select msg_id, intent, case intent
    when 'segment_product' then 'segment_product:' || lower(product)
    when 'segment_category' then 'segment_category:' || lower(category)
    when 'segment_region' then 'segment_region:' || lower(region) end as topic
  from routed where intent <> 'predict'),
book as (select
  (select 'Rows: ' || format('{{:,}}', count(*)) || chr(10) || 'Columns: 11' || chr(10)
    || 'Total sales: ' || {_money('sum(sales)')} || chr(10) || 'Date range: '
    || strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') || chr(10)
    || 'Categories: ' || count(distinct category) || chr(10)
    || 'Regions: ' || count(distinct region) from fact) as overview,
  {_top_text('product', 'Top products')} as top_products,
  {_top_text('region', 'Top regions')} as top_regions,
  (select 'Seasonality snapshot' || chr(10) || string_agg(m || ': ' || {_money('s')}, chr(10)
     order by m) from (select strftime(date, '%Y-%m') as m, sum(sales) as s from fact
     group by 1 order by 1 limit 12)) as seasonality,
  {_top_text('product', 'Top products', 5)} as five_products,
  {_top_text('region', 'Top regions', 5)} as five_regions,
  (select 'Best model first' || chr(10) || 'Baseline Median mae='
     || format('{{:,.2f}}', avg(abs(sales - prediction))) || ' rmse='
     || format('{{:,.2f}}', sqrt(avg((sales - prediction) * (sales - prediction)))) || ' r2='
     || format('{{:,.2f}}', 1 - sum((sales - prediction) * (sales - prediction))
       / (var_pop(sales) * count(*))) from baseline) as metrics)"""


def tables_of(fact, cells):
    train, test = split_frame(cleaning.model_frame(fact, AS_OF))
    scored = modeling.scored_by({modeling.BASELINE: modeling.fit_baseline(train)}, test)
    top = {f"top_{c}": sales.top_of_cells(cells, c) for c in ("product", "region")}
    return {**top, "monthly_sales": sales.monthly_sales(fact),
            "overview": sales.overview_of(cells, len(fact.columns)),
            "leaderboard": modeling.leaderboard(modeling.regression_metrics(scored))}


def segments_of(cells):
    summaries = {c: sales.summary_of(cells, c) for c in requests.KNOWN}
    leaders = {(by, of): sales.leaders_of(cells, by, of)
               for by in requests.KNOWN for of in ("product", "region") if of != by}
    return requests.segment_book(summaries, leaders)


@register("T9_answers", query(ANSWERS, f"""
select msg_id, intent, coalesce(answer, case intent when 'overview' then overview
  when 'top_products' then top_products when 'top_regions' then top_regions
  when 'seasonality' then seasonality when 'metrics' then metrics {_FIXED} end) as answer
from asked left join segments using (topic), book"""))
def t9(spark, folder):
    return told_of(spark, folder, "dashboard", "dashboard")


def told_of(spark, folder, ruleset, profile):
    """The answers; of what they are made from, only the book and the topics stay."""
    with released(spark):  # cells and matched messages
        with released(spark):  # the fact
            fact = written_fact(spark, folder)
            with kept():
                cells = sales.label_cells(fact)
                with kept():
                    book = settled(spark, lambda: requests.answer_book(tables_of(fact, cells), profile), "book")
                routed = requests.route(matched_of(fact, cells=cells), ruleset)
        with kept():
            return requests.answers(routed, book, segments_of(cells))


@register("T9_answers_notebook", query(ANSWERS, f"""
select msg_id, intent, case intent when 'top_products' then five_products
  when 'top_regions' then five_regions when 'seasonality' then seasonality
  when 'metrics' then metrics {_FIXED} end as answer
from (select msg_id, {_NOTEBOOK} as intent from matched), book where intent <> 'predict'"""))
def t9_notebook(spark, folder):
    return told_of(spark, folder, "notebook", "notebook")


_BARE = EVENTS + """,
months as (select strftime(date, '%Y-%m') as m, sum(sales) as s from event_fact group by 1 order by 1 limit 12)"""


@register("T9_without_products", query(_BARE, f"""
select * from (values ('q1', 'top_products', {_quoted(requests.NOTHING["top_products"])}),
  ('q2', 'top_regions', {_quoted(requests.NOTHING["top_regions"])}),
  ('q4', 'predict', {_quoted(requests.NOTHING["predict"])})) t(msg_id, intent, answer)
union all select 'q3', 'seasonality', (select 'Seasonality snapshot' || chr(10) || string_agg(
  m || ': ' || {_money('s')}, chr(10) order by m) from months)"""))
def t9_bare(spark, folder):
    """A table with neither products nor regions, before any model is trained."""
    events = warehouse.event_fact(spark, folder).select("order_id", "date", "category", "sales")
    asked = ("What are the top products?", "best region?", "show the monthly trend", "predict quantity 3")
    messages = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked, 1)], "msg_id string, text string")
    frame = cleaning.model_frame(events, AS_OF).drop("region")
    result = training.TrainingResult(frame, None, None, {}, None, None)
    told, _ = training.answer_requests(messages, result)
    return told.select("msg_id", "intent", "answer")


_TALK = """with messages as (select conv_id as msg_id, text from conversations),
words as (select distinct regexp_extract(text, '\\w+', 0) as term from benchmark
  union select 'Http' union select 'HTTP' union select 'nowhere at all')"""


def _talk(spark, folder, case_terms):
    """Messages whose ids repeat (a conversation has many turns) and may be missing."""
    talk = spark.read.parquet(f"{folder}/conversations.parquet").select(
        F.col("conv_id").alias("msg_id"), "text")
    words = spark.read.parquet(f"{folder}/benchmark.parquet").select(
        F.regexp_extract("text", r"\w+", 0).alias("term"))
    more = spark.range(1).select(F.explode(F.array(*[
        F.lit(w) for w in ("Http", "HTTP", "nowhere at all")])).alias("term"))
    found = requests.match_terms(talk, words.union(more).distinct(), "term", case_terms)
    return found.groupBy("msg_id", "text", "term").count()


for _name, _terms in (("case", 10**6), ("join", 0)):
    register(f"T3_repeated_ids_by_{_name}", _TALK + """
select m.msg_id, m.text, (select w.term from words w where w.term <> ''
    and contains(lower(m.text), lower(w.term)) order by length(w.term) desc, w.term limit 1) as term,
  count(*) as count from messages m group by 1, 2, 3""")(
        lambda spark, folder, terms=_terms: _talk(spark, folder, terms))


_MANY = """with terms as (select distinct term from (
    select substr(md5(cast(p_partkey as varchar)), 1, 3 + p_partkey % 2) as term from part
    union all select concat(substr(md5(cast(p_partkey as varchar)), 1, 8), repeat('z', p_partkey % 40)) from part
    union all select concat(p_brand, ' ', cast(p_partkey as varchar)) from part)),
messages as (select o_orderkey as msg_id, concat('order ', md5(cast(o_orderkey as varchar)),
    md5(cast(o_custkey as varchar)), ' ', md5(cast(o_orderkey % 7 as varchar))) as text from orders)"""


@register("T3_many_terms_by_automaton", _MANY + """,
pieces as (select msg_id, unnest(range(1, length(text) + 1)) as i, text from messages),
hits as (select msg_id, term from pieces, (values (3), (4), (8)) v(n) join terms on term = substr(text, i, n))
select msg_id, (select h.term from hits h where h.msg_id = m.msg_id order by length(term) desc, term limit 1) as term
from messages m""")
def t3_many(spark, folder):
    """Terms of 3 to 48 characters, thousands of them, and no shuffle of the texts for them."""
    part = warehouse.table(spark, folder, "part")
    number = F.col("p_partkey")
    digest = F.md5(number.cast("string"))
    terms = part.select(F.explode(F.array(
        F.substring(digest, F.lit(1), (3 + number % 2).cast("int")),
        F.concat(F.substring(digest, 1, 8), F.repeat(F.lit("z"), (number % 40).cast("int"))),
        F.concat_ws(" ", "p_brand", number.cast("string")))).alias("term")).distinct()
    orders = warehouse.table(spark, folder, "orders")
    messages = orders.select(F.col("o_orderkey").alias("msg_id"), F.concat(
        F.lit("order "), F.md5(F.col("o_orderkey").cast("string")), F.md5(F.col("o_custkey").cast("string")),
        F.lit(" "), F.md5((F.col("o_orderkey") % 7).cast("string"))).alias("text"))
    return requests.match_terms(messages, terms, "term").select("msg_id", "term")
