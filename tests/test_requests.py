import pytest
from conftest import AS_OF, FOLDER
from pyspark.sql import functions as F

from checks.all_queries import QUERIES
from tallyhouse.operators import cleaning, joins, modeling, requests, sales
from tallyhouse.sources import warehouse

TERMS = {"product": ["Laptop", "Face Wash", "Wash", "Tea", "a"],
         "category": ["Electronics", "Home"], "region": ["West", "East", "North West"]}
EXAMPLES = {
    "Predict sales for quantity 3 price 120 category Electronics region West date 2025-04-01":
        ("predict", "predict", "segment_category"),
    "Estimate sales for product Laptop in East region": ("predict", "predict", "segment_product"),
    "Show model metrics": ("metrics", "metrics", "metrics"),
    "What are the top products?": ("top_products", "top_products", "top_products"),
    "What are the top regions?": ("top_regions", "top_regions", "top_regions"),
    "Tell me about Electronics in West region": ("predict", "predict", "segment_category"),
    "help": ("help", "help", "help"), "   ": ("empty",) * 3, "": ("empty",) * 3,
    "sales over time": ("seasonality",) * 3, "give me a summary": ("predict", "predict", "overview"),
    "hello": ("predict", "predict", "fallback"), "price 5": ("predict", "predict", "predict"),
    "predict the monthly trend": ("predict", "seasonality", "seasonality"),
}


def messages(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "msg_id string, text string")


def vocabularies(spark, terms=TERMS):
    return {k: spark.createDataFrame([(t,) for t in v], "term string") for k, v in terms.items()}


def by_id(df, *cols):
    return {r["msg_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_routes(spark):
    matched = requests.match_known(messages(spark, *EXAMPLES), {
        k: v for k, v in vocabularies(spark, {**TERMS, "product": ["Laptop"]}).items()})
    for position, ruleset in enumerate(("default", "notebook", "dashboard")):
        found = by_id(requests.route(matched, ruleset), "intent")
        assert [found[str(i)] for i in range(len(EXAMPLES))] == [e[position] for e in EXAMPLES.values()]


@pytest.mark.parametrize("case_terms,broadcast", [(100, 100), (0, 100), (0, 0)])
def test_longest_term_inside_the_text(spark, monkeypatch, case_terms, broadcast):
    monkeypatch.setattr(requests, "BROADCAST_TERMS", broadcast)
    texts = ["buy face wash now", "steam", "TEAM wash", "", None, "zzz", "ab", "xnorth westx", "LAPTOP!"]
    found = requests.match_known(messages(spark, *texts), vocabularies(spark), case_terms)

    def longest(terms, text):
        hits = [t for t in sorted(terms) if text and t.lower() in text.lower()]
        return max(hits, key=len) if hits else None

    expected = {str(i): tuple(longest(TERMS[k], t) for k in requests.KNOWN) for i, t in enumerate(texts)}
    assert by_id(found, *requests.KNOWN) == expected


def test_no_terms(spark):
    empty = spark.createDataFrame([("",)], "term string")
    for case_terms in (0, 100):
        found = requests.match_known(messages(spark, "x"), {"product": empty}, case_terms)
        assert found.first()["product"] is None


def test_numbers_and_dates(spark):
    df = messages(spark, "history count 4", "hour 7.5 qty 2", "date 1999-04-01", "on 2025-02-30 date",
                  "at 2025-04-05 and 2025-04-06", "no day")
    numbers = requests.extract_numbers(df, "notebook")
    assert by_id(numbers, "customer_purchase_count_given")["0"] == 4.0
    assert by_id(requests.extract_numbers(df), "customer_purchase_count_given")["0"] is None
    assert by_id(numbers, "hour_given", "quantity_given")["1"] == (8.0, 2.0)
    dated = by_id(requests.extract_date(df).withColumn("date_given", F.col("date_given").cast("string")),
                  "date_given", "date_note")
    assert dated["2"] == (None, requests.NO_DATE_NOTE)
    assert dated["3"] == (None, None)
    assert dated["4"] == ("2025-04-05 00:00:00", "Used date 2025-04-05 to derive time features.")
    assert dated["5"] == (None, None)


def test_scenarios(spark):
    dimension = spark.createDataFrame([("Laptop", "Electronics", 900.0, 2.0)],
                                      "product string, category string, price double, quantity double")
    defaults = {"quantity": 1.0, "price": 10.0, "category": "Home", "region": "West", "month": 6,
                "day_of_week": 2, "hour": 0, "is_weekend": 0, "customer_purchase_count": 5.0}
    matched = requests.match_known(
        messages(spark, "laptop", "laptop price 5 date 2025-04-05 hour 9", "hour 9", "nothing"),
        vocabularies(spark, {**TERMS, "product": ["Laptop"]}))
    rows = {r["msg_id"]: r for r in requests.build_scenarios(matched, dimension, defaults).collect()}
    assert (rows["0"]["price"], rows["0"]["quantity"], rows["0"]["category"]) == (900.0, 2.0, "Electronics")
    assert rows["0"]["signal_count"] == 3 and rows["0"]["notes"] == "Detected product 'Laptop'."
    assert (rows["1"]["price"], rows["1"]["month"], rows["1"]["is_weekend"]) == (5.0, 4, 1)
    assert rows["1"]["hour"] == 0 and rows["1"]["signal_count"] == 6
    assert rows["2"]["hour"] == 9 and rows["2"]["signal_count"] == 1
    assert rows["3"]["signal_count"] == 0 and rows["3"]["category"] == "Home" and rows["3"]["notes"] == ""


def test_defaults_follow_the_profile(spark, fact):
    frame = cleaning.model_frame(fact, AS_OF)
    dashboard = requests.feature_defaults(frame)
    notebook = requests.feature_defaults(frame, "notebook")
    assert dashboard["hour"] == 0 and set(dashboard) == set(notebook)
    assert dashboard["quantity"] == notebook["quantity"]
    assert sales.vocabulary(frame, "category").where(F.col("term") == dashboard["category"]).count() == 1


def test_many_terms_travel_only_where_a_long_term_may_start(spark, monkeypatch):
    """More terms than one automaton holds: long ones by joins, the few short ones by an automaton."""
    written, materialize = [], requests.materialize

    def kept(df, label):
        out = materialize(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(requests, "BROADCAST_TERMS", 28)
    monkeypatch.setattr(requests, "materialize", kept)
    short, long = [f"{a}{b}" for a in "abcde" for b in "abcde"], [f"term {i} of many" for i in range(30)]
    texts = {1: "ab and TERM 7 OF MANY", 2: "term 7 of man", 3: "zzz", 4: "cab", 5: "term 12 of many ee"}
    vocab = spark.createDataFrame([(t,) for t in short + long], "term string")
    messages = spark.createDataFrame(list(texts.items()), "msg_id long, text string")
    got = {r["msg_id"]: r["term"] for r in requests.match_terms(messages, vocab, "term", 0).collect()}
    want = {m: min((v for v in short + long if v in t.lower()), key=lambda v: (-len(v), v), default=None)
            for m, t in texts.items()}
    assert got == want
    assert [n for label, n in written if label == "starts"] == [3]  # not every place of every text


def test_terms_that_look_like_patterns(spark):
    """As many terms as one pattern screens, which must not take them for patterns."""
    terms = ["a.b", "c++", "[x]", "(y)", "a^b", "d-e", "&&", "f|g", "$h", "i\\j", "k{2}", "l?", "^m", "ab", "abc", "#n", "Q r"]
    assert len(terms) >= requests.SCREENED_TERMS
    texts = [*terms, "axb", "A.B", "xx abc.", "cc", "kk", "q  r", "", None, "é Q R é"]
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    found = by_id(requests.match_terms(messages(spark, *texts), vocab, "term"), "term")
    for i, text in enumerate(texts):
        hits = [t for t in sorted(terms) if text and t.lower() in text.lower()]
        assert found[str(i)] == (max(hits, key=len) if hits else None)


def test_a_small_table_of_products_moves_no_message(spark):
    matched = requests.match_known(messages(spark, *EXAMPLES), vocabularies(spark))
    usual = spark.createDataFrame([("Laptop", "Home", 2.0, 1.0), ("Tea", None, None, 3.0)],
                                  "product string, category string, price double, quantity double")
    defaults = {**{c: 1.0 for c in modeling.FEATURES}, "category": "Home", "region": "West"}
    built = requests.build_scenarios(matched, usual, defaults)
    assert "Exchange hashpartitioning" not in built._jdf.queryExecution().executedPlan().toString()
    assert by_id(built, "price", "quantity")["1"] == (2.0, 1.0)


def test_a_large_one_is_joined_alike(spark, monkeypatch):
    usual = spark.createDataFrame([("Laptop", 2.0), ("Tea", None), (None, 5.0)], "product string, price double")
    rows = spark.createDataFrame([(1, "Tea"), (2, None), (3, "Laptop"), (4, "none"), (3, "Laptop")], "n int, product string")
    small = sorted(map(str, joins.attach_counted(rows, usual, "product").collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    assert small == sorted(map(str, joins.attach_counted(rows, usual, "product").collect()))


@pytest.mark.parametrize("name", ["T8_score_baseline", "T9_answers"])
def test_models_and_requests_share_the_fact(spark, monkeypatch, name):
    made, make = [], warehouse.retail_fact
    monkeypatch.setattr(warehouse, "retail_fact", lambda *a: made.append(1) or make(*a))
    QUERIES[name](spark, FOLDER)
    assert len(made) == 1
