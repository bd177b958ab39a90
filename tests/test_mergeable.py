"""Things that are counted part by part: states, versions, sketches, samples, bins, fingerprints."""

import statistics

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import dates
from tallyhouse.operators import distributions, modeling, profiling, requests
from tallyhouse.plans import analysis, state
from tallyhouse.session import new_path
from tallyhouse.sources import sinks

NAN = float("nan")


def plain(df, digits=6):
    def cell(v):
        return round(v, digits) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


# --- states and versions -----------------------------------------------------------------------


def test_states_of_parts_add_up_to_the_whole(spark, fact):
    part = F.pmod(F.xxhash64("h"), F.lit(3))
    whole = state.state_of(fact)
    merged = state.merge(*[state.state_of(fact.where(part == i)) for i in range(3)])
    assert set(merged) == set(whole) == set(state.KEYS)
    for name in whole:
        keep = [c for c in whole[name].columns if c != "sketch"]
        keys = len(state.KEYS[name])
        got, want = ({r[:keys]: r[keys:] for r in plain(s[name].select(*keep), 12)} for s in (merged, whole))
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want), name
    orders = {(r.entity, r.value): r.n for r in merged["orders"].select(
        "entity", "value", F.hll_sketch_estimate("sketch").alias("n")).collect()}
    exact = {("region", r.region): r.n for r in fact.groupBy("region").agg(F.count_distinct("order_id").alias("n")).collect()}
    assert all(abs(orders[k] - n) <= 0.05 * n for k, n in exact.items())


def test_insights_of_a_state(spark, fact):
    found = state.insights_of(state.state_of(fact, state.Settings(origins={"sales": 30000.0})),
                              state.Settings(origins={"sales": 30000.0}))
    tables = analysis.insight_tables(fact)
    assert plain(found["monthly_sales"], 4) == plain(tables["monthly_sales"], 4)
    assert plain(found["customer_kpis"], 4) == plain(tables["customer_kpis"], 4)
    top = [(r.value, round(r.sales, 4)) for r in found["top_region"].collect()]
    assert top == [(r.region, round(float(r.sales), 4)) for r in tables["top_regions"].collect()]
    pair = found["correlations"].where("x = 'quantity' AND y = 'sales'").first()["correlation"]
    assert pair == pytest.approx(fact.select(F.corr("quantity", F.col("sales").cast("double"))).first()[0])


def test_state_of_a_table_with_gaps(spark):
    df = spark.createDataFrame([(None, None, NAN), ("a", 2.0, 1.0), ("a", None, 3.0)],
                               "region string, sales double, price double")
    found = state.state_of(df)
    assert set(found) == {"entities", "moments", "bins"}
    assert {(r.value, r.rows, r.sales) for r in found["entities"].collect()} == {(None, 1, 0.0), ("a", 2, 2.0)}
    empty = state.merge(found, state.state_of(df.limit(0)))
    assert plain(empty["entities"]) == plain(found["entities"])


def test_a_failed_write_leaves_the_version_before(spark):
    root = new_path(spark, "versions")
    assert sinks.read_published(spark, root) == {}
    assert sinks.publish(spark, {"a": spark.range(3), "b": spark.range(2)}, root) == 1
    broken = spark.range(5).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        sinks.publish(spark, {"a": spark.range(9), "b": broken}, root)
    now = sinks.read_published(spark, root)
    assert now["a"].count() == 3 and now["b"].count() == 2
    assert sinks.publish(spark, {"a": spark.range(9)}, root) == 2
    assert sinks.read_published(spark, root)["a"].count() == 9
    assert sinks.read_published(spark, root, 1)["a"].count() == 3


# --- duplicates, sketches ------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [0, 1, 3, 64])
def test_duplicates_with_colliding_fingerprints(spark, bits):
    rows = [(1, None, "a"), (1, None, "a"), (None, 1.0, "a"), (1, 1.0, None), (2, 0.0, "b"), (2, -0.0, "b"),
            (3, NAN, "c"), (3, NAN, "c"), (None, None, None), (None, None, None)] + [(i, 1.0, "d") for i in range(50)]
    df = spark.createDataFrame(rows, "i long, x double, t string").repartition(4)
    assert profiling.duplicate_rows(df, bits=bits).first()[0] == df.count() - df.distinct().count() == 4


def test_duplicates_are_counted_by_fingerprint(spark, dirty):
    whole = profiling.duplicate_rows(dirty)
    assert whole.first()[0] == dirty.count() - dirty.distinct().count()


def test_sketches_merge(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 7000).cast("string").alias("t"),
                                    F.when(F.col("id") % 2 == 0, F.col("id") % 1000 / 2).alias("x"))
    parts = [profiling.column_sketches(df.where(F.col("id") % 4 == i), str(i)) for i in range(4)]
    stored = parts[0]
    for part in parts[1:]:
        stored = stored.unionByName(part)
    exact = {r["column"]: r for r in profiling.column_profile(df).collect()}
    for r in profiling.merged_sketches(stored).collect():
        assert r["missing"] == exact[r["column"]]["missing"]
        assert abs(r["unique_values"] - exact[r["column"]]["unique_values"]) <= 0.02 * exact[r["column"]]["unique_values"]


# --- bins and samples ------------------------------------------------------------------------------


def test_binned_densities_are_near_the_exact_ones(spark, fact):
    exact = {(r.metric, r.point): r.density for r in distributions.densities(fact).collect()}
    near = {(r.metric, r.point): r.density for r in distributions.binned_densities(fact).collect()}
    assert set(exact) == set(near)
    top = {m: max(v for (k, _), v in exact.items() if k == m) for m, _ in exact}
    assert all(abs(near[k] - v) <= 2e-3 * top[k[0]] for k, v in exact.items())


def test_bins_of_parts_add_up(spark, fact):
    limits = {"quantity": (1.0, 50.0), "price": (0.0, 3000.0)}
    whole = distributions.density_bins(fact, limits, 64)
    parts = distributions.density_bins(fact.where("quantity < 20"), limits, 64).unionByName(
        distributions.density_bins(fact.where("quantity >= 20"), limits, 64))
    merged = parts.groupBy("metric", "bin").agg(F.sum("n").alias("n"), F.sum("over").alias("over"))
    assert plain(merged) == plain(whole)


def test_few_values_have_no_curve(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 11), 1.0, 0.1 if i else 1e9 + i / 1e6) for i in range(60)],
                               "sales double, quantity double, price double, other double")
    near = distributions.binned_densities(df, ["sales", "quantity", "price", "other"])
    exact = distributions.densities(df, ["sales", "quantity", "price", "other"])
    assert {r.metric for r in near.collect()} == {r.metric for r in exact.collect()} == {"quantity"}
    clustered = spark.createDataFrame([(float(i) / 1e9 if i else 1e6,) for i in range(40)], "sales double")
    assert distributions.binned_densities(clustered, ["sales"]).count() == 200
    assert distributions.binned_densities(df.limit(0)).count() == 0


def test_samples_of_parts_merge_into_the_sample(spark, fact):
    hashed = fact.select("category", "h", distributions.row_hash(fact, "h").alias("_hash"))
    whole = plain(distributions.least_hashes(hashed, "category", 12))
    halves = [distributions.least_hashes(hashed.where(side), "category", 12)
              for side in (F.col("h") < "8", F.col("h") >= "8")]
    assert plain(distributions.least_hashes(halves[0].unionByName(halves[1]), "category", 12)) == whole
    by = {}
    for category, _, digest in whole:
        by.setdefault(category, []).append(digest)
    every = {}
    for r in hashed.collect():
        every.setdefault(r.category, []).append(r._hash)
    assert by == {c: sorted(d)[:12] for c, d in every.items()} or {
        c: sorted(d) for c, d in by.items()} == {c: sorted(d)[:12] for c, d in every.items()}


def test_sample_without_colours_and_of_few_rows(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(30)], "quantity double, sales double")
    assert distributions.scatter_points(df, points=7).count() == 7
    assert distributions.scatter_points(df, points=99).count() == 30


# --- labels, terms, dates ----------------------------------------------------------------------------


def test_hashed_labels_fit_without_a_list(spark):
    rows = [(float(i % 9 + 1), 2.0, f"p{i % 60}", 10.0 * (i % 60) + i % 9) for i in range(900)]
    train = spark.createDataFrame(rows, "quantity double, price double, product string, sales double")
    ready = modeling.fit_preprocess(train, {"product": 4096})
    assert not any("StringIndexer" in type(s).__name__ for s in ready.stages)
    assert modeling.label_buckets(train, "product", 4096).agg(F.max("labels"), F.sum("labels"), F.sum("rows")).first()[1:] == (60, 900)
    narrow = modeling.label_buckets(train, "product", 8)
    assert narrow.agg(F.sum(F.col("labels") - 1)).first()[0] == 60 - narrow.count()
    model = modeling.fit_linear(train, ready)
    unseen = spark.createDataFrame([(1.0, 2.0, "unheard of", 5.0), (1.0, 2.0, None, 5.0)], train.schema)
    errors = [abs(r.sales - r.prediction) for r in modeling.score(model, train).collect()]
    # Labels that share a bucket cannot be told apart; without labels errors are near 150.
    assert statistics.median(errors) < 10 and statistics.mean(errors) < 30 and modeling.score(model, unseen).count() == 2


@pytest.mark.parametrize("limit", [1, 10**6])
def test_longest_terms_against_search(spark, monkeypatch, limit):
    import random
    pick = random.Random(5)
    terms = sorted({"".join(pick.choices("abc ", k=pick.randint(1, 7))).strip() for _ in range(300)} - {""})
    terms += ["Abca", "ABCA", "née", "NÉE b", "x" * 40, "😀 cab"]
    texts = ["".join(pick.choices("abc xX", k=pick.randint(0, 60))) for _ in range(150)] + [
        "une née bien", "x" * 60, "say 😀 CAB now", "", None]
    monkeypatch.setattr(requests, "AUTOMATON_BYTES", limit)
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string")
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.msg_id: r.term for r in requests.match_terms(df, vocab, "term", 0).collect()}

    def longest(text):
        first = {}
        for t in sorted(terms):
            first.setdefault(t.lower(), t)
        hits = [t for k, t in first.items() if text and k in text.lower()]
        return min(hits, key=lambda t: (-len(t), t)) if hits else None

    assert got == {i: longest(t) for i, t in enumerate(texts)}


def test_texts_are_shuffled_whole_whatever_the_terms(spark):
    """As rows of texts, and never as substrings."""
    df = spark.createDataFrame([(1, "abc")], "msg_id long, text string")
    texts = requests._texts(df)
    for length in (2, 60):
        vocab = spark.createDataFrame([(f"t{i}" * length,) for i in range(200)], "term string")
        plan = requests._longest_terms(texts, vocab, "term")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hash") == 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_shapes_keep_only_the_formats_that_occur(spark):
    df = spark.createDataFrame([("2024-01-05", "5/1/2024"), ("soon", "25/12/2024 10:00"), ("x" * 200, "31/02/2024"),
                                (None, "12/30/2024 3:04 pm")], "a string, b string")
    found = dates.elect_formats(df, ["a", "b"])
    assert [f[1] for f in found["a"].formats] == [None] and found["a"].unparsed == 2
    assert found["b"].order == dates.DAY_FIRST or found["b"].order == dates.MONTH_FIRST
    # 5/1 both ways; 25/12 day first; 12/30 month first; 31/02 neither.
    assert found["b"].order == dates.MONTH_FIRST and found["b"].ambiguous == 1
    assert {f[1] for f in found["b"].formats} == {"M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy h:mm a"}
