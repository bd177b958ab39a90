import pytest
from conftest import AS_OF
from pyspark.sql import functions as F

from tallyhouse.operators import cleaning, modeling, requests, sales
from tallyhouse.plans import training
from tallyhouse.session import new_path
from tallyhouse.sources import sinks, warehouse

SMALL = training.TrainingConfig(trees=8, depth=8, key="h")


@pytest.fixture(scope="module")
def result(fact):
    return training.train(fact, AS_OF, SMALL)


def test_split_is_the_same_on_any_partitioning(fact):
    sizes = set()
    for n in (1, 5):
        train, test = modeling.holdout_split(fact.repartition(n), "h")
        sizes.add((train.count(), test.agg(F.sum(F.hash("h").cast("bigint"))).first()[0]))
    assert len(sizes) == 1
    train, test = modeling.holdout_split(fact)
    assert train.count() + test.count() == fact.count()
    assert 0.15 < test.count() / fact.count() < 0.25


def test_unseen_label_is_all_zero_and_gaps_are_filled(spark):
    train = spark.createDataFrame(
        [(1.0, "a", "x", 1.0), (2.0, "b", "x", 2.0), (3.0, "a", "it's", 3.0)],
        "quantity double, category string, region string, sales double")
    pipeline = modeling.fit_preprocess(train)
    test = spark.createDataFrame([(None, "zzz", "x", 0.0), (2.0, None, "it's", 0.0)], train.schema)
    first, second = pipeline.transform(test).collect()
    assert first["category_onehot"].toArray().tolist() == [0.0, 0.0]
    assert first["quantity_filled"] == 2.0 and second["category_filled"] == "a"
    assert second["region_onehot"].toArray().tolist() != first["region_onehot"].toArray().tolist()


def test_metrics(spark):
    scored = spark.createDataFrame([("m", 1.0, 2.0), ("m", 3.0, 3.0), ("c", 5.0, 5.0), ("c", 5.0, 5.0),
                                    ("d", 5.0, 4.0)], "model string, sales double, prediction double")
    found = {r["model"]: r for r in modeling.regression_metrics(scored).collect()}
    assert found["m"]["mae"] == 0.5 and found["m"]["rmse"] == pytest.approx(0.5 ** 0.5)
    assert found["m"]["r2"] == pytest.approx(0.5)
    assert found["c"]["r2"] == 1.0 and found["d"]["r2"] == 0.0


def test_linear_model_recovers_a_line(spark):
    train = spark.range(100).select((F.col("id") * 1.0).alias("quantity"), (F.col("id") % 7 * 1.0).alias("price"))
    train = train.withColumn("sales", 3 * F.col("quantity") - 2 * F.col("price") + 5)
    scored = modeling.score(modeling.fit_linear(train), train)
    assert scored.agg(F.max(F.abs(F.col("sales") - F.col("prediction")))).first()[0] < 1e-6
    assert scored.columns == [*train.columns, "prediction"]


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 19, "quantity double, sales double")
    with pytest.raises(ValueError, match="rows"):
        training.train_frame(df, training.TrainingConfig(trees=2, depth=2))


def test_forest_beats_line_beats_median(result):
    order = [r["model"] for r in result.leaderboard.collect()]
    assert order == [modeling.FOREST, modeling.LINEAR, modeling.BASELINE]
    assert result.best_name == modeling.FOREST
    assert result.leaderboard.first()["r2"] > 0.8
    assert set(result.context) >= {"known_product", "top_region", "monthly_sales", "product_dimension"}


def test_saved_model_predicts_the_same(spark, result):
    path = new_path(spark, "model")
    for name, model in result.models.items():
        sinks.save_model(model, path)
        again = modeling.score(sinks.load_model(path), result.test)
        both = modeling.score(model, result.test).join(again.withColumnRenamed("prediction", "p2"), "h")
        assert both.where("prediction <> p2").count() == 0, name


def test_manual_flow_and_leaderboard_file(spark, dirty):
    clean_path, board_path, model_path = (new_path(spark, n) for n in ("clean", "board", "model"))
    artifacts, context = training.manual_analysis(dirty, AS_OF, clean_path)
    assert "known_region" in context and artifacts.clean_path == clean_path
    config = training.TrainingConfig(trees=5, depth=5, key="h", model_path=model_path,
                                     leaderboard_path=board_path)
    result = training.manual_training(spark, clean_path, AS_OF, config)
    assert spark.read.json(board_path).count() == 3
    again = training.load_existing(spark, clean_path, model_path, AS_OF, board_path)
    assert again.best_name == result.best_name
    message = spark.createDataFrame(
        [("1", "Predict sales for quantity 3 price 120 category Economy region Asia date 2025-04-01"),
         ("2", "Show model metrics"), ("3", "price of nothing, hello"), ("4", "forecast")],
        "msg_id string, text string")
    told, scored = training.answer_requests(message, again, ruleset="default")
    found = {r["msg_id"]: r["answer"] for r in told.collect()}
    assert found["1"].startswith("Predicted sales: $") and "quantity: 3" in found["1"]
    assert found["2"].startswith("Best model first\n" + result.best_name)
    assert scored.where("msg_id = '1'").first()["month"] == 4
    refused = training.answer_requests(message, again, ruleset="dashboard")[0]
    assert {r["msg_id"]: r["intent"] for r in refused.collect()}["4"] == "needs_input"


def test_automatic_flow(dirty):
    artifacts, result = training.automatic(dirty, AS_OF, SMALL)
    assert artifacts.tables and result.test.count() > 0


def test_notebook_flow_falls_back(spark):
    label, profile, tables, result = training.notebook(
        spark, [("gone", "/nowhere/file.csv")], AS_OF, training.TrainingConfig(trees=3, depth=3))
    assert label == "Synthetic fallback retail data"
    assert profile.where("column = 'quantity' and missing > 0").count() == 1
    assert result.frame.count() > 1000 and "sales_trend" in tables
    report = training.render_notebook(label, profile, tables, result)
    for title in ("Before and after cleaning", "Columns", "Repeated rows", "Model comparison",
                  "Top products", "Top regions", "First twelve months"):
        assert f"## {title}" in report
    assert result.best_name in report and tables["duplicates"].first()[0] > 0


def test_requests_end_to_end(spark, fact, result):
    messages = warehouse.request_messages(fact)
    told, scored = training.answer_requests(messages, result, fact, "dashboard")
    intents = {r["intent"]: r["n"] for r in told.groupBy("intent").agg(F.count("answer").alias("n")).collect()}
    assert {"overview", "metrics", "segment_category", "top_products", "seasonality",
            "predict"} <= set(intents)
    assert all(intents.values())
    assert told.count() == told.select("msg_id").distinct().count() == messages.count()
    assert scored.count() > 0 and scored.where("prediction is null").count() == 0
    by_join = requests.match_known(messages, {"product": sales.vocabulary(fact, "product")}, case_terms=0)
    by_case = requests.match_known(messages, {"product": sales.vocabulary(fact, "product")})
    assert by_join.select("msg_id", "product").exceptAll(by_case.select("msg_id", "product")).isEmpty()
    assert cleaning.text_columns(messages) == ["msg_id", "text"]


def test_trees_take_a_label_column_as_one_feature(spark):
    """One bin a column and row, however many labels there are; labels apart get values apart."""
    train = spark.range(400).select(
        (F.col("id") % 4 + 1.0).alias("quantity"), F.concat(F.lit("c"), F.col("id") % 40).alias("category"),
        F.concat(F.lit("r"), F.col("id") % 3).alias("region"), (F.col("id") % 40 % 2 * 100.0).alias("sales"))
    model = modeling.fit_forest(train, trees=1, depth=1, bootstrap=False)
    assert model.stages[-1].numFeatures == 3
    # The odd labels against the even ones is one split of categories, and twenty of one-hot columns.
    assert modeling.score(model, train).where("abs(sales - prediction) > 1e-6").count() == 0
    unseen = spark.createDataFrame([(1.0, "new", "new", 0.0)], train.schema)
    assert modeling.score(model, unseen).first()["prediction"] in (0.0, 100.0)


def test_trees_keep_columns_of_many_labels_one_hot(spark):
    labels = modeling.MOST_CATEGORIES + 1
    train = spark.range(2 * labels).select(
        F.lit(1.0).alias("quantity"), F.concat(F.lit("c"), F.col("id") % labels).alias("category"),
        F.lit("r").alias("region"), (F.col("id") % labels * 1.0).alias("sales"))
    model = modeling.fit_forest(train, trees=1, depth=2, bootstrap=False)
    assert model.stages[-1].numFeatures == 1 + labels + 1
    assert model.stages[-1].getMaxBins() == modeling.TREE_BINS
