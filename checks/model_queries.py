"""M1-M10 and A19. Of models that SQL cannot fit, what SQL can say of them is checked."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.cleaning_queries import AS_OF, frame_of
from checks.insight_queries import rounded
from checks.registry import register, written_fact
from checks.source_queries import report_sql
from checks.sqltext import FRAME, query, titled
from tallyhouse.operators import cleaning, distributions, modeling
from tallyhouse.plans import analysis, training
from tallyhouse.session import CODEC, kept, new_path, released
from tallyhouse.sources import sinks, warehouse

# Small trees keep the check quick; the library's defaults are the full size.
CHECK = training.TrainingConfig(trees=20, depth=10, key="h")

FEATURES = FRAME + """,
features as (select h, quantity, price, category, region, month, day_of_week, hour, is_weekend,
  customer_purchase_count, sales from frame),
train as (select * from features where substr(md5(h), 1, 2) >= '33'),
test as (select * from features where substr(md5(h), 1, 2) < '33'),
baseline as (select h, sales, (select median(sales) from train) as prediction from test)"""


def features_of(spark, folder):
    return modeling.feature_table(frame_of(spark, folder), ["h"])


def split_of(spark, folder):
    """The two sides of the feature table; the frame it is taken from goes when they are written."""
    with released(spark):
        features = features_of(spark, folder)
        with kept():
            return modeling.write_split(features, "h")


def split_frame(frame, *features):
    """The split of a frame that more than the models read, with the features that they take."""
    return modeling.write_split(modeling.feature_table(frame, ["h"]), "h", [*features, modeling.TARGET])


@register("M1_feature_table", query(FEATURES, "select * from features"))
def m1(spark, folder):
    return features_of(spark, folder)


@register("M2_holdout_split", query(FEATURES, """
select h, 'train' as part from train union all select h, 'test' from test"""))
def m2(spark, folder):
    train, test = modeling.holdout_split(features_of(spark, folder), "h")
    return train.select("h", F.lit("train").alias("part")).unionByName(
        test.select("h", F.lit("test").alias("part")))


_NUMERIC = [c for c in modeling.FEATURES if c not in modeling.CATEGORICAL]


@register("M3_preprocess", query(FEATURES + "".join(f""",
{c}_order as (select {c}, row_number() over (order by count(*) desc, {c}) - 1.0 as {c}_index
  from train group by {c})""" for c in modeling.CATEGORICAL), f"""
select h, {', '.join(f'round(coalesce((t.{c} - m_{c}) / nullif(s_{c}, 0), 0.0), 6) as {c}_scaled'
                     for c in _NUMERIC)},
  cast(category_index as double) as category_index, cast(region_index as double) as region_index
from test t join category_order using (category) join region_order using (region),
  (select {', '.join(f'avg({c}) as m_{c}, stddev_samp({c}) as s_{c}' for c in _NUMERIC)}
   from train)"""))
def m3(spark, folder):
    train, test = split_of(spark, folder)
    ready = modeling.fit_preprocess(train).transform(test)
    scaled = vector_to_array("scaled")
    return rounded(ready.select(
        "h", *[scaled[i].alias(f"{c}_scaled") for i, c in enumerate(_NUMERIC)],
        "category_index", "region_index"), *[f"{c}_scaled" for c in _NUMERIC])


@register("M3_label_buckets", query(FEATURES, """
select cast(('0x' || substr(md5(product), 1, 8)) as bigint) % 512 as bucket,
  count(distinct product) as labels, count(*) as rows from fact where product is not null group by 1"""))
def m3_buckets(spark, folder):
    """Products hashed to 512 buckets, and how many of them share one."""
    return modeling.label_buckets(written_fact(spark, folder), "product", 512)


@register("M3_hashed_products", query(FEATURES, "select h, sales, true as fits from test"))
def m3_hashed(spark, folder):
    """A fit on products without a list of them: on the rows it was fitted to, predictions have
    the mean of what was predicted, and are nearer to it than the mean itself."""
    frame = cleaning.model_frame(written_fact(spark, folder), AS_OF)
    train, test = modeling.write_split(modeling.feature_table(frame, ["h", "product"]), "h")
    ready = modeling.fit_preprocess(train, {"product": 512})
    model = modeling.fit_linear(train, ready)
    own = modeling.score(model, train).agg(
        F.avg(F.col("sales").cast("double")), F.avg("prediction"), F.var_pop(F.col("sales").cast("double")),
        F.avg(F.pow(F.col("sales").cast("double") - F.col("prediction"), 2))).first()
    fits = abs(own[0] - own[1]) <= 1e-6 * abs(own[0]) and own[3] < own[2]
    return modeling.score(model, test).select("h", "sales", F.lit(fits).alias("fits"))


@register("M4_median_baseline", query(FEATURES, "select * from baseline"))
def m4(spark, folder):
    train, test = split_of(spark, folder)
    return modeling.score(modeling.fit_baseline(train), test).select("h", "sales", "prediction")


@register("M7_baseline_metrics", query(FEATURES, """
select 'Baseline Median' as model, round(avg(abs(sales - prediction)), 4) as mae,
  round(sqrt(avg((sales - prediction) * (sales - prediction))), 4) as rmse,
  round(1 - sum((sales - prediction) * (sales - prediction))
    / (var_pop(sales) * count(*)), 6) as r2 from baseline"""))
def m7(spark, folder):
    train, test = split_of(spark, folder)
    scored = modeling.scored_by({modeling.BASELINE: modeling.fit_baseline(train)}, test)
    metrics = modeling.regression_metrics(scored)
    return rounded(rounded(metrics, "mae", "rmse", digits=4), "r2")


_LINE = """(select regr_slope(sales, quantity) as slope, regr_intercept(sales, quantity) as start
  from train)"""


@register("M5_linear_scores", query(FEATURES, f"""
select h, sales, round(start + slope * quantity, 3) as prediction from test, {_LINE}"""))
def m5(spark, folder):
    """One feature, so that SQL has the same line."""
    train, test = split_of(spark, folder)
    model = modeling.fit_linear(train.select("quantity", "sales"))
    return rounded(modeling.score(model, test).select("h", "sales", "prediction"), "prediction", digits=3)


@register("M5_normal_equations", query(FEATURES, " union all ".join(
    f"select '{c}' as feature, 0.0 as mean_product" for c in ("constant", *_NUMERIC))))
def m5_normal(spark, folder):
    """At the least squares of all features, no feature says anything about the residuals."""
    train, _ = split_of(spark, folder)
    residual = F.col("sales").cast("double") - F.col("prediction")
    scored = modeling.score(modeling.fit_linear(train), train)
    spread = {c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)) for c in _NUMERIC}
    means = {c: F.covar_pop(residual, F.col(c).cast("double")) / spread[c] for c in _NUMERIC}
    means = {"constant": F.avg(residual), **means}
    # Relative to the spread of what is predicted.
    row = scored.agg(*[(m / F.stddev_pop(F.col("sales").cast("double"))).alias(c)
                       for c, m in means.items()])
    return row.unpivot([], list(means), "feature", "mean_product").select(
        "feature", (F.round("mean_product", 6) + F.lit(0.0)).alias("mean_product"))


def _board_rows(*others: str) -> str:
    rest = "".join(f" union all select '{m}', true, null, null, spread from base" for m in others)
    return f"""select 'Baseline Median' as model, false as beats_baseline, mae as baseline_mae,
  rmse as baseline_rmse, spread from base{rest}"""


_BASE = FEATURES + """,
base as (select round(avg(abs(sales - prediction)), 4) as mae,
  round(sqrt(avg((sales - prediction) * (sales - prediction))), 4) as rmse,
  round(var_pop(sales), 0) as spread from baseline)"""


def _board_sql(*others: str) -> str:
    return query(_BASE, _board_rows(*others))


def _board(leaderboard):
    """What SQL can say of a leaderboard: the baseline's errors, who is better, and of every
    model the spread of the held-out sales, which its RMSE and R2 must agree on."""
    own = F.col("model") == modeling.BASELINE
    base = F.max(F.when(own, F.col("rmse"))).over(Window.partitionBy())
    spread = F.col("rmse") * F.col("rmse") / (1 - F.col("r2"))
    return leaderboard.select("model", (F.col("rmse") < base).alias("beats_baseline"), *[
        F.when(own, F.round(m, 4)).alias(f"baseline_{m}") for m in ("mae", "rmse")],
        F.round(spread, 0).alias("spread"))


#: The report of the fact as cleaning leaves it: labels in title case, sums to four digits.
_CASED = ",\ncased as (select * replace (" + ", ".join(
    f"{titled(c)} as {c}" for c in ("product", "category", "region")) + ") from fact)"
_FLOW = report_sql(_BASE + _CASED, "cased", 4, f"""select 'leaderboard', model, name, value from (
  select model, unnest(['beats_baseline', 'spread']) as name,
    unnest([cast(beats_baseline as double), spread]) as value from ({_board_rows(modeling.LINEAR, modeling.FOREST)}))
union all select 'leaderboard', 'Baseline Median', 'rmse', rmse from base""")


def _flow(tables, board):
    """The flow's insight tables, and its leaderboard, as report rows."""
    checked = _board(board)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in (
        ("beats_baseline", F.col("beats_baseline").cast("int")), ("spread", F.col("spread")),
        ("rmse", F.col("baseline_rmse")))]))
    scores = checked.select(F.lit("leaderboard").alias("section"), F.col("model").alias("label"), cells.alias("c")
                            ).select("section", "label", "c.*").where("value is not null")
    return rounded(analysis.report_tables(tables).unionByName(scores), "value", digits=4)


@register("M8_leaderboard", _board_sql(modeling.LINEAR))
def m8(spark, folder):
    train, test = split_of(spark, folder)
    models = {modeling.BASELINE: modeling.fit_baseline(train),
              modeling.LINEAR: modeling.fit_linear(train)}
    return _board(modeling.leaderboard(modeling.regression_metrics(modeling.scored_by(models, test))))


@register("M6_forest_scores", query(FEATURES, "select h, sales, true as within from test"))
def m6(spark, folder):
    """A forest predicts means of what it has seen."""
    train, test = split_of(spark, folder)
    model = modeling.fit_forest(train, CHECK.trees, CHECK.depth)
    low, high = train.agg(F.min("sales").cast("double"), F.max("sales").cast("double")).first()
    return modeling.score(model, test).select(
        "h", "sales", F.col("prediction").between(low - 1e-6, high + 1e-6).alias("within"))


@register("M6_one_tree", query(FEATURES, """
select count(*) as rows, round(avg(sales), 4) as mean_prediction, 0.0 as mean_product from train"""))
def m6_tree(spark, folder):
    """One tree on all rows predicts in each leaf the mean of its rows: predictions have the
    mean of the sales, and say nothing about what is left over."""
    train, _ = split_of(spark, folder)
    scored = modeling.score(modeling.fit_forest(train, 1, CHECK.depth, bootstrap=False), train)
    left = F.col("sales").cast("double") - F.col("prediction")
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("prediction"), 4).alias("mean_prediction"),
        (F.round(F.sum(left * F.col("prediction")) / F.sum(F.pow("prediction", F.lit(2))), 6) + F.lit(0.0)
         ).alias("mean_product"))


@register("M6_forest_errors", query(FEATURES, """
select round(var_pop(sales), 0) as spread, true as better_than_median, true as misses from baseline"""))
def m6_errors(spark, folder):
    """RMSE and R2 of the forest agree on the spread of what is predicted; it errs, but less
    than the median does."""
    train, test = split_of(spark, folder)
    models = {modeling.BASELINE: modeling.fit_baseline(train),
              modeling.FOREST: modeling.fit_forest(train, CHECK.trees, CHECK.depth)}
    rows = modeling.regression_metrics(modeling.scored_by(models, test))
    own = {m: F.max(F.when(F.col("model") == m, F.col("rmse"))) for m in models}
    r2 = F.max(F.when(F.col("model") == modeling.FOREST, F.col("r2")))
    forest = own[modeling.FOREST]
    return rows.agg(F.round(forest * forest / (1 - r2), 0).alias("spread"),
                    (forest < own[modeling.BASELINE]).alias("better_than_median"), (forest > 0).alias("misses"))


@register("M10_train_leaderboard", _board_sql(modeling.LINEAR, modeling.FOREST))
def m10(spark, folder):
    return _board(training.train(written_fact(spark, folder), AS_OF, CHECK).leaderboard)


@register("W2_automatic", _FLOW)
def w2(spark, folder):
    # Cleaning reads the raw table once, so it is not written before.
    artifacts, result = training.automatic(warehouse.retail_fact(spark, folder), AS_OF, CHECK)
    return _flow(artifacts.tables, result.leaderboard)


@register("W3_manual_training", _FLOW)
def w3(spark, folder):
    """Two steps that share only the handed-off table."""
    path = new_path(spark, "hand-off")
    artifacts, _ = training.manual_analysis(warehouse.retail_fact(spark, folder), AS_OF, path)
    return _flow(artifacts.tables, training.manual_training(spark, path, AS_OF, CHECK).leaderboard)


@register("W4_notebook", _FLOW)
def w4(spark, folder):
    path = new_path(spark, "export") + ".parquet"
    warehouse.retail_fact(spark, folder).write.option("compression", CODEC).parquet(path)
    sources = [("gone", path + ".csv"), ("file", path)]
    _, _, tables, result = training.notebook(spark, sources, AS_OF, CHECK)
    return _flow(tables, result.leaderboard)


@register("IO9_saved_model", query(FEATURES, "select * from baseline"))
def io9(spark, folder):
    train, test = split_of(spark, folder)
    path = new_path(spark, "model")
    sinks.save_model(modeling.fit_baseline(train), path)
    return modeling.score(sinks.load_model(path), test).select("h", "sales", "prediction")


@register("IO10_saved_leaderboard", _board_sql())
def io10(spark, folder):
    train, test = split_of(spark, folder)
    scored = modeling.scored_by({modeling.BASELINE: modeling.fit_baseline(train)}, test)
    path = new_path(spark, "leaderboard")
    sinks.write_leaderboard(modeling.leaderboard(modeling.regression_metrics(scored)), path)
    return _board(spark.read.json(path))


@register("A19_axis_limits", query(FEATURES, """
select least(min(sales), min(prediction)) as low, greatest(max(sales), max(prediction)) as high
from baseline"""))
def a19(spark, folder):
    train, test = split_of(spark, folder)
    return distributions.axis_limits(modeling.score(modeling.fit_baseline(train), test))
