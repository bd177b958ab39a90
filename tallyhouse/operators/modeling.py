"""M1-M9: feature table, split, preprocessing, models, metrics, scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer,
                                StringIndexerModel, VectorAssembler)
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..session import materialize

TARGET = "sales"
# The features, in order, and which of them are labels.
FEATURES = ("quantity", "price", "category", "region", "month", "day_of_week", "hour",
            "is_weekend", "customer_purchase_count")
CATEGORICAL = ("category", "region")
FEWEST_ROWS = 20
SEED = 42
# Test rows have a key hash below this byte: 51 of 256, a fifth.
TEST_BELOW = "33"
TEST_FLAG = "_test"
#: Share of the rows that every node of a tree has at least.
LEAST_NODE_SHARE = 1e-4
#: Labels that a tree takes as one feature; columns with more stay one-hot, which needs no bin each.
MOST_CATEGORIES = 256
#: MLlib's own bins per feature; a label column needs one per label.
TREE_BINS = 32

BASELINE, LINEAR, FOREST = "Baseline Median", "Linear Regression", "Random Forest"


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in FEATURES if c in df.columns]


def feature_table(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """M1: features and target of the rows that have them all; ``keep`` adds key columns."""
    wanted = [*feature_columns(df), TARGET]
    return df.select(*keep, *wanted).na.drop(subset=wanted)


def require_rows(features: DataFrame, fewest: int = FEWEST_ROWS) -> None:
    """M1: refuse to train on too few rows; looks at no more than ``fewest``."""
    if features.limit(fewest).count() < fewest:
        raise ValueError("not enough clean rows to train the sales model")


def row_key(df: DataFrame) -> Column:
    """Content of a row as text, for tables without a key of their own."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return F.concat_ws("|", *cells)


def is_test(df: DataFrame, key: str | None = None) -> Column:
    """M2: a fifth of the rows, chosen by hash of the row key: the same on any partitioning."""
    digest = F.md5(F.col(key).cast("string") if key else row_key(df))
    return F.substring(digest, 1, 2) < TEST_BELOW


def holdout_split(df: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """M2: (train, test) rows, 80/20."""
    test = is_test(df, key)
    return df.where(~test), df.where(test)


def write_split(
    df: DataFrame, key: str | None = None, cols: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """M2 on a table that every fit reads again: the side of each row is written with it,
    so later passes neither read the key nor hash it, and the scan filters by side. ``cols`` are
    what is written, where that is not all."""
    sided = df.withColumn(TEST_FLAG, is_test(df, key))
    written = materialize(sided.select(*cols, TEST_FLAG) if cols else sided, "features")
    return (written.where(f"not {TEST_FLAG}").drop(TEST_FLAG),
            written.where(TEST_FLAG).drop(TEST_FLAG))


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bucket(label: str, width: int) -> str:
    """SQL of a label's bucket: the first 32 bits of its MD5, modulo the width."""
    return f"cast(conv(substring(md5({label}), 1, 8), 16, 10) as bigint) % {int(width)}"


def label_buckets(df: DataFrame, column: str, width: int) -> DataFrame:
    """(bucket, labels, rows) of a label column that is hashed to ``width`` buckets: each bucket
    with more than one label is a collision, whose labels the models cannot tell apart."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.expr(_bucket("label", width)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows"))


def preprocess_stages(
    train: DataFrame, features: Sequence[str], hashed: Mapping[str, int] | None = None
) -> list:
    """M3: fill, encode, assemble and scale. Fill values come from ``train`` alone.

    The fills are a SQL stage, so they are exact and saved with the pipeline. A label
    not seen in training becomes the all-zero vector. Columns in ``hashed`` are encoded by
    hash to that many buckets, so no list of their labels is made; see `label_buckets`
    for what that costs. It is for columns with more labels than a driver should hold.
    """
    hashed = {c: w for c, w in (hashed or {}).items() if c in train.columns}
    numeric = [c for c in features if c not in CATEGORICAL and c not in hashed]
    labels = [c for c in features if c in CATEGORICAL and c not in hashed]
    medians, common = ranks.exact_medians(train, numeric), ranks.modes(train, labels)
    fills = [f"coalesce(cast(`{c}` as double), {float(medians[c] or 0.0)!r}D) as `{c}_filled`"
             for c in numeric]
    fills += [f"coalesce(cast(`{c}` as string), {_literal(common[c] or 'Unknown')}) "
              f"as `{c}_filled`" for c in labels]
    text = {c: f"coalesce(cast(`{c}` as string), 'Unknown')" for c in hashed}
    fills += [f"cast({_bucket(text[c], w)} as double) as `{c}_index`" for c, w in hashed.items()]
    stages: list = [SQLTransformer(statement=f"select *, {', '.join(fills)} from __THIS__")]
    if labels:
        stages += [
            StringIndexer(inputCols=[f"{c}_filled" for c in labels],
                          outputCols=[f"{c}_index" for c in labels], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in labels],
                          outputCols=[f"{c}_onehot" for c in labels], dropLast=True)]
    if hashed:  # a bucket not seen in training is all zero, too
        stages.append(OneHotEncoder(inputCols=[f"{c}_index" for c in hashed], handleInvalid="keep",
                                    outputCols=[f"{c}_onehot" for c in hashed], dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"{c}_filled" for c in numeric], outputCol="numbers"))
    stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True))
    stages.append(VectorAssembler(
        inputCols=["scaled", *[f"{c}_onehot" for c in [*labels, *hashed]]], outputCol="features"))
    return stages


def fit_preprocess(train: DataFrame, hashed: Mapping[str, int] | None = None) -> PipelineModel:
    features = list(dict.fromkeys([*feature_columns(train), *(hashed or {})]))
    return Pipeline(stages=preprocess_stages(train, features, hashed)).fit(train)


def fit_baseline(train: DataFrame) -> PipelineModel:
    """M4: predicts the training median, as a pipeline like the others."""
    median = ranks.exact_medians(train, [TARGET])[TARGET]
    stage = SQLTransformer(statement=f"select *, {float(median)!r}D as prediction from __THIS__")
    return PipelineModel(stages=[stage])


def _label_sizes(preprocess: PipelineModel) -> dict[str, int]:
    """Labels of each indexed column, and one more for those not seen."""
    return {c.removesuffix("_index"): len(labels) + 1 for stage in preprocess.stages
            if isinstance(stage, StringIndexerModel)
            for c, labels in zip(stage.getOutputCols(), stage.labelsArray)}


def tree_assembler(preprocess: PipelineModel) -> VectorAssembler:
    """M6: the same features as trees take them: numbers as they are, and each label column one
    categorical feature. A row then costs a tree a handful of bins, not one per label."""
    few = {f"{c}_onehot": f"{c}_index" for c, n in _label_sizes(preprocess).items() if n <= MOST_CATEGORIES}
    wide = preprocess.stages[-1].getInputCols()
    return VectorAssembler(inputCols=["numbers", *[few.get(c, c) for c in wide if c != "scaled"]],
                           outputCol="tree_features")


def _vectors(preprocess: PipelineModel, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    ready = tree_assembler(preprocess).transform(preprocess.transform(train))
    return ready.select(*cols, F.col(TARGET).cast("double").alias(TARGET))


def write_vectors(preprocess: PipelineModel, train: DataFrame) -> DataFrame:
    """Feature vectors and target, written for estimators that pass over them many times."""
    return materialize(_vectors(preprocess, train, ["features", "tree_features"]), "vectors")


def _with_model(
    train: DataFrame, estimator, preprocess: PipelineModel, vectors: DataFrame | None, *more
) -> PipelineModel:
    ready = _vectors(preprocess, train, [estimator.getFeaturesCol()]) if vectors is None else vectors
    return PipelineModel(stages=[*preprocess.stages, *more, estimator.fit(ready)])


def fit_linear(
    train: DataFrame, preprocess: PipelineModel | None = None, vectors: DataFrame | None = None
) -> PipelineModel:
    """M5: least squares, from one pass of normal equations where there are few enough features
    for that (4,096), else by iterations. ``vectors`` are those of `write_vectors`."""
    estimator = LinearRegression(labelCol=TARGET, solver="auto", regParam=0.0)
    return _with_model(train, estimator, preprocess or fit_preprocess(train), vectors)


def fit_forest(
    train: DataFrame, trees: int = 220, depth: int = 20, seed: int = SEED,
    preprocess: PipelineModel | None = None, least_share: float = LEAST_NODE_SHARE,
    vectors: DataFrame | None = None, bootstrap: bool = True,
) -> PipelineModel:
    """M6: random forest on all features with bootstrap samples of full size.

    A node holds at least ``least_share`` of the rows, so a tree has at most ``2 /
    least_share`` nodes and the model on the driver does not grow with the table. MLlib holds
    each row's bins for all levels of the trees and adds a row up in every bin it is in, so the
    columns of `tree_assembler` decide both memory and time.
    """
    preprocess = preprocess or fit_preprocess(train)
    bins = max(n for n in (TREE_BINS, *_label_sizes(preprocess).values()) if n <= MOST_CATEGORIES)
    estimator = RandomForestRegressor(
        featuresCol="tree_features", labelCol=TARGET, numTrees=trees, maxDepth=depth, seed=seed,
        subsamplingRate=1.0, maxBins=bins, minWeightFractionPerNode=least_share,
        featureSubsetStrategy="all", bootstrap=bootstrap)
    return _with_model(train, estimator, preprocess, vectors, tree_assembler(preprocess))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M9: ``df`` with the model's prediction, without the intermediate columns."""
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], "prediction")


def scored_by(models: dict[str, PipelineModel], test: DataFrame) -> DataFrame:
    """Actual and predicted values of every model on the same rows, with the model's name."""
    parts = [score(model, test).select(F.lit(name).alias("model"),
                                       F.col(TARGET).cast("double").alias(TARGET), "prediction")
             for name, model in models.items()]
    return reduce(DataFrame.unionByName, parts)


def regression_metrics(scored: DataFrame, by: str = "model") -> DataFrame:
    """M7: MAE, RMSE and R2 of each model in one pass.

    R2 is one minus the ratio of squared errors to squared deviations from the mean;
    for a constant target it is 1 if every prediction is right and 0 if not.
    """
    error = F.col(TARGET).cast("double") - F.col("prediction")
    squared = F.sum(error * error)
    deviation = F.var_pop(F.col(TARGET).cast("double")) * F.count(F.lit(1))
    return scored.groupBy(by).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(deviation > 0, 1 - F.try_divide(squared, deviation))
        .when(squared == 0, 1.0).otherwise(0.0).alias("r2"))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """M8: best model first."""
    return metrics.orderBy("rmse", "model")
