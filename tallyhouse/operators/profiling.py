"""Data quality before and after cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.measures import present
from ..session import materialize
from .cleaning import COPIES, GAPS, Prepared


def _gaps(df: DataFrame) -> Column:
    """Missing cells of a row."""
    return reduce(lambda a, b: a + b,
                  [present(df, c).isNull().cast("int") for c in df.columns]).cast("bigint")


def _fingerprint(df: DataFrame, bits: int) -> list[Column]:
    """Two 64-bit hashes of a row, of which ``bits`` each are kept."""
    def value(f: T.StructField) -> Column:
        number = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        # -0.0 and 0.0 are one value; hashes pass over what is missing, so that is hashed as well.
        return F.col(f"`{f.name}`") + F.lit(0.0) if number else F.col(f"`{f.name}`")

    gaps = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    values = [gaps, *[value(f) for f in df.schema]]
    return [F.shiftrightunsigned(F.xxhash64(F.lit(seed), *values), 64 - bits).alias(f"_fp{seed}")
            for seed in (1, 2)]


def duplicate_rows(df: DataFrame, name: str = "duplicates", bits: int = 64) -> DataFrame:
    """Rows that repeat an earlier one.

    Rows are counted by a fingerprint of 128 bits, added up in the map tasks, so what is shuffled
    is 16 bytes a row however wide the table is. Only rows whose fingerprint repeats are
    shuffled in full and compared, so two rows with one fingerprint are not taken for one.
    """
    marked = df.select("*", *_fingerprint(df, bits))
    keys = ["_fp1", "_fp2"]
    repeated = materialize(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias(COPIES))
                           .where(F.col(COPIES) > 1).select(*keys), "repeated")
    whole = marked.join(repeated, keys, "left_semi").groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(
        F.count(F.lit(1)).alias(COPIES))
    return whole.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).cast("bigint").alias(name))


def table_size(df: DataFrame, stage: str) -> DataFrame:
    """(stage, rows, columns, missing) of a table, from one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_gaps(df)), F.lit(0)).cast("bigint").alias("missing")
                  ).select(F.lit(stage).alias("stage"), "rows",
                           F.lit(len(df.columns)).cast("bigint").alias("columns"), "missing")


def quality_summary(prepared: Prepared) -> DataFrame:
    """(metric, value) before and after cleaning.

    Rows, missing cells, dropped copies and unread dates were counted by the pass that wrote
    the distinct rows; what is missing afterwards is what was missing in the columns that are not
    filled. Only equal rows of the raw table need a pass of their own. Where dates were read from
    text, also how many could not be, and how many mean another date with month and day
    the other way round.
    """
    raw, counted, fills = prepared.raw, prepared.counted, prepared.fills
    filled = {*fills.numeric, *fills.datetime, *fills.categorical}
    known = {
        "rows_before": counted.all, "columns_before": len(raw.columns),
        "missing_before": counted.sums[GAPS],
        "rows_after": counted.distinct, "columns_after": len(prepared.cleaned.columns),
        "missing_after": sum(counted.distinct - n for c, n in counted.present.items() if c not in filled),
        "duplicates_removed": counted.total - counted.distinct}
    if prepared.dates:
        known |= {"dates_unparsed": prepared.dates.unparsed, "dates_ambiguous": prepared.dates.ambiguous}
    values = raw.sparkSession.createDataFrame(list(known.items()), "metric string, value bigint")
    copies = duplicate_rows(raw).select(F.lit("duplicates_before").alias("metric"), F.col("duplicates").alias("value"))
    return values.unionByName(copies)


def imputations(prepared: Prepared) -> DataFrame:
    """(column, kind, value) of every fill; as many rows as there are columns."""
    spark = prepared.cleaned.sparkSession
    return spark.createDataFrame(prepared.fills.rows(), "column string, kind string, value string")


def _per_column_missing(df: DataFrame) -> DataFrame:
    return df.agg(*[
        F.count_if(present(df, c).isNull()).alias(c) for c in df.columns
    ]).unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "missing_values")


def missing_columns(df: DataFrame, k: int = 10) -> DataFrame:
    """The k columns with most missing cells, from one pass."""
    return _per_column_missing(df).where("missing_values > 0").orderBy(
        F.desc("missing_values"), "column").limit(k)


def _comparable(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    # -0.0 and 0.0 are one value; NaN is none.
    value = present(df, name) + F.lit(0.0) if kind in ("double", "float") else F.col(f"`{name}`")
    return value.cast("string").alias(name)


#: Of 2**SKETCH_BITS cells: a standard error of 0.6 %.
SKETCH_BITS = 14


def column_sketches(df: DataFrame, part: str) -> DataFrame:
    """(part, column, missing, sketch): per column the missing cells and a sketch of the distinct
    values, a few kilobytes each. Written per part of a table, they merge into the whole's."""
    spread = df.agg(*[F.struct(
        F.count_if(value.isNull()).alias("missing"), F.hll_sketch_agg(value, SKETCH_BITS).alias("sketch")).alias(c)
        for c, value in ((c, _comparable(df, c)) for c in df.columns)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`.missing"), F.col(f"`{c}`.sketch"))
                                for c in df.columns]))
    return spread.select(F.lit(part).alias("part"), cells.alias("c")).select("part", "c.*")


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """(column, missing, unique_values), about, of all parts of ``sketches`` together."""
    return sketches.groupBy("column").agg(
        F.sum("missing").alias("missing"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_values"))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, dtype, missing, unique_values), most missing first.

    Exact mode counts distinct (column, 128-bit hash of the value) pairs, combined in the map tasks,
    so neither a frequent value nor a column of ids gathers in one place and no text is
    shuffled; ``approx`` is one pass without a shuffle of values.
    """
    missing = _per_column_missing(df)
    if approx:
        distinct = df.agg(*[F.approx_count_distinct(present(df, c)).alias(c)
                            for c in df.columns]).unpivot(
            [], [F.col(f"`{c}`") for c in df.columns], "column", "unique_values")
    else:
        def hashes(i: int, value: Column) -> Column:
            both = [F.xxhash64(value), F.xxhash64(value, F.lit("again"))]
            return F.when(value.isNotNull(), F.struct(F.lit(i).alias("i"), *[
                h.alias(f"h{j}") for j, h in enumerate(both)]))

        pairs = df.select(F.explode(F.array(*[hashes(i, _comparable(df, c)) for i, c in enumerate(df.columns)]))
                          .alias("p")).where("p is not null").select("p.*").distinct()
        names = F.array(*[F.lit(c) for c in df.columns])
        distinct = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("unique_values")).select(
            names[F.col("i")].alias("column"), "unique_values")
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return missing.join(F.broadcast(distinct), "column", "left").select(
        "column", kinds[F.col("column")].alias("dtype"),
        F.col("missing_values").alias("missing"),
        F.coalesce("unique_values", F.lit(0).cast("bigint")).alias("unique_values"),
    ).orderBy(F.desc("missing"), "column")
