"""Histograms, density curves, explorer points."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import present
from ..roles import column_kinds, explorer_axes
from ..session import materialize
from .cleaning import numbers

# Bin limits, density grid, and when a density is drawn.
FEWEST_BINS, MOST_BINS = 10, 30
GRID_POINTS = 200
DENSITY_BINS = 2048
DENSITY_MIN_DISTINCT = 10


def _number(df: DataFrame, col: str) -> Column:
    return present(df, col).cast("double")


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(metric, v): the values of all columns under each other, in one scan."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), _number(df, c).alias("v")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.metric", "p.v").where("v is not null")


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def _per_metric(metric: Column, values: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(metric == m, F.lit(v)) for m, v in values.items()])


def histograms(
    df: DataFrame, cols: Sequence[str] = ("sales", "quantity", "price"), bins: int | None = None
) -> DataFrame:
    """(metric, bin, bin_start, bin_end, count), empty bins included.

    ``bins`` defaults to the square root of the row count within [10, 30]. The highest
    value belongs to the last bin; a constant column gets one bin. Two scans for all
    columns: one for the limits, one that counts (metric, bin) pairs in the map tasks.
    """
    found = _present(df, cols)
    number = {c: _number(df, c) for c in found}
    limits = df.agg(*[
        F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).alias(c)
        for c, v in number.items()]).first()
    spine, low, width = [], {}, {}
    for c in found:
        lo, hi, n = limits[c]
        if not n:
            continue
        parts = bins or min(MOST_BINS, max(FEWEST_BINS, math.isqrt(n)))
        low[c], width[c] = lo, (1 if lo == hi else parts, hi - lo)
        step = (hi - lo) / width[c][0]
        spine += [(c, i, lo + i * step, lo + (i + 1) * step) for i in range(width[c][0])]
    spark = df.sparkSession
    edges = spark.createDataFrame(spine, "metric string, bin int, bin_start double, bin_end double")
    if not spine:
        return edges.withColumn("count", F.lit(0).cast("bigint"))

    metric = F.col("metric")
    parts = _per_metric(metric, {c: n for c, (n, _) in width.items()})
    span = _per_metric(metric, {c: s or 1.0 for c, (_, s) in width.items()})
    place = F.floor((F.col("v") - _per_metric(metric, low)) * parts / span).cast("int")
    counted = _long(df, list(low)).groupBy(
        "metric", F.least(place, parts - 1).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return edges.join(counted, ["metric", "bin"], "left").select(
        *edges.columns, F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    return histograms(df, [col], bins)


_CURVE = "metric string, point int, x double, density double"


def density_bins(df: DataFrame, limits: Mapping[str, tuple[float, float]], bins: int = DENSITY_BINS) -> DataFrame:
    """(metric, bin, n, over): values of each column between two of ``bins`` points, evenly from
    its lower to its upper limit, and the sum of their distances from the lower point, in steps.

    Counts over parts of a table, with the same limits, add up to those of the whole.
    """
    metric = F.col("metric")
    low = _per_metric(metric, {m: lo for m, (lo, _) in limits.items()})
    step = _per_metric(metric, {m: (hi - lo) / (bins - 1) for m, (lo, hi) in limits.items()})
    place = (F.col("v") - low) / step
    at = F.least(F.floor(place), F.lit(bins - 2)).cast("int")
    return _long(df, list(limits)).select("metric", at.alias("bin"), (place - at).alias("over")).groupBy(
        "metric", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("over").alias("over"))


def binned_densities(
    df: DataFrame, cols: Sequence[str] = ("sales", "quantity", "price"), points: int = GRID_POINTS,
    bins: int = DENSITY_BINS,
) -> DataFrame:
    """A17 by linear binning: as `densities`, but a value counts as shares of the two of ``bins``
    points it lies between, and the kernel is summed over those.

    Two scans: limits and spread, then counts, of which at most ``bins`` a column are shuffled from
    each task. The error falls with the square of the distance of the points.
    """
    found = _present(df, cols)
    number = {c: _number(df, c) for c in found}
    stats = df.agg(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).cast("double").alias("n"),
                              F.stddev_samp(v).alias("sd")).alias(c) for c, v in number.items()]).first()
    spread = {c: stats[c] for c in found if stats[c]["n"] and stats[c]["lo"] < stats[c]["hi"]}
    if not spread:
        return df.sparkSession.createDataFrame([], _CURVE)
    counts = materialize(density_bins(df, {c: (r["lo"], r["hi"]) for c, r in spread.items()}, bins), "density-bins")
    taken = dict(counts.groupBy("metric").count().collect())
    # More than ten bins are more than ten values; only where there are fewer must they be counted.
    few = [c for c in spread if taken[c] <= DENSITY_MIN_DISTINCT]
    if few:
        values = _long(df, few).groupBy("metric").agg(F.count_distinct("v")).collect()
        spread = {c: r for c, r in spread.items() if dict(values).get(c, DENSITY_MIN_DISTINCT + 1) > DENSITY_MIN_DISTINCT}
        if not spread:
            return df.sparkSession.createDataFrame([], _CURVE)
    metric = F.col("metric")
    width = {m: r["sd"] * r["n"] ** -0.2 for m, r in spread.items()}
    both = F.explode(F.array(F.struct(F.col("bin").alias("at"), (F.col("n") - F.col("over")).alias("w")),
                             F.struct((F.col("bin") + 1).alias("at"), F.col("over").alias("w"))))
    weights = counts.where(metric.isin(list(spread))).select("metric", both.alias("b")).groupBy(
        "metric", "b.at").agg(F.sum("b.w").alias("w"))
    low, span = (_per_metric(metric, {m: f(r) for m, r in spread.items()})
                 for f in (lambda r: r["lo"], lambda r: r["hi"] - r["lo"]))
    x = low + F.col("point") * (span / (points - 1))
    z = (x - (low + F.col("at") * (span / (bins - 1)))) / _per_metric(metric, width)
    scale = _per_metric(metric, {m: r["n"] * width[m] * math.sqrt(2 * math.pi) for m, r in spread.items()})
    return weights.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).groupBy(
        "metric", "point").agg(F.sum(F.col("w") * F.exp(z * z * -0.5)).alias("k")).select(
        "metric", "point", x.alias("x"), (F.col("k") / scale).alias("density"))


def densities(
    df: DataFrame, cols: Sequence[str] = ("sales", "quantity", "price"), points: int = GRID_POINTS
) -> DataFrame:
    """(metric, point, x, density): Gaussian kernel, Scott bandwidth, exact sums.

    The distinct values are counted and written once. Each then adds its weight to every
    grid point inside its own task, so only ``points`` partial sums per task and column
    are shuffled. Columns with up to ten distinct values have no curve.
    """
    values = materialize(_long(df, _present(df, cols)).groupBy("metric", "v").agg(
        F.count(F.lit(1)).alias("n")), "value-counts")
    n, v, metric = F.col("n"), F.col("v"), F.col("metric")
    stats = {r["metric"]: r for r in values.groupBy("metric").agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.sum("n").cast("double").alias("n"),
        (F.sum(n * v) / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("distinct")).collect()}
    curved = {m: r for m, r in stats.items() if r["distinct"] > DENSITY_MIN_DISTINCT}
    if not curved:
        return df.sparkSession.createDataFrame([], _CURVE)
    off = v - _per_metric(metric, {m: r["mean"] for m, r in curved.items()})
    squares = dict(values.where(metric.isin(list(curved))).groupBy("metric").agg(
        F.sum(n * off * off)).collect())

    width = {m: math.sqrt(squares[m] / (r["n"] - 1)) * r["n"] ** -0.2 for m, r in curved.items()}
    x = _per_metric(metric, {m: r["lo"] for m, r in curved.items()}) + F.col("point") * _per_metric(
        metric, {m: (r["hi"] - r["lo"]) / (points - 1) for m, r in curved.items()})
    scale = _per_metric(metric, {
        m: r["n"] * width[m] * math.sqrt(2 * math.pi) for m, r in curved.items()})
    # Standardised once per value; the grid points are then a fixed distance apart.
    steps = values.where(metric.isin(list(curved))).select(
        "metric", "n",
        ((_per_metric(metric, {m: r["lo"] for m, r in curved.items()}) - v)
         / _per_metric(metric, width)).alias("start"),
        _per_metric(metric, {m: (r["hi"] - r["lo"]) / (points - 1) / width[m]
                             for m, r in curved.items()}).alias("step"))
    z = F.col("start") + F.col("point") * F.col("step")
    return steps.withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    ).groupBy("metric", "point").agg(F.sum(n * F.exp(z * z * -0.5)).alias("k")).select(
        "metric", "point", x.alias("x"), (F.col("k") / scale).alias("density"))


def density(df: DataFrame, col: str, points: int = GRID_POINTS) -> DataFrame:
    return densities(df, [col], points)


SAMPLE_HASH = "_hash"


def row_hash(df: DataFrame, key: str | None = None) -> Column:
    """128 bits, as hexadecimal text, of a row's key, or of all its cells."""
    if key is not None:
        return F.md5(F.col(f"`{key}`").cast("string"))
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in df.columns]
    return F.md5(F.concat_ws("\x01", *cells))


def least_hashes(df: DataFrame, color: str | None, points: int, label: str = "sample") -> DataFrame:
    """The ``points`` rows of each colour whose ``_hash`` is least.

    Rows are counted by colour and the first 16 bits of the hash; below the bits at which a
    colour has enough rows all are taken, and only rows with just these bits are ranked. So no
    task gathers a colour. Of samples of the parts of a table, the least are the table's sample.
    """
    group = F.col(f"`{color}`") if color else F.lit(0)
    marked = df.withColumns({"_group": group, "_bits": F.conv(F.substring(SAMPLE_HASH, 1, 4), 16, 10).cast("int")})
    counts = marked.groupBy("_group", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy("_bits"))
    cuts = materialize(counts.withColumn("_upto", upto).where(
        (F.col("_upto") >= points) & (F.col("_upto") - F.col("_n") < points)).select(
            F.col("_group").alias("_g"), F.col("_bits").alias("_cut"),
            (F.lit(points) - F.col("_upto") + F.col("_n")).alias("_left")), label)
    placed = marked.join(cuts, F.col("_group").eqNullSafe(F.col("_g")), "left")
    below = placed.where(F.col("_cut").isNull() | (F.col("_bits") < F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy(SAMPLE_HASH))
    at = placed.where("_bits = _cut").withColumn("_rank", rank).where("_rank <= _left")
    return below.select(*df.columns).unionByName(at.select(*df.columns))


def scatter_points(df: DataFrame, points: int | None = None, key: str | None = None) -> DataFrame:
    """The 2-D explorer extract, only the columns the chart needs.

    Without sales the last numeric column is drawn; points are coloured by category, else
    by region, else not at all. All rows by default; with ``points``, of each colour
    the rows whose hash (of the column ``key``, or of the shown cells) is least.
    """
    numeric = column_kinds(df)["numeric"]
    y = "sales" if "sales" in numeric else (numeric or [None])[-1]
    color = next((c for c in ("category", "region") if c in df.columns), None)
    wanted = [explorer_axes(df)["x"], y, color, "price", "product", "region", "customer_id"]
    shown = list(dict.fromkeys(c for c in wanted if c in df.columns))
    if points is None:
        return df.select(*shown)
    hashed = df.select(*shown, row_hash(df if key else df.select(*shown), key).alias(SAMPLE_HASH))
    return least_hashes(hashed, color, points).select(*shown)


def cloud_points(df: DataFrame, x: str, y: str, z: str, color: str | None) -> DataFrame:
    """The 3-D explorer extract: numeric axes, rows without one dropped."""
    axes = [x, y, z]
    shown = [c for c in ("product", "region", "category", "customer_id") if c in df.columns]
    points = numbers(df, axes).na.drop(subset=axes)
    if color and color != "None" and color in df.columns:
        label = F.col(color).cast("string")
        known = F.when(~label.isin("<NA>", "nan"), label)
        points = points.withColumn(color, F.coalesce(known, F.lit("Unknown")))
        shown = [color, *shown]
    return points.select(*dict.fromkeys([*axes, *shown]))


def axis_limits(scored: DataFrame, actual: str = "sales", predicted: str = "prediction"
                ) -> DataFrame:
    """Common limits of a predicted-against-actual chart."""

    def both(pick, agg) -> Column:
        return pick(agg(F.col(actual).cast("double")), agg(F.col(predicted).cast("double")))

    return scored.agg(both(F.least, F.min).alias("low"), both(F.greatest, F.max).alias("high"))
