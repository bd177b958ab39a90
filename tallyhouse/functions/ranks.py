"""Exact medians, modes and row numbers that never gather a group in one task.

``median`` keeps every distinct value of a group in one buffer, and a window without
a partition sorts the whole table in one task. The functions here select medians by
counting the values near the middle, or digits of values, and number rows in range blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, released, settled

# The format of doubles: exponent bias, fractions of a power of two, least normal and greatest.
_BIAS, _FRACTION = 1023.0, 1 << 52
_LEAST_NORMAL, _GREATEST = 2.0 ** -1022, 1.7976931348623157e308

# Medians are looked for this far, in ranks, around the middle; sketches err by a tenth of it or less.
_MARGIN, _ACCURACY = 5e-4, 20_000


def _number(name: str) -> Column:
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


def present_value(df: DataFrame, name: str) -> Column:
    """A column with NaN as missing."""
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return _number(name) if numeric else F.col(f"`{name}`")


def filled_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows, and non-missing values per column, in one pass. NaN is missing."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(present_value(df, c)).alias(f"n{i}") for i, c in enumerate(cols)],
    ).first()
    return row["rows"], {c: row[f"n{i}"] for i, c in enumerate(cols)}


def sort_key(value: Column) -> Column:
    """A double as a 64-bit integer that sorts alike: the bits of its magnitude, with its sign.

    Powers of two are exact, so exponent and fraction come out exactly whatever the
    logarithm's last digit is.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("double")
    power = (F.when(F.pow(F.lit(2.0), guess) > size, guess - 1)
             .when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess))
    fraction = size / F.pow(F.lit(2.0), power) - 1
    normal = (power + _BIAS).cast("long") * _FRACTION + (fraction * float(_FRACTION)).cast("long")
    tiny = (size * 2.0 ** 537 * 2.0 ** 537).cast("long")
    bits = (F.when(size == 0, F.lit(0).cast("long")).when(size < _LEAST_NORMAL, tiny)
            .when(size > _GREATEST, F.lit((2047 << 52))).otherwise(normal))
    return F.when(value < 0, -bits).otherwise(bits)


def _digit(key: Column, number: int) -> Column:
    """The 16 bits of a sort key at a place, in the order of the keys."""
    unsigned = key.bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(unsigned, 48 - 16 * number).bitwiseAND(F.lit(0xFFFF))


def _middles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str) -> DataFrame:
    """`_selected`, written; the values it was selected from go at once."""
    return settled(df.sparkSession, lambda: _selected(df, keys, cols, label), label)


def _selected(df: DataFrame, keys: Sequence[str], cols: Sequence[str], label: str) -> DataFrame:
    """``keys, name, m``: exact medians of each column per group, by radix selection.

    A pass counts values by the next 16 bits of their sort key, added up in the map tasks; the
    digits that hold the two middle ranks are kept for the next pass. All groups and columns go
    together, and at most four passes read one written projection. A bucket in which all
    values are equal needs no further pass, and mostly that ends it sooner. Values are not shuffled;
    a group costs at most 65,536 counts a pass.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), (_number(c) + F.lit(0.0)).alias("_v"))
                                for i, c in enumerate(cols)]))
    values = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], pairs.alias("p")).select(
        *[f"_k{i}" for i in range(len(keys))], "p.*").where("_v is not null")
    values = materialize(values.withColumn("_s", sort_key(F.col("_v"))), label)
    group = [*[f"_k{i}" for i in range(len(keys))], "_c"]
    found, wanted = [], None
    for number in range(4):
        here = values
        if wanted is not None:  # only values in the buckets that are still open
            named = wanted.select(*[F.col(g).alias(f"w{g}") for g in group], "_prefix").distinct()
            prefix = F.shiftrightunsigned("_s", 64 - 16 * number)
            same = [F.col(g).eqNullSafe(F.col(f"w{g}")) for g in group] + [prefix == F.col("_prefix")]
            here = values.join(named if keys else F.broadcast(named), same)
        else:
            here = here.withColumn("_prefix", F.lit(0).cast("long"))
        counts = here.groupBy(*group, "_prefix", _digit(F.col("_s"), number).alias("_d")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        so_far = Window.partitionBy(*group, "_prefix").orderBy("_d")
        every = Window.partitionBy(*group, "_prefix")
        placed = counts.withColumns({"_upto": F.sum("_n").over(so_far), "_all": F.sum("_n").over(every)})
        if wanted is None:
            ranked = placed.withColumn("_rank", F.explode(F.array(
                F.expr("(_all - 1) div 2"), F.expr("_all div 2"))))
        else:
            asked = wanted.select(*[F.col(g).alias(f"w{g}") for g in group],
                                  F.col("_prefix").alias("w_prefix"), F.col("_rank"))
            ranked = placed.join(asked, [F.col(g).eqNullSafe(F.col(f"w{g}")) for g in group]
                                 + [F.col("_prefix") == F.col("w_prefix")])
        hit = ranked.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        # The prefix is the key's leading bits as they are; digits are of the key as unsigned.
        digit = F.col("_d").bitwiseXOR(F.lit(0x8000)) if number == 0 else F.col("_d")
        step = materialize(hit.select(
            *group, (F.shiftleft("_prefix", 16) + digit).alias("_prefix"),
            (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_lo", "_hi"), label)
        found.append(step.where("_lo = _hi").select(*group, F.col("_lo").alias("_m")))
        wanted = step.where("_lo < _hi")
        if number == 3 or wanted.isEmpty():
            break
    return (reduce(DataFrame.unionAll, found).groupBy(*group).agg(F.avg("_m").alias("m"))
            .select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_c", "m"))


def _between(values: DataFrame, ends: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``name, v, n``: how often each value between the ends of its column occurs."""
    cells = F.array(*[F.when(F.col(c).between(low, high), F.struct(F.lit(c).alias("name"), F.col(c).alias("v")))
                      for c, (low, high) in ends.items()])
    inside = values.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("c"))
    return inside.groupBy("c.name", "c.v").agg(F.count(F.lit(1)).alias("n"))


def exact_medians(
    df: DataFrame, cols: Sequence[str], written: bool = False
) -> dict[str, float | None]:
    """Exact median of each numeric column over the whole table (None if all missing).

    One pass makes quantile sketches, which tell two values with the median between them. A second
    counts the rows below and up to them. Where the two are one value, as in columns of few values, that
    decides; else a third pass counts the values between, about a thousandth of the rows
    however many there are, and the middle ranks are looked up there. Columns whose counts do
    not hold both ranks go through `_middles`. The passes read one written projection, or ``df``
    itself where that is ``written`` already.
    """
    if not cols:
        return {}
    with released(df.sparkSession):
        return _medians(df, cols, written)


def _medians(df: DataFrame, cols: Sequence[str], written: bool) -> dict[str, float | None]:
    names = {f"v{i}": c for i, c in enumerate(cols)}
    values = df.select(*[(_number(c) + F.lit(0.0)).alias(v) for v, c in names.items()])
    if not written:
        values = materialize(values, "medians")
    around = [0.5 - _MARGIN, 0.5 + _MARGIN]
    row = values.agg(*[F.count(v).alias(f"n{v}") for v in names],
                     *[F.percentile_approx(v, around, _ACCURACY).alias(v) for v in names]).first()
    ends = {v: (row[v][0], row[v][1]) for v in names if row[f"n{v}"]}
    if not ends:
        return dict.fromkeys(cols)
    below = values.agg(*[F.count_if(F.col(v) < low).alias(v) for v, (low, _) in ends.items()],
                       *[F.count_if(F.col(v) <= high).alias(f"u{v}") for v, (_, high) in ends.items()]).first()
    # Ranks from 0 among the values between: those of the lower and the upper middle.
    ranks = {v: ((row[f"n{v}"] - 1) // 2 - below[v], row[f"n{v}"] // 2 - below[v]) for v in ends}
    middle: dict[str, list[float]] = {
        v: [low for k in ranks[v] if low == high and 0 <= k < below[f"u{v}"] - below[v]]
        for v, (low, high) in ends.items()}
    apart = {v: both for v, both in ends.items() if both[0] < both[1]}
    if apart:
        so_far = F.sum("n").over(Window.partitionBy("name").orderBy("v"))
        hit = reduce(lambda x, y: x | y, [
            (F.col("name") == v) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r)
            for v in apart for r in ranks[v]])
        inside = reduce(lambda x, y: x | y, [F.col(v).between(low, high) for v, (low, high) in apart.items()])
        for r in _between(values.where(inside), apart).withColumn("upto", so_far).where(hit).collect():
            middle[r["name"]] += [r["v"] for k in ranks[r["name"]] if r["upto"] - r["n"] <= k < r["upto"]]
    found = {names[v]: sum(both) / 2 for v, both in middle.items() if len(both) == 2}
    missed = [v for v, both in middle.items() if len(both) < 2]
    if missed:
        found |= {names[missed[r["_c"]]]: r["m"] for r in _middles(values, [], missed, "medians").collect()}
    return {c: found.get(c) for c in cols}


def _ordered_blocks(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Range-partition by ``order`` and write the block number down with each row.

    The block is written, not recomputed, so every later step sees the same borders.
    """
    return materialize(
        df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), label
    )


def grouped_medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact median of each column per group: ``keys + cols``; see `_middles`."""
    middles = _middles(df, keys, cols, "grouped-medians")
    # A group whose values are all missing has no median, but is a group.
    every = df.select(*keys).distinct().select(
        *keys, F.lit(None).cast("int").alias("_c"), F.lit(None).cast("double").alias("m"))
    return middles.unionByName(every).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_c") == i, F.col("m"))).alias(c) for i, c in enumerate(cols)])


def _most_frequent(value: str) -> Column:
    """Most frequent value of (value, n) rows; ties go to the smallest value."""
    return F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))["v"]


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent text of each column, all columns in one shuffle of (column, value)."""
    if not cols:
        return {}
    counts = (
        df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
        .unpivot([], list(cols), "name", "v").where("v is not null")
        .groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    found = {r["name"]: r["v"] for r in
             counts.groupBy("name").agg(_most_frequent("v").alias("v")).collect()}
    return {c: found.get(c) for c in cols}


def grouped_modes(df: DataFrame, key: str, col: str, default: str) -> DataFrame:
    """Most frequent value of ``col`` per key: (key, col). Hot groups shrink before each shuffle."""
    counts = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("n"))
    # A missing value sorts behind every real one, whatever its count.
    best = F.min(F.struct(F.col(col).isNull().alias("gone"), (-F.col("n")).alias("n"),
                          F.col(col).alias("v")))["v"]
    return counts.groupBy(key).agg(F.coalesce(best, F.lit(default)).alias(col))


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense row numbers 1..n in the given order, without sorting in one task.

    Rows are numbered inside range blocks and moved up by the rows of earlier blocks: a
    table of one number per block, broadcast.
    """
    ordered = _ordered_blocks(df, order, "row-numbers")
    sizes = ordered.groupBy("block").count().orderBy("block").collect()
    offsets, seen = [], 0
    for size in sizes:
        offsets.append((size["block"], seen))
        seen += size["count"]
    before = df.sparkSession.createDataFrame(offsets, "block int, _before bigint")
    within = F.row_number().over(Window.partitionBy("block").orderBy(*order))
    numbered = ordered.withColumn("_within", within).join(F.broadcast(before), "block")
    return numbered.withColumn(name, F.col("_before") + F.col("_within")).drop(
        "block", "_before", "_within")
