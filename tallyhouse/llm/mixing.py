"""Mixing sources to target weights by entropy balancing.

Of all rates that make each source's words add up to its target, the wanted ones are closest
in relative entropy to one copy of every document, with no rate above `MOST`. They are
``min(MOST, exp(l * size))`` with one multiplier ``l`` per source, the minimum of a convex
dual function. Newton steps find it: each step aggregates the words and their derivative per
source over the table of (source, size) classes, which the documents are counted into first.

Rates are rounded into copies class by class, from the largest size down; what rounding a
class leaves over is carried to the next, so the words that are taken end up within about
the smallest size of the target. Sizes are rounded in blocks of `STRIDE`, each a task of its
own; the last block of a source, the one with its smallest sizes, starts with what the others
leave over. Within a class, the documents whose hash is least get the additional copies. The
hash is of id and text, so runs agree. Of equal hashes, as many get one as are wanted: which
rows is settled by a second hash, of numbers that are written down first.

No step gathers a source, a class, equal rows or all sources in one task: classes are counted
before any shuffle, ranks are taken within buckets of a class, sources are numbered in range
blocks, and the level of the targets is found by sums over all sources.

Edge cases: a null text has size 0, takes nothing and counts for nothing. A null source is a
source of its own, last. Without documents the result is empty; without any word all targets
are 0. Rows that repeat are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.ranks import number_rows
from tallyhouse.llm.common import bounded, hide, pick, place
from tallyhouse.session import materialize

#: No document is taken more often than this.
MOST = 3
#: The weights of the sources, in order, over and over.
WEIGHTS = (1, 2, 3)
STEPS = 60
CLOSE = 1e-6
#: Sizes that are rounded in one task.
STRIDE = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
                      F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``sizes (source, source_size)``.

    Sources in order of their code points, null last, share the sum of all sizes by their
    weights; none gets more than ``most`` times its size, and what is over is shared again
    by weight among the others until none is above.
    """
    keyed = sizes.select("source", "source_size", F.col("source").isNull().alias("last"),
                         F.col("source").cast("binary").alias("bytes"))
    ranked = number_rows(keyed, ["last", "bytes"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.alias("w"),
                                      (F.col("source_size") * float(most)).alias("limit")), "sources")
    # target = min(limit, level * weight): the level rises as sources reach their limits.
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at_limit = F.col("limit") < level * F.col("w")
        row = table.agg(F.count_if(at_limit).alias("full"),
                        F.sum(F.when(at_limit, F.col("limit"))).alias("taken"),
                        F.sum(F.when(~at_limit, F.col("w"))).alias("open")).first()
        if row["full"] == full or not row["open"]:
            break
        full = row["full"]
        level = (total - (row["taken"] or 0.0)) / row["open"]
    return table.select("source", "source_size", F.least("limit", level * F.col("w")).alias("target"))


def tilts(classes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """``source, source_size, target, tilt``: Newton's iterations on the dual, per source.

    ``tilt`` is null where every rate is ``most``, or no document has words. A step that
    leaves the bracket of signs seen so far is halved into it. The largest size in a source
    is the unit of the steps.
    """
    inf = float("inf")
    scale = classes.groupBy("source").agg(F.max("size").alias("unit"))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    start = goals.withColumnRenamed("source", "s").join(
        scale, F.col("s").eqNullSafe(F.col("source")), "left")
    state = materialize(start.select(
        "s", "source_size", "target", F.col("unit").cast("double").alias("unit"),
        F.lit(0.0).alias("l"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"),
        (full | (F.col("source_size") <= 0)).alias("done")), "tilts")
    for _ in range(STEPS):
        x = F.col("size") / F.col("unit")
        rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("l") * x, F.lit(50.0))))
        words = F.col("n") * F.col("size") * rate
        sums = (classes.join(state.filter(~F.col("done")), F.col("source").eqNullSafe(F.col("s")))
                .groupBy(F.col("s").alias("t")).agg(
                    F.sum(words).alias("f"),
                    F.sum(F.when(rate < most, words * x).otherwise(0.0)).alias("g")))
        low = F.when(F.col("f") < F.col("target"), F.col("l")).otherwise(F.col("lo"))
        high = F.when(F.col("f") > F.col("target"), F.col("l")).otherwise(F.col("hi"))
        step = F.try_divide(F.log(F.try_divide("target", "f")) * F.col("f"), F.col("g"))
        moved = state.join(sums, F.col("s").eqNullSafe(F.col("t")), "left").select(
            "s", "source_size", "target", "unit", "l", "done", "f",
            low.alias("lo"), high.alias("hi"), (F.col("l") + step).alias("try"))
        middle = (F.when((F.col("lo") > -inf) & (F.col("hi") < inf), (F.col("lo") + F.col("hi")) / 2)
                  .when(F.col("lo") > -inf, F.col("lo") + F.greatest(F.lit(1.0), F.abs("lo")))
                  .otherwise(F.col("hi") - F.greatest(F.lit(1.0), F.abs("hi"))))
        inside = (F.col("try") > F.col("lo")) & (F.col("try") < F.col("hi"))
        good = F.abs(F.col("f") - F.col("target")) <= CLOSE * F.col("target")
        state = materialize(moved.select(
            "s", "source_size", "target", "unit",
            F.when(F.col("done") | good, F.col("l")).when(inside, F.col("try")).otherwise(middle)
            .alias("l"), "lo", "hi", (F.col("done") | F.coalesce(good, F.lit(True))).alias("done")),
            "tilts")
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select(F.col("s").alias("source"), "source_size", "target", F.when(
        ~full & (F.col("source_size") > 0), F.col("l") / F.col("unit")).alias("tilt"))


_COPIES = "source string, size long, n long, source_size long, target double, copies long, over double"


def _round_classes(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False).reset_index(drop=True)
        wanted = (rows["n"] * rows["rate"]).to_numpy()
        size, limit = rows["size"].to_numpy(), (rows["n"] * most).to_numpy()
        copies, over = np.zeros(len(rows), np.int64), float(rows["over"].iloc[0])
        for i in range(len(rows)):
            if size[i]:
                over += wanted[i] * size[i]
                copies[i] = min(max(int(np.floor(over / size[i] + 0.5)), 0), limit[i])
                over -= float(copies[i]) * size[i]
        return rows.assign(copies=copies, over=over)[["source", "size", "n", "source_size", "target", "copies", "over"]]

    return run


def rounded_classes(rated: DataFrame, most: int = MOST, stride: int = STRIDE) -> DataFrame:
    """Copies of each class of ``rated (source, size, n, source_size, target, rate)``, written."""
    block = F.expr(f"size div {int(stride)}")
    lowest = rated.groupBy(F.col("source").alias("s")).agg(F.min(block).alias("low"))
    blocks = materialize(rated.join(lowest, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", block)
                         .drop("s"), "rated")
    run = _round_classes(most)
    upper = materialize(blocks.filter("block > low").withColumn("over", F.lit(0.0))
                        .groupBy("source", "block").applyInPandas(run, _COPIES), "rounded")
    # Each block's rest is the same in all its rows.
    rest = (upper.groupBy(F.col("source").alias("s"), F.expr(f"size div {int(stride)}").alias("b"))
            .agg(F.first("over").alias("over")).groupBy("s").agg(F.sum("over").alias("over")))
    lower = (blocks.filter("block = low").join(rest, F.col("source").eqNullSafe(F.col("s")), "left")
             .withColumn("over", F.coalesce("over", F.lit(0.0))))
    return materialize(upper.unionByName(lower.groupBy("source").applyInPandas(run, _COPIES)).drop("over"), "rounded")


def _unsigned(hash_: Column) -> Column:
    """Signed numbers in the order of the hashes as unsigned numbers."""
    return hash_.bitwiseXOR(F.lit(-(1 << 63)))


def smallest(keyed: DataFrame, need: DataFrame) -> DataFrame:
    """Where the ``more`` least hashes of each class end.

    ``keyed (source, size, hash)``, ``need (s, z, more)``; gives ``s, z, cut, equal, same``:
    hashes (as `_unsigned`) under ``cut`` are among them, and ``equal`` of the ``same`` rows at it.
    """
    alike = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    bucket = F.shiftrightunsigned("hash", 52)
    counts = (keyed.groupBy("source", "size", bucket.alias("bucket")).agg(F.count("*").alias("k"))
              .join(need, alike))
    so_far = Window.partitionBy("s", "z").orderBy("bucket")
    edge = (counts.withColumn("upto", F.sum("k").over(so_far))
            .filter((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("k") < F.col("more")))
            .select("s", "z", F.col("bucket").alias("b"),
                    (F.col("more") - F.col("upto") + F.col("k")).alias("place")))
    inside = (keyed.join(edge, alike & (bucket == F.col("b")))
              .groupBy("s", "z", "place", _unsigned(F.col("hash")).alias("cut")).agg(F.count("*").alias("same")))
    order = Window.partitionBy("s", "z").orderBy("cut")
    return (inside.withColumn("upto", F.sum("same").over(order))
            .withColumn("equal", F.col("place") - F.col("upto") + F.col("same"))
            .filter((F.col("equal") >= 1) & (F.col("equal") <= F.col("same")))
            .select("s", "z", "cut", "equal", "same"))


def plan(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``p_source, p_size, source_size, target, base, cut, equal, same`` for each class of
    ``keyed (source, size, hash)``, a written table: each of its documents is taken ``base``
    times, and once more if its hash is under ``cut``, or among ``equal`` of those at it."""
    classes = materialize(keyed.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    found = tilts(classes, targets(sizes, weights, most), most)
    found = found.withColumnRenamed("source", "s")
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(
        F.least(F.lit(float(most)), F.exp(F.col("tilt") * F.col("size"))))
    rated = classes.join(found, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "size", "n", "source_size", "target", rate.alias("rate"))
    rounded = rounded_classes(rated, most)
    more = F.col("copies") % F.greatest("n", F.lit(1))
    cuts = smallest(keyed, rounded.filter(more > 0).select(
        F.col("source").alias("s"), F.col("size").alias("z"), more.alias("more")))
    return materialize(rounded.join(
        cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").select(
            F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target",
            F.expr("copies div greatest(n, 1)").alias("base"), "cut", "equal", "same"), "mixing")


def taken(docs: DataFrame, plans: DataFrame) -> DataFrame:
    """``docs (.., source, size, hash)`` with ``source_size, target, copies`` of its class."""
    joined = docs.join(bounded(plans), F.col("source").eqNullSafe(F.col("p_source"))
                       & (F.col("size") == F.col("p_size")))
    place = _unsigned(F.col("hash"))
    extra = F.coalesce(((place < F.col("cut")) | ((place == F.col("cut")) & (F.col("same") == F.col("equal"))))
                       .cast("long"), F.lit(0).cast("long"))
    copies = (F.col("base") + extra).alias("copies")
    kept = [*docs.columns, "source_size", "target"]
    if plans.filter("same > equal").isEmpty():
        return joined.select(*kept, copies)
    # Classes whose cut runs through equal hashes: numbers, written down, tell those apart.
    tie = F.coalesce((place == F.col("cut")) & (F.col("same") > F.col("equal")), F.lit(False))
    tied = materialize(joined.filter(tie).select(
        *kept, "p_source", "p_size", "base", F.xxhash64(F.monotonically_increasing_id()).alias("_tie")), "ties")
    second = smallest(
        tied.select(F.col("p_source").alias("source"), F.col("p_size").alias("size"), F.col("_tie").alias("hash")),
        plans.filter("same > equal").select(F.col("p_source").alias("s"), F.col("p_size").alias("z"),
                                            F.col("equal").alias("more")))
    second = materialize(second.select("s", "z", "cut"), "ties")
    settled = tied.join(bounded(second), F.col("p_source").eqNullSafe(F.col("s")) & (F.col("p_size") == F.col("z")))
    extra = (_unsigned(F.col("_tie")) <= F.col("cut")).cast("long")
    return joined.filter(~tie).select(*kept, copies).unionByName(
        settled.select(*kept, (F.col("base") + extra).alias("copies")))


def measured() -> list[Column]:
    return [words_in(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("hash")]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of
    ``docs (doc_id, text, source)``; ``taken`` counts the words of all copies."""
    docs = pick(docs, "doc_id", "text", "source")
    keyed = materialize(docs.select("doc_id", "source", *measured()), "sizes")
    return taken(keyed, plan(keyed, weights, most)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs (doc_id, text, source, ..)`` as often as it is
    taken, with ``copy`` (1, 2, ..) after its own columns; where they have that name already,
    underscores are added to it."""
    keyed = materialize(pick(docs, "doc_id", "text", "source")
                        .select("doc_id", "source", *measured()), "sizes")
    names = [place(docs, n) for n in ("doc_id", "text", "source")]
    sized = hide(docs).withColumns({
        "size": words_in(F.col(names[1])), "hash": F.xxhash64(*names[:2]), "source": F.col(names[2])})
    copies = taken(sized, plan(keyed, weights, most)).filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    own, name = hide(docs).columns, "copy"
    while name in docs.columns:
        name += "_"
    return copies.select(*own, "copy").toDF(*docs.columns, name)
