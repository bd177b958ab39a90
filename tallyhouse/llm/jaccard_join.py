"""N-gram Jaccard join by PartEnum signatures.

Texts are sets of three-word shingles. Two sets of sizes a <= b can be as alike as
`SHARE` percent only if ``100 a >= SHARE b`` and if they differ in at most
``(100 - SHARE) / (100 + SHARE) * (a + b)`` shingles. So sizes fall into bands
``[l, 100 l / SHARE]``; a set takes part in its own band and in the next one, where the other
set of a pair may be. In a band whose largest size is u, alike sets differ in at most
``k = 2 u (100 - SHARE) / (100 + SHARE)`` shingles. The domain of shingles is hashed into
first-level parts, each of these into second-level parts, and the sets must agree in all but
a few second-level parts of some first-level part; each choice of the parts to leave out is a
signature (`scheme`). Sets that are alike share at least one; each that share one are compared.
There are a few more second-level parts than shingles that alike sets can differ in, so such sets
agree in several; parts in which a set has nothing are then no signature of it, unless it has
many of them. Otherwise all sets with an empty part would share that signature.

1. Equal sets are one *node*, known by a 64-bit hash of the set and its size.
2. Nodes that share a signature with no other node are left out: (signature, node) rows are
   shuffled by signature once, and a signature stays if its least and greatest node differ.
3. Rounds: at first each node is compared with one other, the first node of a signature of
   its, the one with most signatures in common; links join components. Then, within each
   signature whose nodes are not yet all in one component, the first 32 nodes are compared
   with all others, in the next round the first 1,024, and so on, up to all. Pairs in one
   component need no comparison. So every pair that could join components is compared, but
   pairs within a group of copies are not written out.
4. Pairs meet as marks first, which are about as many bits as a set has shingles (`fine_marks`):
   sets differ in at least as many shingles as their marks differ in. Of the pairs that may still
   be alike, each node's nearest one is compared by its sets, then of those still needed its 8
   nearest, its 64 nearest, and so on, so sets travel for few more pairs than join components.
5. Comparisons are exact (`100 * common >= SHARE * union`), by joins of the shingle sets.
6. Pairs are found by some of the signatures at a time, told apart by their marks and compared by
   their sets some at a time (`passes`), each time in a job of its own whose shuffles go before the
   next one's: what one shuffles is bounded by a share of all sets, however many pairs there are.

Words are runs of bytes other than U+0020 and U+0009 to U+000D after A-Z are lower-cased.
A text of one or two words has its whole sequence as one shingle.

Edge cases: a null text, and one without words, has no shingles, is linked with nothing and
is its own component. A null id sorts after all others; a component of null ids only is null.
Rows that repeat, or share an id, are classed each by their own text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import (bounded, byte_texts, components, map_batches, marked, mix, pick,
                                   place, real_id, row_key, shingles, slices, split_by_key,
                                   unhide, words_of)
from tallyhouse.session import forget_shuffles, in_passes, materialize, settled

WORDS = 3
#: Percent of the union that two sets must have in common.
SHARE = 90
#: A first-level part may differ in so many shingles, and has so many second-level parts.
SLACK, SECOND = 1, 2
#: So many second-level parts more than shingles that alike sets can differ in.
SPARE = 4
#: Each round compares so many times as many first nodes of a group with all others.
GROWTH = 32
#: Each pass of a round compares so many times as many nearest nodes of a node by their sets.
WIDEN = 8
#: One pass over signatures or pairs shuffles about one `PASS`-th of what all sets take, or so many
#: shingles of 8 bytes if that is more; a row with marks takes as much as so many shingles.
PASS, LEAST_PASS, ROW = 2, 1_000_000, 12
_SEEN = 1_000_000
_MARKS = [f"m{i}" for i in range(8)]


def band(size: int, share: int = SHARE) -> int:
    """Which band a set of so many shingles is in."""
    low = number = 1
    while low * 100 // share < size:
        low, number = low * 100 // share + 1, number + 1
    return number


def band_limit(number: int, share: int = SHARE) -> int:
    """The largest size in a band."""
    low = 1
    for _ in range(number - 1):
        low = low * 100 // share + 1
    return low * 100 // share


def differences(number: int, share: int = SHARE) -> int:
    """Shingles that alike sets of a band can differ in; where none, only equal sets are alike."""
    return 2 * band_limit(number, share) * (100 - share) // (100 + share)


def scheme(number: int, share: int = SHARE, slack: int = SLACK,
           second: int = SECOND) -> tuple[int, int, int]:
    """First-level parts, second-level parts in each, and how many of these a signature
    leaves out. Sets that differ in k shingles differ in at most k // parts in some part,
    hence in at most so many of its second-level parts."""
    k = differences(number, share)
    second = max(second, slack + 1)
    first = k // (slack + 1) + 1 + SPARE // second
    return first, second, max(k // first, min(slack, second - 1))


def signatures(sets: list[np.ndarray], numbers: list[int], share: int, slack: int,
               second: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of several sets, each in the band given: whose, and what."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    schemes = {n: scheme(n, share, slack, second) for n in set(numbers)}
    first, parts, out = (np.array([schemes[n][i] for n in numbers], np.int64) for i in range(3))
    salt = mix(np.array(numbers, np.uint64))
    cells = np.concatenate(([0], np.cumsum(first * parts)))
    place = mix(every ^ salt[row])
    cell = cells[row] + (place % (first * parts)[row].astype(np.uint64)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(every[order] + np.uint64(1)))))
    edge = np.searchsorted(cell[order], np.arange(cells[-1] + 1))
    value = total[edge[1:]] - total[edge[:-1]]
    counts = np.diff(edge)
    owner = np.repeat(np.arange(len(sets)), first * parts)
    empty = np.bincount(owner[counts == 0], minlength=len(sets))
    spare = first * parts - np.array([differences(n, share) for n in numbers], np.int64)
    local = np.arange(cells[-1]) - cells[owner]
    owners, found = [], []
    for p, o in sorted({(p, o) for _, p, o in schemes.values()}):
        mine = ((parts == p) & (out == o))[owner]
        own, val, loc = owner[mine][::p], value[mine].reshape(-1, p), local[mine][::p] // p
        for c, keep in enumerate(combinations(range(p), p - o)):
            kept = mix(val[:, list(keep)] + np.arange(len(keep), dtype=np.uint64)[None, :])
            name = salt[own] + loc.astype(np.uint64) * np.uint64(1000003) + np.uint64(c)
            told = np.ones(len(own), bool)
            if p - o == 1:
                # Alike sets agree in `spare` cells or more, so one that both have something in
                # is among them, unless both have at least so many empty ones.
                told = (counts[mine][c::p] > 0) | (empty[own] >= spare[own])
            owners.append(own[told])
            found.append(mix(kept.sum(1) ^ mix(name))[told])
    return (np.concatenate(owners) if owners else np.zeros(0, np.int64),
            np.concatenate(found) if found else np.zeros(0, np.uint64))


def _node(every: np.ndarray) -> int:
    if not len(every):
        return 0
    whole = mix(every).sum(dtype=np.uint64) ^ mix(every + np.uint64(7)).sum(dtype=np.uint64)
    return int(mix(np.array([whole + np.uint64(len(every))]))[0].view(np.int64))


def _texts_of(batch: pa.RecordBatch, words: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Shingle sets of the texts of a batch, in slices."""
    texts = [t.lower() for t in byte_texts(batch.column("text"))]
    for part in slices(texts):
        yield part, list(shingles(*words_of(texts[part]), words))


def _profiles(words: int):
    """Per text: its node and its size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _texts_of(batch, words):
                rows = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("_d", "_h")]
                yield pa.RecordBatch.from_arrays(
                    [*rows, pa.array([_node(s) for s in sets], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int32())], ["_d", "_h", "node", "n"])

    return run


def _signed(words: int, share: int, slack: int, second: int):
    """The signatures of each node, once per task and node."""
    bands: dict[int, int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, sets in _texts_of(batch, words):
                todo, numbers, nodes = [], [], []
                for s in sets:
                    node = _node(s)
                    if not len(s) or node in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(node)
                    if len(s) not in bands:
                        bands[len(s)] = band(len(s), share)
                    for number in (bands[len(s)], bands[len(s)] + 1):
                        if differences(number, share):
                            todo.append(s)
                            numbers.append(number)
                            nodes.append(node)
                owner, found = signatures(todo, numbers, share, slack, second)
                sizes = np.array([len(s) for s in todo], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(np.array(nodes, np.int64)[owner]),
                     pa.array(sizes[owner])], ["sig", "node", "n"])

    return run


def _marks(every: np.ndarray) -> np.ndarray:
    """Which cells of a few hundred hold an odd number of shingles, as bits of 64-bit numbers.
    Each shingle that two sets differ in can change one cell."""
    cells = np.bincount((mix(every) % np.uint64(64 * len(_MARKS))).astype(np.int64),
                        minlength=64 * len(_MARKS)) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def fine_marks(every: np.ndarray) -> np.ndarray:
    """The same with half as many cells as the set has shingles, or up to as many: a power of two.
    Empty where `_marks` has as many."""
    words = 1 << max(len(every) - 1, 0).bit_length() >> 7
    if words <= len(_MARKS):
        return np.zeros(0, np.int64)
    cells = np.bincount((mix(every) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _places_apart(one: str, other: str) -> Column:
    """In how many places the marks of two sets differ."""
    return sum((F.bit_count(F.col(one + m).bitwiseXOR(F.col(other + m))) for m in _MARKS), F.lit(0))


def fine_apart(x: Column, y: Column) -> Column:
    """The same of fine marks; the longer ones are folded to the length of the shorter, and 0
    where they differ in length by more than that, or are empty."""
    size = F.least(F.size(x), F.size(y))

    def half(marks: Column) -> Column:
        return F.when(F.size(marks) == size, marks).otherwise(F.zip_with(
            F.slice(marks, 1, size), F.slice(marks, size + 1, size), lambda a, b: a.bitwiseXOR(b)))

    differ = F.zip_with(half(x), half(y), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.when((size > 0) & (F.greatest(F.size(x), F.size(y)) <= 2 * size), F.aggregate(
        differ, F.lit(0), lambda total, n: total + n)).otherwise(0)


def _may_be_alike(apart: Column, share: int) -> Column:
    """False where the marks of two sets (with ``n`` and ``pn`` shingles) differ in more places
    than alike sets can: sets cannot differ in fewer shingles than their marks differ in."""
    return apart * (100 + share) <= (F.col("n") + F.col("pn")) * (100 - share)


def _node_marks(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _texts_of(batch, words):
                marks = np.array([_marks(s) for s in sets]).reshape(-1, len(_MARKS))
                fine = pa.array([fine_marks(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()),
                                                  *map(pa.array, marks.T), fine], ["node", *_MARKS, "fine"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _texts_of(batch, words):
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(s) for s in sets], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                    ["node", "items"])

    return run


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``_d, _h, node, n`` of each row of ``docs (_d, _h, text)``, written."""
    return materialize(map_batches(docs, _profiles(words), "_d long, _h long, node long, n int"), "profiles")


def shared_signatures(docs: DataFrame, words: int = WORDS, share: int = SHARE, slack: int = SLACK,
                      second: int = SECOND) -> DataFrame:
    """``sig, node, n`` of the signatures that more than one node has. Signatures are made
    where they are shuffled, once, and a row is 20 bytes; the window over a signature spills."""
    listed = map_batches(docs.select("text"), _signed(words, share, slack, second),
                         "sig long, node long, n int")
    same = Window.partitionBy("sig")
    return (listed.withColumns({"lo": F.min("node").over(same), "hi": F.max("node").over(same)})
            .filter("lo < hi").select("sig", "node", "n").distinct())


def passes(shingles: int, whole: int) -> int:
    """How many passes move what takes as much as so many shingles, if all sets have ``whole``."""
    return max(1, -(-shingles // max(whole // PASS, LEAST_PASS)))


def node_components(docs: DataFrame, found: DataFrame, words: int = WORDS, share: int = SHARE,
                    slack: int = SLACK, second: int = SECOND) -> DataFrame | None:
    """``node, component`` for nodes with links; None if there are none."""
    members = materialize(shared_signatures(docs, words, share, slack, second), "members")
    forget_shuffles(docs.sparkSession)
    if members.isEmpty():
        return None
    whole = found.agg(F.sum("n")).first()[0]
    nodes = members.select("node").distinct()
    # Of each node that shares a signature one text, and marks; sets only of pairs to be compared.
    texts = materialize(found.join(nodes, "node", "left_semi").groupBy("node")
                        .agg(F.min(F.struct("_d", "_h")).alias("k")).select("node", "k.*"), "node-texts")

    def of_texts(keys: DataFrame, run: Callable, schema: str) -> DataFrame:
        here, _ = split_by_key(docs, keys, ["_d", "_h"])
        return map_batches(here.select("text"), run, schema).dropDuplicates(["node"])

    keys = materialize(texts.select("_d", "_h").distinct(), "keys")
    marked_ = materialize(of_texts(keys, _node_marks(words), "node long, " + ", ".join(
        f"{m} long" for m in _MARKS) + ", fine array<long>"), "marks")
    coarse, fine = bounded(marked_.drop("fine")), bounded(marked_.select("node", "fine"))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs that may be alike by their fine marks too, and the share they are apart at least."""
        for side, name in (("a", "x"), ("b", "y")):
            pairs = pairs.join(fine.select(F.col("node").alias(side), F.col("fine").alias(name)), side)
        pairs = pairs.withColumn("apart", F.greatest("apart", fine_apart(F.col("x"), F.col("y"))))
        return pairs.filter(_may_be_alike(F.col("apart"), share)).select(
            "a", "b", "common", (F.col("apart") / (F.col("n") + F.col("pn"))).alias("far"),
            (F.col("n") + F.col("pn")).alias("size"))

    def judged(pairs: DataFrame) -> DataFrame:
        """``a, b, alike`` by the shingle sets, which travel once a pair."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        keys = materialize(texts.join(asked, "node", "left_semi").select("_d", "_h").distinct(), "keys")
        sized = materialize(of_texts(keys, _sets(words), "node long, items array<long>"), "sets")
        forget_shuffles(docs.sparkSession)
        common = F.size(F.array_intersect("x", "y"))

        def compared(some: DataFrame) -> DataFrame:
            both = (some.select("a", "b")
                    .join(sized.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
                    .join(sized.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"))
            return both.select("a", "b", (
                common * 100 >= (F.size("x") + F.size("y") - common) * share).alias("alike"))

        moved = pairs.agg(F.sum("size")).first()[0] or 0
        return in_passes(pairs, "b", passes(moved, whole), compared, "compared")

    links = apart = joined = None
    first, done = 1, 0  # how many nodes of a group are compared with all others; were before
    while True:
        live = members.withColumn("c", F.col("node")) if joined is None else (
            _with_component(members, joined, "node", "c").select("sig", "node", "n", "c"))
        if joined is not None:
            open_ = (live.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                             F.count("*").alias("size"))
                     .filter((F.col("lo") < F.col("hi")) & (F.col("size") > done)).select("sig"))
            live = live.join(open_, "sig").join(coarse, "node")
            live = materialize(live, "open")
            if live.isEmpty():
                return joined
        marks = [] if joined is None else _MARKS
        close = ((F.least("n", "pn") * 100 >= F.greatest("n", "pn") * share)
                 & (F.col("c") != F.col("pc")))
        places = _places_apart("", "p") if marks else F.lit(0)
        if marks:  # sets cannot differ in fewer shingles than their marks differ in
            close &= _may_be_alike(places, share)

        def summed(pairs: DataFrame) -> DataFrame:
            return pairs.groupBy("a", "b").agg(F.sum("common").alias("common"), *[
                F.max(c).alias(c) for c in ("n", "pn", "apart")])

        def met(some: DataFrame) -> DataFrame:
            """The first nodes of each signature with all others."""
            ahead = (some.withColumn("rank", F.row_number().over(
                Window.partitionBy("sig").orderBy("node"))).filter(F.col("rank") <= first)
                .select(F.col("sig").alias("psig"), F.col("node").alias("p"), F.col("n").alias("pn"),
                        F.col("c").alias("pc"), *[F.col(m).alias(f"p{m}") for m in marks]))
            return summed(some.join(ahead, (F.col("sig") == F.col("psig")) & close).select(
                F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b"),
                F.lit(1).alias("common"), "n", "pn", places.alias("apart")))

        def told_apart(some: DataFrame) -> DataFrame:
            """Those that marks leave, and that were not compared before."""
            some = summed(some)
            if apart is not None:
                some = some.join(apart, ["a", "b"], "left_anti")
            if not marks:
                for side, name in (("a", ""), ("b", "p")):
                    some = some.join(coarse.select(
                        F.col("node").alias(side), *[F.col(m).alias(f"{name}{m}") for m in _MARKS]), side)
                some = some.withColumn("apart", _places_apart("", "p")).filter(
                    _may_be_alike(F.col("apart"), share)).select("a", "b", "common", "n", "pn", "apart")
            return near(some)

        def new_pairs() -> DataFrame:
            number = passes(live.count() * (ROW if marks else 2), whole)
            pairs = in_passes(live, "sig", number, met, "met")
            # A pair travels with the fine marks of one of its nodes: a bit a shingle.
            moved = pairs.agg(F.sum((F.col("n") + F.col("pn")) / 128 + ROW / 3)).first()[0] or 0
            return in_passes(pairs, "a", passes(int(moved), whole), told_apart, "told-apart")

        pairs = in_passes(live, "sig", 1, lambda _: new_pairs(), "pairs")
        best = [F.desc("common"), "b"] if joined is None else ["far", "b"]
        width = 1
        while not pairs.isEmpty():
            ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(*best)))
            chosen = materialize(ranked.filter(F.col("rank") <= width).select("a", "b", "size"), "chosen")
            forget_shuffles(docs.sparkSession)
            told = settled(docs.sparkSession, lambda: judged(chosen), "judged")
            new = told.filter("alike").select("a", "b")
            not_alike = told.filter("NOT alike").select("a", "b")
            apart = not_alike if apart is None else apart.union(not_alike)
            if links is None or not new.isEmpty():
                links = new if links is None else links.union(new)
                joined = components(links, "components")
            if first == 1:  # to begin with, each node's most promising pair
                break
            pairs = pairs.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
            for side in ("a", "b"):
                pairs = _with_component(pairs, joined, side, f"c{side}")
            pairs = materialize(pairs.filter("ca <> cb").select("a", "b", "common", "far", "size"), "pairs")
            width *= WIDEN
        if joined is None:
            links = pairs.select("a", "b")
            joined = components(links, "components")
        if first > 1:
            done = first
        first *= GROWTH


def _with_component(rows: DataFrame, joined: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of their column ``node``; a node without links is its own."""
    of = joined.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(of, node, "left").withColumn(name, F.coalesce(name, node))


def classify(docs: DataFrame, words: int = WORDS, share: int = SHARE, slack: int = SLACK,
             second: int = SECOND) -> DataFrame:
    """``_d, _h, n, component, c`` of each row of ``docs (_d, _h, text)``: the least ``_d`` that
    links lead to, and the group of linked nodes itself (null without shingles). Groups whose
    least id is equal or missing differ in ``c`` only."""
    found = profiles(docs, words)
    joined = node_components(docs, found, words, share, slack, second)
    linked = found.filter("n > 0")
    classes = linked.groupBy("node", "n").agg(F.min("_d").alias("least")).withColumn("c", F.col("node"))
    if joined is not None:
        classes = (classes.drop("c").join(joined, "node", "left")
                   .withColumn("c", F.coalesce("component", "node")))
        heads = classes.groupBy("c").agg(F.min("least").alias("head"))
        classes = classes.join(heads, "c").select("node", "n", F.col("head").alias("least"), "c")
    rows = linked.select("_d", "_h", "node", "n").join(classes, ["node", "n"]).select(
        "_d", "_h", "n", F.col("least").alias("component"), "c")
    return rows.unionByName(found.filter("n = 0").select(
        "_d", "_h", "n", F.col("_d").alias("component"), F.lit(None).cast("long").alias("c")))


def similarity_classes(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs (doc_id, text)``."""
    keyed = pick(docs, "doc_id", "text").select(*row_key(F.col("doc_id"), F.col("text")), "text")
    return classify(keyed, words, share).select(
        real_id(F.col("_d")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        real_id(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """The rows of ``docs (doc_id, text, ..)`` without those that are linked, at any remove,
    with a row before them (by id, then by a hash of the text, then equal)."""
    keyed = marked(docs).select("_d", "_h", F.col(place(docs, "text")).alias("text"))
    rows = materialize(classify(keyed, words, share).filter("n > 0").select("_d", "_h", "c"), "classes")
    heads = rows.groupBy("c").agg(F.min(F.struct("_d", "_h")).alias("keep"))
    first = rows.join(heads, "c").withColumn("one", F.struct("_d", "_h") == F.col("keep"))
    lost = materialize(first.filter(~F.col("one")).select("_d", "_h").distinct(), "lost")
    again = materialize(first.filter("one").groupBy("_d", "_h").count()
                        .filter("count > 1").select("_d", "_h"), "again")
    _, kept = split_by_key(marked(docs), lost, ["_d", "_h"])
    if again.isEmpty():
        return unhide(kept, docs)
    more, single = split_by_key(kept, again, ["_d", "_h"])
    return unhide(single.unionByName(more.dropDuplicates(["_d", "_h"])), docs)
