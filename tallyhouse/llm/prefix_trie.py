"""Prefix trie of rebuilt conversations, with a count-min sketch in front of the shuffle.

**Rebuilding.** A conversation's turns are ordered by turn (null first), then role, then the
SHA-256 of the text. Conversation c is rebuilt as the first h turns of conversation
``c - c % BRANCHES`` (all of them if there are fewer) and its own turns after its first h;
h is ``crc32(decimal c) % HEADS``.

**Nodes.** Each distinct sequence of first d turns is a node. It is known by its digest: the
exclusive or, twice 64 bits, of a hash of each turn's depth, role and text digest. Digests of
all prefixes of a conversation are a running aggregate along its turns (`running`), which
is taken in range blocks with what earlier blocks carry over, so a conversation may span
any number of tasks. Texts leave the first stage as digests and lengths only.

**Screening.** Each task counts its prefix digests in a count-min sketch of a fixed size
(`WIDTH` x `ROWS` cells that stop at 2); the sketches are added cell by cell. A sketch never
counts too little, so an estimate of 1 proves that only one conversation has the prefix:
its node is complete as it stands and is given out where it is. Only prefixes with an estimate of
2 are shuffled by digest and grouped exactly. A larger table fills the sketch and sends more
prefixes through the exact grouping; results do not depend on it.

**Sums over subtrees** need no walk through the tree. A node's smallest member represents it,
and a conversation represents the nodes on its path from some depth on. So a subtree's sum
is the sum over its members of what each represents in it: all of it for members that
start to represent below the node, a running sum from the end for the representative itself.

Hot groups: nodes are counted with partial sums; the few parents that have more than 1/4096
of all nodes as children are joined by broadcast, others by key; ids of conversations that
end at a node are sorted over range blocks, written out in lists of at most `LIST` ids, and
hashed as a stream.

Edge cases: a null role or text is empty; rows with a null conv_id belong to no conversation;
rows that repeat are turns of their own; a conversation whose base is absent and that has no
turns after its first h is turnless and a member of the root only. Without conversations
there are no nodes. Columns other than conv_id, turn, role and text are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import map_batches, mix, pick
from tallyhouse.session import materialize

#: A conversation starts like the one whose id is the next lower multiple of this.
BRANCHES = 5
#: It has fewer than so many turns from there.
HEADS = 9
#: Cells in each row of the sketch, and rows; a cell is a byte.
WIDTH, ROWS = 1 << 21, 4
#: Keys with more than 1/SHARE of the rows are fewer than SHARE.
SHARE = 4096
#: Ids in one list.
LIST = 10_000
_CHUNK = 1 << 16

_NEUTRAL = {"count": 0, "sum": 0, "xor": 0}
_AGGREGATE = {"count": F.count, "sum": F.sum, "xor": F.bit_xor}


def running(df: DataFrame, key: str, order: list[str], label: str,
            **columns: tuple[str, str]) -> DataFrame:
    """``df`` with running aggregates of each ``key`` in the given order, own row included.

    ``columns`` gives each new column its kind (count, sum or xor) and the column it is over.
    Rows lie in range blocks; the totals of earlier blocks are carried into the blocks that
    a key spans, which are one key a block at most.
    """
    ordered = materialize(df.repartitionByRange(key, *order)
                          .withColumn("_block", F.spark_partition_id()), label)
    totals = {n: _AGGREGATE[kind](c) for n, (kind, c) in columns.items()}
    first = ordered.groupBy("_block").agg(F.min(key).alias(key)).select(key).distinct()
    spans = (ordered.join(F.broadcast(first), key).groupBy(key, "_block")
             .agg(*[t.alias(n) for n, t in totals.items()]).collect())
    carried, state = [], {}
    for row in sorted(spans, key=lambda r: (r[key], r["_block"])):
        before = state.get(row[key])
        if before is not None:
            carried.append((row[key], row["_block"], *before.values()))
        before = before or {n: _NEUTRAL[kind] for n, (kind, _) in columns.items()}
        state[row[key]] = {n: before[n] ^ row[n] if kind == "xor" else before[n] + row[n]
                           for n, (kind, _) in columns.items()}
    schema = f"{key} long, _block int, " + ", ".join(f"_{n} long" for n in columns)
    carry = df.sparkSession.createDataFrame(carried, schema)
    rows = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.withColumns({n: t.over(rows) for n, t in totals.items()}).join(
        F.broadcast(carry), [key, "_block"], "left")

    def joined(name: str, kind: str) -> Column:
        before = F.coalesce(f"_{name}", F.lit(0))
        return F.col(name).bitwiseXOR(before) if kind == "xor" else F.col(name) + before

    return out.select(*df.columns, *[joined(n, kind).alias(n) for n, (kind, _) in columns.items()])


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("long")


def _hashes(depth: Column) -> list[Column]:
    return [F.xxhash64(depth, "role", "sha").alias("x1"),
            F.xxhash64("sha", depth, "role", F.lit("second")).alias("x2")]


def prefixes(conversations: DataFrame) -> DataFrame:
    """``c, depth, k1, k2, p1, p2, bytes, last``: every prefix of every rebuilt conversation,
    its digest and its parent's, the bytes of its last text, and whether it is the whole. Written."""
    text = F.coalesce("text", F.lit(""))
    turns = pick(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("tie")).filter("c IS NOT NULL")
    own = materialize(running(turns, "c", ["turn", "role", "sha", "tie"], "turns", i=("count", "c"))
                      .drop("turn", "tie"), "numbered")
    convs = own.groupBy("c").agg(F.count("*").alias("n")).select(
        "c", "n", (F.col("c") - F.col("c") % BRANCHES).alias("base"), head_length(F.col("c")).alias("h"))
    bases = own.filter((F.col("c") % BRANCHES == 0) & (F.col("i") < HEADS)).withColumnRenamed("c", "base")
    heads = materialize(convs.join(bases, "base").filter("i <= h").select(
        "c", F.col("i").alias("depth"), "bytes", *_hashes(F.col("i"))), "heads")
    shared = heads.groupBy("c").agg(F.count("*").alias("m"), F.bit_xor("x1").alias("h1"),
                                    F.bit_xor("x2").alias("h2"))
    zero = F.lit(0).cast("long")
    convs = materialize(convs.join(shared, "c", "left").select(
        "c", "h", *[F.coalesce(x, zero).alias(x) for x in ("m", "h1", "h2")],
        (F.coalesce("m", zero) + F.greatest(F.col("n") - F.col("h"), zero)).alias("length")), "rebuilt")
    depth = F.col("i") - F.col("h") + F.col("m")
    tails = own.filter(F.col("i") > head_length(F.col("c"))).join(convs, "c").select(
        "c", depth.alias("depth"), "bytes", *_hashes(depth), "h1", "h2", "length")
    tails = running(tails, "c", ["depth"], "tails", r1=("xor", "x1"), r2=("xor", "x2")).select(
        "c", "depth", "bytes", "x1", "x2", F.col("r1").bitwiseXOR(F.col("h1")).alias("k1"),
        F.col("r2").bitwiseXOR(F.col("h2")).alias("k2"), "length")
    upto = Window.partitionBy("c").orderBy("depth")  # at most HEADS rows
    heads = heads.select("*", F.bit_xor("x1").over(upto).alias("k1"), F.bit_xor("x2").over(upto).alias("k2")
                         ).join(convs.select("c", "length"), "c").select(*tails.columns)
    none = F.lit(None).cast("long")
    roots = convs.select("c", zero.alias("depth"), zero.alias("bytes"), zero.alias("k1"), zero.alias("k2"),
                         none.alias("p1"), none.alias("p2"), (F.col("length") == 0).alias("last"))
    return materialize(heads.unionByName(tails).select(
        "c", "depth", "bytes", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"),
        (F.col("depth") == F.col("length")).alias("last")).unionByName(roots), "prefixes")


def _cells(digests: np.ndarray, width: int, rows: int) -> Iterator[np.ndarray]:
    """Places of ``digests`` in each row of the sketch, rows one after another."""
    for row in range(rows):
        salt = np.uint64((row + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        yield (mix(digests ^ salt) % np.uint64(width)).astype(np.int64) + row * width


def _count(width: int, rows: int):
    """One task's sketch, as the cells that are not 0, by chunks of cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(width * rows, np.uint8)
        for batch in batches:
            for cells in _cells(batch.column("k1").to_numpy().view(np.uint64), width, rows):
                at, n = np.unique(cells, return_counts=True)
                sketch[at] = np.minimum(sketch[at] + np.minimum(n, 2).astype(np.uint8), 2)
        for start in range(0, len(sketch), _CHUNK):
            at = np.flatnonzero(sketch[start: start + _CHUNK]).astype(np.int32)
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([start // _CHUNK], pa.int32()), "at": pa.array([at]),
                    "n": pa.array([sketch[start: start + _CHUNK][at].tobytes()], pa.binary())})

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the sketches of each chunk; rows come sorted by chunk."""
    now, cells = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()),
                                           "n": pa.array([cells.tobytes()], pa.binary())})

    for batch in batches:
        for chunk, at, n in zip(*[batch.column(c) for c in ("chunk", "at", "n")]):
            if chunk.as_py() != now:
                if now is not None:
                    yield done()
                now, cells = chunk.as_py(), np.zeros(_CHUNK, np.uint8)
            at = at.values.to_numpy()
            cells[at] = np.minimum(cells[at] + np.frombuffer(n.as_py(), np.uint8), 2)
    if now is not None:
        yield done()


def sketch(digests: DataFrame, width: int = WIDTH, rows: int = ROWS) -> np.ndarray:
    """The count-min sketch of ``digests (k1)``; ``width * rows`` bytes, whatever the table."""
    parts = map_batches(digests, _count(width, rows), "chunk int, at array<int>, n binary")
    merged = map_batches(parts.repartition("chunk").sortWithinPartitions("chunk"), _add,
                         "chunk int, n binary")
    cells = np.zeros(-(-width * rows // _CHUNK) * _CHUNK, np.uint8)
    for row in merged.toLocalIterator():
        cells[row["chunk"] * _CHUNK:][:_CHUNK] = np.frombuffer(row["n"], np.uint8)
    return cells[: width * rows]


def _screen(shared, width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(shared.value, np.uint8)

        def maybe(digests: pa.Array) -> pa.Array:
            """Whether the estimate is over 1; the root always counts as shared."""
            values = digests.fill_null(0).to_numpy().view(np.uint64)
            least = np.full(len(values), 2, np.uint8)
            for at in _cells(values, width, rows):
                np.minimum(least, cells[at], out=least)
            return pa.array((least > 1) | (values == 0))

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, maybe(batch.column("k1")), maybe(batch.column("p1"))],
                [*batch.schema.names, "shared", "parent_shared"])

    return run


def screened(rows: DataFrame, width: int = WIDTH, depth: int = ROWS) -> DataFrame:
    """``rows`` of `prefixes` with ``shared`` and ``parent_shared``: false where the sketch
    proves that one conversation only has the prefix, or the parent. Written."""
    cells = sketch(rows.filter("depth > 0").select("k1"), width, depth)
    sent = rows.sparkSession.sparkContext.broadcast(cells.tobytes())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return materialize(map_batches(rows, _screen(sent, width, depth),
                                   schema + ", shared boolean, parent_shared boolean"), "screened")


def _lists(most: int):
    """Ids of rows sorted by (k1, k2, c) as comma-joined lists, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = TaskContext.get().partitionId(), 0
        key, ids = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "k1": pa.array([key[0]], pa.int64()), "k2": pa.array([key[1]], pa.int64()),
                "block": pa.array([block], pa.int32()), "number": pa.array([number], pa.int64()),
                "ids": pa.array([",".join(map(str, ids))])})

        for batch in batches:
            for k1, k2, c in zip(*[batch.column(x).to_pylist() for x in ("k1", "k2", "c")]):
                if (k1, k2) != key or len(ids) >= most:
                    if ids:
                        yield done()
                        number += 1
                    key, ids = (k1, k2), []
                ids.append(c)
        if ids:
            yield done()

    return run


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lists, which come in order, without holding them."""
    key = state = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "k1": pa.array([key[0]], pa.int64()), "k2": pa.array([key[1]], pa.int64()),
            "ends": pa.array([state.hexdigest()])})

    for batch in batches:
        for k1, k2, ids in zip(*[batch.column(x).to_pylist() for x in ("k1", "k2", "ids")]):
            if (k1, k2) != key:
                if key is not None:
                    yield done()
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if key is not None:
        yield done()


def ends(rows: DataFrame, most: int = LIST) -> DataFrame:
    """``k1, k2, ends``: the digest of the sorted ids ``c`` of each key of ``rows (k1, k2, c)``."""
    placed = rows.select("k1", "k2", "c").repartitionByRange("k1", "k2", "c").sortWithinPartitions(
        "k1", "k2", "c")
    lists = map_batches(placed, _lists(most), "k1 long, k2 long, block int, number long, ids string")
    in_order = lists.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block", "number")
    return map_batches(in_order, _hash_lists, "k1 long, k2 long, ends string")


def _with_parents(rows: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``rows (.., p1, p2)`` with ``parent_conv_id`` from ``nodes (k1, k2, rep, n_children)``."""
    named = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                         F.col("rep").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") * SHARE > total
    hot = F.broadcast(named.filter(many).drop("n_children"))
    at_hot = rows.join(hot, ["p1", "p2"])
    others = rows.join(hot, ["p1", "p2"], "left_anti")
    rest = others.join(named.filter(~many).drop("n_children"), ["p1", "p2"], "left")
    return at_hot.unionByName(rest)


def trie(conversations: DataFrame, width: int = WIDTH, depth: int = ROWS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256`` of every node over ``conversations (conv_id, turn, role, text)``."""
    rows = screened(prefixes(conversations), width, depth)
    maybe, single = rows.filter("shared"), rows.filter("NOT shared")
    key = ["k1", "k2"]
    exact = materialize(maybe.groupBy(*key).agg(
        F.count("*").alias("n_convs"), F.min("c").alias("rep"), F.min("depth").alias("depth"),
        F.min("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "nodes")
    tops = single.filter("parent_shared")  # where a conversation leaves the shared part
    children = (exact.select("p1", "p2").unionAll(tops.select("p1", "p2")).groupBy("p1", "p2")
                .agg(F.count("*").alias("n_children"))
                .select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children"))
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = materialize(exact.join(children, key, "left").select(
        *exact.columns, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        saved.alias("saved"), (-F.col("depth")).alias("up")), "nodes")
    # What each conversation represents: from which depth on, how much in all, and a leaf or not.
    own = nodes.groupBy("rep").agg(
        F.min("depth").alias("start"), F.sum("saved").alias("all"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    none = F.lit(None).cast("long")
    alone = single.filter("last").select(F.col("c").alias("rep"), none.alias("start"),
                                         F.lit(0).cast("long").alias("all"), F.lit(1).cast("long").alias("leaf"))
    own = (own.unionByName(alone).groupBy(F.col("rep").alias("c")).agg(
        F.min("start").alias("start"), F.sum("all").alias("all"), F.max("leaf").alias("leaf"))
        .filter((F.col("all") > 0) | (F.col("leaf") > 0)))
    under = (F.col("start").isNull()) | (F.col("depth") < F.col("start"))
    sums = maybe.select(*key, "c", "depth").join(own, "c").groupBy(*key).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.when(under, F.col("all")).otherwise(0)).alias("below"))
    path = running(nodes, "rep", ["up"], "paths", from_here=("sum", "saved"))
    ended = ends(maybe.filter("last"))
    nothing = hashlib.sha256(b"").hexdigest()
    total = rows.count()
    # A node whose parent was not grouped has a parent with one member, the node's own.
    parent = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("rep")))
    grouped = _with_parents(path.join(sums, key, "left").join(ended, key, "left"), nodes, total).select(
        F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves",
        (F.col("from_here") + F.coalesce("below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))

    def local(part: DataFrame, parent: str) -> DataFrame:
        one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
        return part.select(
            F.col("c").alias("conv_id"), "depth", F.col(parent).alias("parent_conv_id"),
            one.alias("n_convs"), F.when(F.col("last"), no).otherwise(one).alias("n_children"),
            one.alias("n_leaves"), no.alias("saved_tokens"),
            F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))

    return (grouped.unionByName(local(single.filter("NOT parent_shared"), "c"))
            .unionByName(local(_with_parents(tops, nodes, total), "parent_conv_id")))
