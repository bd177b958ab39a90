"""What the text operators share: column picking, row keys, checked joins, word hashes.

**Columns.** Operators name the columns they need; `pick` takes exactly these (by exact
spelling, the first of several) and drops everything else, so extra columns with clashing
names never meet the operators' own.

**Rows.** A row is known by ``(_d, _h)``: its id (missing ids sort after all others) and a
64-bit hash of its text. The key is a function of the row alone, so a task that runs again
gives the same keys. Rows that repeat in full share a key.

**Hashes.** Words are hashed eight bytes at a time with a mixing step after each eight, so that
no sum over positions can cancel out (words of more than 64 bytes by a library's 64-bit hash);
all arithmetic is on whole arrays. Texts are worked on in blocks of about a megabyte, cut at
white space, so that a very long text needs memory only for its words.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

from tallyhouse.session import materialize

#: Stands for a missing id: after all others.
NO_ID = (1 << 63) - 1
#: A table of up to so many bytes may be broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20
#: What a row takes in a broadcast table besides its texts, and a column of it.
_ROW_BYTES, _COLUMN_BYTES = 48, 16

_BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    name = f"tallyhouse-{context.applicationId}.zip"
    if any(name in str(f) for f in context.listFiles):
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="tallyhouse-"), name)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df`` through ``run``, which maps an iterator of record batches to another."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def hide(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their places, so that none can clash."""
    return df.toDF(*[f"__{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """What `hide` calls a column: the first of exactly this spelling."""
    if name not in df.columns:
        raise ValueError(f"missing column: {name}")
    return f"__{df.columns.index(name)}"


def unhide(hidden: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df``, under their own names, of what `hide` made of it."""
    return hidden.select(*[f"__{i}" for i in range(len(df.columns))]).toDF(*df.columns)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched by exact spelling whatever else the table holds."""
    return hide(df).select(*[F.col(place(df, n)).alias(n) for n in names])


def marked(df: DataFrame) -> DataFrame:
    """`hide` of a table with ``doc_id`` and ``text``, and the rows' keys."""
    key = row_key(F.col(place(df, "doc_id")), F.col(place(df, "text")))
    return hide(df).withColumns({"_d": key[0], "_h": key[1]})


def row_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("_d"),
            F.xxhash64(doc_id.isNull(), text).alias("_h")]


def real_id(d: Column) -> Column:
    return F.when(d != NO_ID, d)


def _bytes_of(field: StructField) -> Column:
    """What a value takes beyond its column's own bytes."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, ArrayType):
        texts = F.octet_length(F.concat_ws(" ", column.cast("array<string>")))
        return F.coalesce(texts + _COLUMN_BYTES * F.size(column), F.lit(0))
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    return F.lit(0)


def bounded(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df``, which is a written table, marked for broadcast if it takes at most ``limit``
    (`BROADCAST_BYTES`) bytes, by the count of its rows and the bytes of its texts.

    A join means the same either way; beyond the limit both sides are shuffled by key.
    """
    row = sum(map(_bytes_of, df.schema), F.lit(_ROW_BYTES + _COLUMN_BYTES * len(df.columns)))
    size = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if size <= (BROADCAST_BYTES if limit is None else limit) else df


def split_by_key(df: DataFrame, keys: DataFrame, on: list[str],
                 limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key is in ``keys`` (a written table of distinct keys), and the rest."""
    keys = bounded(keys.select(*on), limit)
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def components(links: DataFrame, label: str) -> DataFrame:
    """``(node, component)`` for all ends of ``links (a, b)``: the least node it is joined to.

    Labels go down by the least label among neighbours and by jumping to the label's own
    label, each round written to the shared folder. Hubs are aggregated before the shuffle.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), label)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component")), label)
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m")))
        low = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = materialize(low.join(jump, "c").select(
            "node", F.least("c", "up").alias("component"), "old"), label)
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


# --- arrays of bytes, words and hashes ---------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LONG = 64  # bytes; longer words are hashed one by one
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _block_words(block: np.ndarray) -> np.ndarray:
    solid = ~_SPACE[block]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False]))))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    padded = np.concatenate((block, np.zeros(8, np.uint8)))
    hashes = mix(sizes.astype(np.uint64) + np.uint64(_ODD))
    todo = np.flatnonzero(sizes <= _LONG)
    done = 0
    while len(todo):  # the next 8 bytes of all words that have any left
        at, left = starts[todo] + done, sizes[todo] - done
        eight = padded[at[:, None] + np.arange(8)].view("<u8").ravel()
        hashes[todo] = mix(hashes[todo] ^ (eight & _MASKS[np.minimum(left, 8)]))
        done += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(sizes > _LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(block[starts[i]: starts[i] + sizes[i]].tobytes())
    return hashes


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space words of ``texts``, and where each text's words begin.

    White space is U+0020 and U+0009 to U+000D. The second array has one entry more than
    there are texts.
    """
    data = b" ".join(texts) + b" "
    buf = np.frombuffer(data, np.uint8)
    cuts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    parts, counts, at = [], np.zeros(len(buf) // _BLOCK + len(texts) + 2, np.int64), 0
    starts = np.zeros(len(texts) + 1, np.int64)
    done, nxt = 0, 1
    while at < len(buf):
        end = min(at + _BLOCK, len(buf))
        if end < len(buf):  # back to white space, or on to it if there is none
            space = np.flatnonzero(_SPACE[buf[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
            else:
                while end < len(buf) and not _SPACE[buf[end]]:
                    end += 1
                end = min(end + 1, len(buf))
        block = buf[at:end]
        hashes = _block_words(block)
        last = int(np.searchsorted(cuts, end, "right"))
        if last > nxt:  # texts that end in this block
            solid = ~_SPACE[block]
            first = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
            starts[nxt:last] = done + np.searchsorted(first, cuts[nxt:last] - at)
            nxt = last
        parts.append(hashes)
        done += len(hashes)
        at = end
    starts[nxt:] = done
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on; places near the end see fewer (unused)."""
    n = len(words)
    out, done, have = None, 0, {1: words}
    size = 1
    while size * 2 <= k:
        h, up = have[size], np.uint64(pow(_ODD, size, 1 << 64))
        more = mix(h) * up  # mixed at each doubling: no plain polynomial of the words
        more[: n - size] += h[size:] if n > size else 0
        size *= 2
        have[size] = more
    for size in sorted(have, reverse=True):
        if k - done >= size:
            h = have[size]
            if out is None:
                out = h.copy()
            else:
                out *= np.uint64(pow(_ODD, size, 1 << 64))
                if n > done:
                    out[: n - done] += h[done:]
            done += size
    return mix(out + np.uint64(k))


def shingles(words: np.ndarray, starts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each text.

    A text of fewer than ``k`` words, but not none, has its whole sequence as one shingle.
    """
    every = grams(words, k) if len(words) else words
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            yield np.unique(every[a: b - k + 1])
        elif b > a:
            yield grams(words[a:b], b - a)[:1]
        else:
            yield words[:0]


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; missing texts are empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = 4 << 20) -> Iterator[slice]:
    """Runs of rows with about ``most`` bytes of text each; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))
