"""Document fingerprints: bottom-k sketches of word-shingle hashes.

The sketch of a text is the ``k`` smallest distinct hashes of its shingles of five words. The
sketch of a union of texts is the ``k`` smallest of their sketches' hashes, so sketches of
parts merge (`merge`, `merge_by`). Of two sketches, the share of common hashes among the
``k`` smallest of both estimates the resemblance of the shingle sets; with the number of
distinct shingles, which the k-th smallest hash tells, it estimates their containment.

A sketch is written as text: eight base64 characters for each 48-bit hash, in rising order.

Edge cases: a text of fewer than five words, but not none, has its whole sequence as one
shingle; a null text, and one without words, has the empty sketch. Two empty sketches are
alike (1); an empty and another are not (0). Rows that repeat have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import (byte_texts, map_batches, pick, shingles, ship, slices,
                                   words_of)

#: Hashes in a sketch; the standard error of a resemblance of one half is 0.044.
SIZE = 128
WORDS = 5
_BITS = 48
_CHARS = 8


def encode(hashes: np.ndarray) -> str:
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return base64.b64encode(raw).decode("ascii")


def decode(sketch: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(sketch or ""), np.uint8).reshape(-1, _BITS // 8)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, 2:] = raw
    return full.reshape(-1).view(">u8").astype(np.uint64)


def sketch_hashes(texts: list[bytes], size: int = SIZE, words: int = WORDS) -> list[np.ndarray]:
    out = []
    for part in slices(texts):
        for every in shingles(*words_of(texts[part]), words):
            low = every[: 2 * size] >> np.uint64(64 - _BITS)
            out.append(np.unique(low)[:size] if len(low) else low)
    return out


def merge(sketches: list[str], size: int = SIZE) -> str:
    """The sketch of the union of the texts behind ``sketches``."""
    parts = [decode(s) for s in sketches]
    return encode(np.unique(np.concatenate(parts))[:size] if parts else np.zeros(0, np.uint64))


def _resemblance(a: np.ndarray, b: np.ndarray, size: int) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((counts[:size] == 2).mean())


def resemblance(a: str, b: str, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the two shingle sets; exact if both have few shingles."""
    return _resemblance(decode(a), decode(b), size)


def distinct_shingles(sketch: str, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below ``size``."""
    hashes = decode(sketch)
    if len(hashes) < size:
        return float(len(hashes))
    return (size - 1) * 2.0**_BITS / (float(hashes[-1]) + 1)


def containment(a: str, b: str, size: int = SIZE) -> float:
    """Estimated share of the shingles of ``a`` that are shingles of ``b``."""
    if not a:
        return 1.0
    alike = resemblance(a, b, size)
    both = distinct_shingles(merge([a, b], size), size)
    return min(1.0, alike * both / distinct_shingles(a, size))


def add_fingerprint(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs (.., text)`` with a ``fingerprint`` column after its own; underscores are added to
    the name where they have it already."""
    at, name = docs.columns.index("text"), "fingerprint"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(h) for h in sketch_hashes(byte_texts(batch.column(at)), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             [*batch.schema.names, name])

    return map_batches(docs, run, schema)


def merge_by(sketches: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """``key, fingerprint``: the merged sketch of every key's rows, of any number.

    Each task keeps the ``size`` least hashes of a key before the shuffle.
    """
    chars = F.col("fingerprint")
    hashes = F.regexp_extract_all(chars, F.lit(f"(.{{{_CHARS}}})"))
    # The bytes behind the characters sort as the hashes do.
    each = (sketches.select(F.col(key), F.explode(hashes).alias("chars")).distinct()
            .withColumn("rank", F.row_number().over(
                Window.partitionBy(key).orderBy(F.unbase64("chars")))).filter(F.col("rank") <= size))
    merged = each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "chars"))), lambda x: x["chars"]), "").alias("fingerprint"))
    keys = sketches.select(key).distinct().withColumnRenamed(key, "_key")
    return keys.join(merged, F.col("_key").eqNullSafe(F.col(key)), "left").select(
        F.col("_key").alias(key), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


# --- every text, an edited copy of it, and the next one -----------------------------------------


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) gives way to as much of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _next_texts(docs: DataFrame) -> DataFrame:
    """``bucket, extra, pos, tie, doc_id, text``: descending ids, cut into ranges.

    Each range ends with copies (``extra``) of the next range's first texts, the last one
    with the very first texts; equal ids follow each other by a hash of their texts. The
    ranges' bounds are quantiles, of which there are a few per shuffle partition; an id that
    takes several of them (null ids, for instance) is cut into as many ranges of hashes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pos = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1))
    rows = docs.select(pos.alias("pos"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = rows.agg(F.percentile_approx("pos", shares, 20 * parts)).first()[0] or []
    bounds, times = np.unique(np.array(bounds, np.int64), return_counts=True)
    first_bucket = np.concatenate(([0], np.cumsum(times)))
    times = np.append(times, 1)

    @F.pandas_udf("int")
    def bucket_of(p: pd.Series, tie: pd.Series) -> pd.Series:
        p = p.to_numpy()
        at = np.searchsorted(bounds, p, "left")
        hot = (at < len(bounds)) & (times[at] > 1)
        hot[hot] = bounds[at[hot]] == p[hot]
        share = (tie.to_numpy() >> 32) + (1 << 31)  # 32 bits, in the order of the hashes
        return pd.Series((first_bucket[at] + np.where(hot, share * times[at] >> 32, 0)).astype(np.int32))

    placed = rows.withColumn("bucket", bucket_of("pos", "tie"))
    heads = sorted((r[0], *r[1]) for r in
                   placed.groupBy("bucket").agg(F.min(F.struct("pos", "tie"))).toLocalIterator())
    before = [heads[-1][0], *(h[0] for h in heads[:-1])] if heads else []
    firsts = spark.createDataFrame([(p, t, b) for b, (_, p, t) in zip(before, heads)],
                                   "pos long, tie long, before int")
    own = F.struct(F.col("bucket"), F.lit(0).alias("extra"))
    copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(
        F.col("before").alias("bucket"), F.lit(1).alias("extra"))))
    return (placed.join(F.broadcast(firsts), ["pos", "tie"], "left")
            .select(F.explode(copies).alias("at"), "pos", "tie", "doc_id", "text")
            .select("at.*", "pos", "tie", "doc_id", "text")
            .repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "pos", "tie"))


_PAIRED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def _compare(size: int):
    def rows(pairs: list[tuple]) -> pa.RecordBatch:
        texts = [p[1] for p in pairs]
        changed = [edited(a, b).encode() for (_, a, b) in pairs]
        mine = sketch_hashes([t.encode() for t in texts], size)
        other = sketch_hashes(changed, size)
        # Each text's next one is the following pair's own text, but at the ends.
        after = mine[1:] + sketch_hashes([pairs[-1][2].encode()], size)
        for i, (a, b) in enumerate(zip(pairs, pairs[1:])):
            if a[2] is not b[1]:
                after[i] = sketch_hashes([a[2].encode()], size)[0]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([p[0] for p in pairs], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
            "fingerprint": [encode(h) for h in mine],
            "edited_fingerprint": [encode(h) for h in other],
            "near_edited": [_resemblance(a, b, size) for a, b in zip(mine, other)],
            "near_next": [_resemblance(a, b, size) for a, b in zip(mine, after)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, pairs, held = None, [], 0
        for batch in batches:
            for bucket, extra, doc_id, text in zip(*(
                    batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text"))):
                text = text or ""
                if waiting:
                    pairs.append((waiting[0], waiting[1], text))
                    held += len(text) + 1
                    if held > 8 << 20:
                        yield rows(pairs)
                        pairs, held = [], 0
                waiting = None if extra else (doc_id, text)
        if pairs:
            yield rows(pairs)

    return run


def fingerprint_pairs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text of ``docs (doc_id, text)`` and of its `edited` copy, made
    with the next document's text (descending ids, null last; after the last the first), and
    the resemblance of the text to its copy and to the next text.

    Equal ids follow each other in the order of a hash of their texts. A single document is
    its own next one. Texts are sorted by ranges of ids, never all in one task.
    """
    return map_batches(_next_texts(pick(docs, "doc_id", "text")), _compare(size), _PAIRED)


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """`resemblance` of two columns of sketches."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([resemblance(p, q, size) for p, q in zip(x, y)], dtype=float)

    return of(a, b)
