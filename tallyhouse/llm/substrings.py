"""Repeated substrings: windows of words grouped by minimizers, equal ones found by rank doubling.

A window starts at every word and is `WINDOW` words long. The dealt method, suffix trees split by
variable-length prefixes, is not what runs: every suffix would have to travel with at least a window
of words to the task of its prefix (the README has the figures). Here windows that follow each
other travel together:

1. *Where windows go.* Of the `ANCHOR`-word strings that begin in a window, the one with the least
   hash names the window's group, so equal windows always share a group, and the windows that
   follow each other in a text mostly do too: they travel as one *run*, and a text is moved about
   three times, not fifty. Groups met in one document only hold no repeat and are left out
   before any text moves.
2. *What goes there.* Of the runs with the same words, one is sent, with the least id of all.
   A passage in a third of all documents is one row per group.
3. *Equal windows.* A task ranks the strings of 1, 2, 4, .. words of its groups, up to the window;
   windows of equal rank are equal. Groups of more than `GROUP_WORDS` words are split by a hash of
   the whole window, and counted by key.

Words are runs of bytes other than U+0020 and U+0009 to U+000D; they are compared as 64-bit
hashes, and windows in split groups and runs as 128 bits of hash.

Edge cases: texts without words, or with fewer than a window, have no repeat. Documents with
equal ids do not repeat each other. A null id is after all others. Rows that repeat in full
are judged and returned each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import (byte_texts, grams, hide, map_batches, marked, mix, pick,
                                   place, real_id, row_key, slices, split_by_key, unhide, words_of)
from tallyhouse.session import materialize

WINDOW = 50
#: Words in the strings that name groups.
ANCHOR = 8
#: A group with more words than this is split further; a task holds about so many at a time.
GROUP_WORDS = 2_000_000
#: A run is cut after so many windows (they come in long runs where a text repeats itself).
RUN = 256


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have:])
    return out


def _runs(window: int, anchor: int):
    """Runs of windows of each text: the group, the hash of the run's words, first window, windows."""

    def of(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(words)
        if n < window:
            return (np.zeros(0, np.int64),) * 5
        key = _sliding_min(grams(words, anchor), window - anchor + 1)[: n - window + 1]
        first = np.arange(n - window + 1)
        text = np.searchsorted(starts, first, "right") - 1
        inside = first + window <= starts[text + 1]
        at, key, text = first[inside], key[inside], text[inside]
        if not len(at):
            return (np.zeros(0, np.int64),) * 5
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(at)))
        if length.max() > RUN:
            times = -(-length // RUN)
            piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            begin = np.repeat(begin, times) + piece * RUN
            length = np.diff(np.append(begin, len(at)))
        return key[begin].view(np.int64), text[begin], at[begin], length, at[begin] + length + window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in ("_d", "_h"))
            texts = byte_texts(batch.column("text"))
            for part in slices(texts):
                words, starts = words_of(texts[part])
                key, text, at, length, end = of(words, starts)
                # Two polynomial hashes of the run's words, from running sums.
                same = []
                for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
                    up = np.multiply.accumulate(np.concatenate((
                        np.ones(1, np.uint64), np.full(len(words), base, np.uint64))))
                    down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(
                        len(words), pow(base, -1, 1 << 64), np.uint64))))
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1])))
                    same.append(mix((total[end] - total[at]) * down[at]
                                    + length.astype(np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(same[0]), pa.array(same[1]),
                     pa.array(ids[part][text]), pa.array(hashes[part][text]),
                     pa.array((at - starts[text]).astype(np.int32)),
                     pa.array(length.astype(np.int32))],
                    ["m", "c1", "c2", "_d", "_h", "at", "n"])

    return run


_RUNS = "m long, c1 long, c2 long, _d long, _h long, at int, n int"


def _cut_runs(window: int):
    """The words of the asked runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(byte_texts(batch.column("text")), batch.column("runs").to_pylist()):
                words = text.split()
                out += [(r["m"], r["c1"], r["c2"], r["least"], r["n"],
                         b" ".join(words[r["at"]: r["at"] + r["n"] + window - 1])) for r in runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                ["m", "c1", "c2", "least", "n", "words"])

    return run


_CONTENTS = "m long, c1 long, c2 long, least long, n int, words binary"


def suffix_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """The node of depth ``depth`` that the suffix at each place hangs below (equal numbers:
    the same node), by doubling: suffixes of equal rank agree in that many words."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        pair = rank[:-step] * np.uint64(len(words) + 1) + rank[step:] if len(rank) > step else rank[:0]
        tail = len(rank) - len(pair)
        rank = np.concatenate((np.unique(pair, return_inverse=True)[1].astype(np.uint64),
                               np.arange(len(pair), len(pair) + tail, dtype=np.uint64)))
        have += step
    return rank


def _trees(window: int, group_words: int):
    """For each content, the least id that any of its windows starts in, window by window."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        words, starts = words_of([r[5] for r in rows])
        counts = np.array([r[4] for r in rows])
        row = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        node = suffix_ranks(words, window)[starts[row] + place].astype(np.int64)
        group = np.array([r[0] for r in rows])[row]
        owner = np.array([r[3] for r in rows])[row]
        order = np.lexsort((owner, node, group))
        new = np.ones(len(order), bool)
        new[1:] = (node[order][1:] != node[order][:-1]) | (group[order][1:] != group[order][:-1])
        first = np.empty(len(order), np.int64)
        first[order] = owner[order][new][np.cumsum(new) - 1]
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1, 2)]
            + [pa.ListArray.from_arrays(pa.array(ends), pa.array(first))], ["m", "c1", "c2", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("m", "c1", "c2", "least", "n", "words"))):
                if r[0] != last and size > group_words // 4:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += r[4] + window
                last = r[0]
        if held:
            yield solve(held)

    return run


_FIRST = "m long, c1 long, c2 long, first array<long>"


def _window_keys(window: int):
    """Every window of the contents of a large group, by 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("words"))
            names = ("m", "c1", "c2", "least")
            held = [batch.column(c).to_numpy() for c in names]
            n = batch.column("n").to_numpy()
            for part in slices(texts):
                words, starts = words_of(texts[part])
                counts = n[part]
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = starts[row] + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[part][row]) for h in held] + [pa.array(place.astype(np.int32))]
                    + [pa.array(grams(w, window)[at].view(np.int64)) for w in (words, mix(words))],
                    [*names, "i", "w1", "w2"])

    return run


_WINDOWS = "m long, c1 long, c2 long, least long, i int, w1 long, w2 long"


def first_owners(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
                 group_words: int = GROUP_WORDS) -> tuple[DataFrame, DataFrame]:
    """Runs that may repeat, ``(m, c1, c2, _d, _h, at, n)``, and for each content
    ``(m, c1, c2)`` the least id that each of its ``n`` windows starts in, ``first``."""
    on = ["m", "c1", "c2"]
    runs = map_batches(keyed, _runs(window, anchor), _RUNS)
    shared = (runs.groupBy("m").agg(F.min("_d").alias("lo"), F.max("_d").alias("hi"))
              .filter("lo < hi").select("m"))
    runs = materialize(runs.join(shared, "m"), "runs")
    sample = F.min(F.struct("_d", "_h", "at", "n")).alias("s")
    contents = runs.groupBy(*on).agg(F.min("_d").alias("least"), sample)
    asked = materialize(contents.groupBy("s._d", "s._h").agg(F.collect_list(F.struct(
        *on, "least", "s.at", "s.n")).alias("runs")), "asked")
    here, _ = split_by_key(keyed, asked.select("_d").distinct(), ["_d"])
    texts = here.join(asked, ["_d", "_h"]).dropDuplicates(["_d", "_h"]).select("text", "runs")
    large = materialize(contents.groupBy("m").agg(F.sum(F.col("s.n") + window).alias("size"))
                        .filter(F.col("size") > group_words).select("m"), "large")
    cut = map_batches(texts, _cut_runs(window), _CONTENTS)
    if large.isEmpty():
        fits, wide = cut, None
    else:
        cut = materialize(cut, "contents")
        wide, fits = split_by_key(cut, large, ["m"])
    grouped = fits.repartition("m").sortWithinPartitions("m")
    first = map_batches(grouped, _trees(window, group_words), _FIRST)
    if wide is not None:
        each = map_batches(wide, _window_keys(window), _WINDOWS)
        least = each.groupBy("m", "w1", "w2").agg(F.min("least").alias("least"))
        split = (each.drop("least").join(least, ["m", "w1", "w2"]).groupBy(*on)
                 .agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("x"))
                 .select(*on, F.transform("x", lambda x: x["least"]).alias("first")))
        first = first.unionByName(split)
    return runs, first


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
            group_words: int = GROUP_WORDS) -> DataFrame:
    """``_d, _h, spans``: for each text of ``docs (_d, _h, text)`` with windows that also
    start in a document with a smaller id, where these windows begin (``at``) and which of
    the windows from there on they are (``i``, from 0)."""
    runs, first = first_owners(docs, window, anchor, group_words)
    own = runs.join(first, ["m", "c1", "c2"])
    hit = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("first")[i] < F.col("_d"))
    return (own.select("_d", "_h", "at", hit.alias("i")).filter(F.size("i") > 0).distinct()
            .groupBy("_d", "_h").agg(F.collect_list(F.struct("at", "i")).alias("spans")))


def covered(n_words: int, spans: list[dict] | None, window: int = WINDOW) -> np.ndarray | None:
    """Which words lie in the windows of ``spans``; None if there are none."""
    if not spans:
        return None
    at = np.concatenate([np.asarray(s["i"]) + s["at"] for s in spans])
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step)[:n_words] > 0


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _summary(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = (batch.column("spans").to_pylist() if "spans" in batch.schema.names
                     else [None] * batch.num_rows)
            counts, removed, digests = [], [], []
            for text, s in zip(byte_texts(batch.column("text")), spans):
                words = text.split()
                gone = covered(len(words), s, window)
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_d"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, **limits) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs (doc_id, text)``:
    what is left without the words in windows that start in a document with a smaller id."""
    keyed = pick(docs, "doc_id", "text").select(*row_key(F.col("doc_id"), F.col("text")), "text")
    spans = materialize(repeats(keyed, window, **limits), "spans")
    some, none = split_by_key(keyed, spans.select("_d").distinct(), ["_d"])
    cut = map_batches(some.join(spans, ["_d", "_h"], "left"), _summary(window), _RESULT)
    whole = map_batches(none, _summary(window), _RESULT)
    return cut.unionByName(whole).withColumn("doc_id", real_id(F.col("doc_id")))


def without_repeats(docs: DataFrame, window: int = WINDOW, **limits) -> DataFrame:
    """``docs (doc_id, text, ..)`` with the repeated words cut out of ``text``.

    A text that loses words is its kept words, joined by one space, and its ``n_chars``
    follows if there is such a column. Other texts stay as they are. A document that loses
    all its words is left out.
    """
    rows = marked(docs)
    spans = materialize(repeats(rows.select("_d", "_h", F.col(place(docs, "text")).alias("text")),
                                window, **limits), "spans")
    some, none = split_by_key(rows, spans.select("_d").distinct(), ["_d"])
    names = hide(docs).columns
    at = docs.columns.index("text")
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])
    joined = some.join(spans, ["_d", "_h"], "left").select(*names, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stay = [], []
            for text, s in zip(byte_texts(batch.column(at)), batch.column("spans").to_pylist()):
                gone = covered(len(words := text.split()), s, window) if s else None
                if gone is not None:
                    text = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                stay.append(gone is None or bool(text))
                texts.append(text)
            columns = list(batch.columns[:-1])
            cut = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
            missing = columns[at].is_null()
            columns[at] = pc.if_else(missing, None, cut)
            if length_at is not None:
                i = length_at
                length = pc.utf8_length(columns[at]).cast(columns[i].type)
                changed = pa.array([bool(s) for s in batch.column("spans").to_pylist()])
                columns[i] = pc.if_else(changed, length, columns[i])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(stay))

    return unhide(none.select(*names).unionByName(map_batches(joined, run, schema)), docs)
