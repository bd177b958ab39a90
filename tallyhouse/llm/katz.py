"""Language-model scores by Katz backoff.

**Model.** Texts are lower-cased (A-Z), cut into white-space words and closed by one end token;
a start mark stands before the first word as history only. With c the count of an n-gram in
the training texts and h its history,

* ``P(w | h) = d(c) c / C(h)`` where c > 0, with Good-Turing discounts ``d`` for counts up to
  `CUTOFF` (``d = 1`` above), taken per order from the counts of counts;
* ``P(w | h) = alpha(h) P(w | shorter h)`` where c = 0 and h was seen;
  ``alpha(h) = (1 - sum P(w | h)) / (1 - sum P(w | shorter h))`` over the words seen after h, so
  that all probabilities after h add up to 1 exactly;
* ``P(w | h) = P(w | shorter h)`` where h was not seen;
* words never seen are one class, which has what the discounts leave of the single words.

Where counts of counts give no discount between 0 and 1, half a count is taken off. A history
after which nothing is left (all its counts are above the cutoff) has 1 added to C(h).

**Tables.** Counts and weights lie in tables that are partitioned by the hash of the n-gram, each
part of a size that fits a task (`PART` bytes of text). Documents are worked on in *blocks* of
`BLOCK` bytes of text, written once as distinct word hashes and a sequence of small numbers. A block sends
each part the distinct n-grams it has of it, with its own training counts, in one row of
arrays; the part adds them up and answers with the totals in the same order (and whether this
block is the first, or only one, with the n-gram). So an n-gram crosses the network once per block
however often it occurs, and a hot n-gram or history is one entry per block. Weights go
the same way, order by order: blocks sum up what they are first with per history, parts add
that up, and each block gets the sums of its histories back. Histories of one block only need no
exchange. Then each block evaluates its distinct n-grams from the single words up, and
sums up its texts.

Arrays travel packed (`pack`): sorted hashes as the gaps between them, and all numbers byte by byte,
the lowest bytes of all first, without those that are zero in all; compression then finds the zeros.

Blocks and answers are large rows, so they are written in row groups of one block, or `ANSWERS`
answers; tasks get them in batches of bounded bytes, and never hold all blocks of a partition.

`ORDER` is 2 in production; the module works at any order, with a further request and a further
answer for each distinct n-gram of a block.

Edge cases: a null text is empty and has the end token only; a null doc_id is not held out; rows
that repeat count as often. Without training texts every token is unknown with probability
1 and the base is 0. Words are known by 64-bit hashes. Columns other than doc_id and text are
left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import byte_texts, map_batches, mix, pick, slices, words_of
from tallyhouse.session import materialize

ORDER = 2
#: Counts up to this number are discounted.
CUTOFF = 5
#: Bytes of text in a block, and bytes of text for each part of the tables.
BLOCK, PART = 8 << 20, 16 << 20
#: Answers in a row group.
ANSWERS = 64
#: Of every `FOLDS` documents by id hash, those with remainder `FOLD` are held out.
FOLDS, FOLD = 7, 2

_START, _END = np.uint64(0x5EED0F57A7), np.uint64(0xE0D0F7E87)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = 100  # added to the order in the kind of a row with sums of weights

_BODY = "block long, kind int, part long, ids array<long>, held array<boolean>, sizes array<long>, " \
        "keys binary, seq binary"
_ASK = "kind int, part long, block long, keys binary, n binary, left binary, low binary"
_ANSWER = "block long, kind int, part long, n binary, left binary, low binary"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == FOLD, F.lit(False))


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers as the number of bytes that the largest needs, then the first byte of all,
    the second of all, and so on."""
    values = np.ascontiguousarray(values).view(np.uint64)
    width = max((int(values.max()) if len(values) else 0).bit_length() + 7 >> 3, 1)
    planes = values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Numbers in order, as the first one and the gaps between them."""
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _one(*values: bytes) -> list[pa.Array]:
    return [pa.array([v], pa.binary()) for v in values]


def _lists(*values) -> list[pa.Array]:
    """Each array as the only entry of a list column."""
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array)
                                     else pa.array(v)) for v in values]


def _blocks(most: int):
    """Texts to blocks: sorted distinct word hashes, and the tokens as places among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t.lower() for t in byte_texts(batch.column("text"))]
            for part in slices(texts, most):
                words, starts = words_of(texts[part])
                n = part.stop - part.start
                sizes = np.diff(starts) + 1
                tokens = np.full(int(sizes.sum()), _END)
                ends = np.cumsum(sizes) - 1
                is_word = np.ones(len(tokens), bool)
                is_word[ends] = False
                tokens[is_word] = words
                keys, seq = np.unique(np.append(tokens, _START), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([0], pa.int32()), pa.array([0], pa.int64()),
                     *_lists(batch.column("doc_id").slice(part.start, n), batch.column("held").slice(part.start, n),
                             sizes), *_one(pack_sorted(keys), pack(seq.astype(np.int64)))],
                    [c.split()[0] for c in _BODY.split(", ")])
                number += 1

    return run


class Block:
    """The distinct n-grams of a block, order by order.

    ``keys[k]`` are their hashes in order, ``first[k]`` a token at which each ends,
    ``at[k]`` the place of each token's n-gram (-1 where the text has no such history).
    """

    def __init__(self, order: int, sizes, keys, seq, held):
        self.sizes, self.held = sizes, held
        seq = np.asarray(seq, np.int64)
        start, tokens = seq[-1], seq[:-1]
        n = len(tokens)
        begins = np.zeros(n, bool)
        begins[np.cumsum(sizes) - sizes] = True
        self.train = np.repeat(~held, sizes)
        words = keys[tokens]
        first = np.zeros(len(keys), np.int64)
        first[tokens[::-1]] = np.arange(n)[::-1]
        self.keys, self.at, self.first = {1: keys}, {1: tokens}, {1: first}
        self.history, self.counts = {}, {}
        self.counts[1] = np.bincount(tokens[self.train], minlength=len(keys))
        self.counts[1][start] = np.count_nonzero(~held)
        self.start = start
        for k in range(2, order + 1):
            lower = self.at[k - 1]
            before = np.concatenate(([-1], lower[:-1]))
            before[begins] = start if k == 2 else -1
            have = np.flatnonzero(before >= 0)
            grams = mix(mix(self.keys[k - 1][before[have]] + np.uint64(k)) * _STEP + words[have])
            self.keys[k], where, place = np.unique(grams, return_index=True, return_inverse=True)
            self.first[k] = have[where]
            self.at[k] = np.full(n, -1, np.int64)
            self.at[k][have] = place
            self.history[k] = before[self.first[k]]
            self.counts[k] = np.bincount(place[self.train[have]], minlength=len(self.keys[k]))

    def suffix(self, k: int) -> np.ndarray:
        """The place, one order lower, of each n-gram without its first word."""
        return self.at[k - 1][self.first[k]]


def _requests(keys: np.ndarray, parts: int, kind: int, block: int, n=None, left=None, low=None):
    """One row per part that ``keys``, which are in order, have something in."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(part)) + 1 if len(part) else part
    for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
        if x < y:
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([int(part[x])], pa.int64()), pa.array([block], pa.int64()),
                 *_one(pack_sorted(keys[x:y]), b"" if n is None else pack(n[x:y]),
                       *[b"" if v is None else pack(v[x:y]) for v in (left, low)])],
                [c.split()[0] for c in _ASK.split(", ")])


def _array(value) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _bytes(value) -> memoryview:
    return memoryview(value.as_buffer())


def _doubles(value) -> np.ndarray:
    return unpack(_bytes(value)).view(np.float64)


def _body(row: dict, order: int) -> Block:
    return Block(order, _array(row["sizes"]), unpack_sorted(_bytes(row["keys"])),
                 unpack(_bytes(row["seq"])).view(np.int64), _array(row["held"]))


def _count_requests(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                block = _body(row, order)
                for k in range(1, order + 1):
                    yield from _requests(block.keys[k], parts, k, row["block"].as_py(), block.counts[k])

    return run


def _groups(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal values of ``by``."""
    key, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            now = tuple(row[c].as_py() for c in by)
            if now != key and rows:
                yield key, rows
                rows = []
            key = now
            rows.append(row)
    if rows:
        yield key, rows


def _answers(kind, part, rows, sizes: list[int], values: dict) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(sizes).tolist()
    for row, x, y in zip(rows, [0, *ends[:-1]], ends):
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["block"].as_py()], pa.int64()), pa.array([kind], pa.int32()), pa.array([part], pa.int64()),
             *_one(*[pack(values[c][x:y]) if c in values else b"" for c in ("n", "left", "low")])],
            [c.split()[0] for c in _ANSWER.split(", ")])


def _count(cutoff: int):
    """Adds up each part's counts. An answer is 4 * total + 2 (no other block has it) + 1 (first).

    One more row of a part, under block -1, has its counts of counts, distinct n-grams and sum.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, part), rows in _groups(batches, "kind", "part"):
            asked = [unpack_sorted(_bytes(r["keys"])) for r in rows]
            keys, sizes = np.concatenate(asked), list(map(len, asked))
            n = np.concatenate([unpack(_bytes(r["n"])) for r in rows])
            distinct, first, place, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            total = np.bincount(place, n, len(distinct)).astype(np.int64)
            answer = 4 * total[place] + 2 * (times == 1)[place]
            answer[first] += 1
            yield from _answers(kind, part, rows, sizes, {"n": answer})
            real = total[(distinct != _START) & (total > 0)] if kind == 1 else total[total > 0]
            stats = [*np.bincount(np.minimum(real, cutoff + 2), minlength=cutoff + 3)[1: cutoff + 2],
                     len(real), real.sum()]
            yield from _answers(kind, part, [{"block": pa.scalar(-1)}], [len(stats)], {"n": np.array(stats, np.int64)})

    return run


def discounts(counts: list[int]) -> list[float]:
    """``d(1) .. d(cutoff)`` from the numbers of n-grams with counts 1 to cutoff + 1."""
    top = len(counts) - 1
    over = (top + 1) * counts[top] / counts[0] if counts[0] else 1.0
    out = []
    for r in range(1, top + 1):
        d = ((r + 1) * counts[r] / (r * counts[r - 1]) - over) / (1 - over) if counts[r - 1] and over != 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _summed(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(place, values, size).astype(float)  # without any value they are integers


class Evaluation:
    """Probabilities of a block's n-grams from what the parts answered."""

    def __init__(self, block: Block, model: dict, rows: list[dict], order: int):
        self.block, self.model = block, model
        self.total, self.alone, self.first = {}, {}, {}
        for k in range(1, order + 1):
            answer = np.concatenate([unpack(_bytes(r["n"])).view(np.int64) for r in rows if r["kind"].as_py() == k]
                                    or [np.zeros(0, np.int64)])
            self.total[k], self.alone[k], self.first[k] = answer >> 2, answer & 2 > 0, answer & 1 > 0
        self.sent = {k: [np.concatenate([_doubles(r[c]) for r in rows if r["kind"].as_py() == _WEIGHTS + k] or [np.zeros(0)])
                         for c in ("left", "low")] for k in range(2, order + 1)}
        self.p = {1: self._words()}

    def _kept(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts after the discount, and what it took, of all n-grams of an order."""
        c = self.total[k]
        table = np.array([0.0, *self.model["d"][k], 1.0])
        kept = table[np.minimum(c, len(table) - 1)] * c
        return kept, c - kept

    def _words(self) -> np.ndarray:
        kept, _ = self._kept(1)
        return np.where(self.total[1] > 0, kept / self.model["below"], self.model["unknown"])

    def shared(self, k: int) -> np.ndarray:
        """Which n-grams of order k - 1 are histories whose sums more than one block needs."""
        return (self.total[k - 1] > 0) & ~self.alone[k - 1]

    def sums(self, k: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
        """Per history: what discounts took from n-grams of order k, and the sum of their
        probabilities one order lower; of those this block is the first with, or all."""
        mine = (self.total[k] > 0) & (self.first[k] | every)
        history, size = self.block.history[k][mine], len(self.total[k - 1])
        return (_summed(history, self._kept(k)[1][mine], size),
                _summed(history, self.p[k - 1][self.block.suffix(k)[mine]], size))

    def step(self, k: int) -> None:
        """Probabilities at order k, from those at order k - 1 and the sums of the histories."""
        left, low = self.sums(k, True)
        shared = self.shared(k)
        left[shared], low[shared] = self.sent[k]
        count = self.total[k - 1].astype(float)
        none = left <= 0
        left = np.where(none, 1.0, left)
        below = np.maximum(count + none, 1.0)
        alpha = left / below / np.maximum(1 - low, 1e-300)
        h, lower = self.block.history[k], self.p[k - 1][self.block.suffix(k)]
        kept, _ = self._kept(k)
        p = np.where(self.total[k] > 0, kept / below[h], alpha[h] * lower)
        self.p[k] = np.where(count[h] > 0, p, lower)


def _weight_requests(order: int, parts: int, k: int, model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), rows in _groups(batches, "block"):
            block = _body(rows[0], order)
            found = Evaluation(block, model, rows, order)
            for j in range(2, k):
                found.step(j)
            left, low = found.sums(k, False)
            asked = found.shared(k)
            yield from _requests(block.keys[k - 1][asked], parts, _WEIGHTS + k, number,
                                 None, left[asked], low[asked])

    return run


def _add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (kind, part), rows in _groups(batches, "kind", "part"):
        asked = [unpack_sorted(_bytes(r["keys"])) for r in rows]
        distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
        sums = {c: _summed(place, np.concatenate([_doubles(r[c]) for r in rows]), len(distinct))[place]
                for c in ("left", "low")}
        yield from _answers(kind, part, rows, list(map(len, asked)), sums)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            block = _body(rows[0], order)
            found = Evaluation(block, model, rows, order)
            for k in range(2, order + 1):
                found.step(k)
            tokens = block.at[1]
            logs = np.log10(found.p[1])[tokens]
            for k in range(2, order + 1):
                have = block.at[k] >= 0
                logs[have] = np.log10(found.p[k])[block.at[k][have]]
            c = found.total[1][tokens]
            base = np.log10((c + 1) / (model["all"] + model["distinct"] + 1))
            begins = np.cumsum(block.sizes) - block.sizes
            yield pa.RecordBatch.from_arrays(
                [rows[0]["ids"].values, rows[0]["held"].values, rows[0]["sizes"].values,
                 *[pa.array(np.add.reduceat(x, begins)) for x in ((c > 0).astype(np.int64), base, logs)]],
                [x.split()[0] for x in _SCORES.split(", ")])

    return run


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(
            [unpack(n).view(np.int64) for n in batch.column("n").to_pylist()], pa.list_(pa.int64()))], ["kind", "n"])


def _by_part(requests: DataFrame) -> DataFrame:
    return requests.repartition("kind", "part").sortWithinPartitions("kind", "part", "block")


def _by_block(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    both = blocks.unionByName(answers, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "part")


def score_texts(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF, block: int = BLOCK,
                part: int = PART) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of
    ``docs (doc_id, text)``, learned from those that are not held out."""
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // part + 1
    blocks = materialize(map_batches(rows, _blocks(block), _BODY), "blocks", 1)
    asked = map_batches(blocks, _count_requests(order, parts), _ASK)
    answers = materialize(map_batches(_by_part(asked), _count(cutoff), _ANSWER), "counts", ANSWERS)
    stats = map_batches(answers.filter("block < 0").select("kind", "n"), _numbers, "kind int, n array<long>")
    stats = stats.groupBy("kind").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(cutoff + 3)])
    found = {r["kind"]: list(r)[1:] for r in stats.collect()}
    none = [0] * (cutoff + 3)
    model = {"d": {k: discounts(found.get(k, none)[: cutoff + 1]) for k in range(1, order + 1)}}
    counts, model["distinct"], model["all"] = found.get(1, none)[: cutoff + 1], *found.get(1, none)[-2:]
    took = sum(n * r * (1 - d) for r, (n, d) in enumerate(zip(counts, model["d"][1]), 1))
    # As after any history, 1 is added to the count if nothing is left for unknown words.
    took, model["below"] = (took, model["all"]) if took > 0 else (1.0, model["all"] + 1)
    model["unknown"] = took / model["below"]
    answers = answers.filter("block >= 0")
    for k in range(2, order + 1):
        asked = map_batches(_by_block(blocks, answers), _weight_requests(order, parts, k, model), _ASK)
        answers = answers.unionByName(materialize(
            map_batches(_by_part(asked), _add_weights, _ANSWER), "weights", ANSWERS))
    scored = map_batches(_by_block(blocks, answers), _score(order, model), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(model["all"]).cast("long").alias("train_tokens"), "base_score", "score")
