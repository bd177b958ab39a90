"""Cross-tokenizer alignment by lockstep merging of token ends.

Each text is encoded by tokenizer A (byte-level, with a space before the text) and by
tokenizer B (pieces, which puts the space itself). Both token sequences spell the same bytes;
where a token of A and one of B end at the same byte, there is a *cut*, the two tokens are
*linked*, and the tokens between two cuts form a group.

**Merging.** The ends of a batch's tokens lie in two flat sorted arrays. One state vector
holds a pair of pointers per document, and each step compares all pairs at once: equal ends
give a link and a cut and move both pointers, otherwise the pointer at the smaller end moves.
Documents that are through are taken out of the vector. A merge of sorted lists can start at
any value, so a long document takes several lanes of the vector (`LANE` tokens of A each)
and a batch needs few steps whatever its longest text.

**Counts.** A link's count is how many links of the whole collection hold its two ids
together. Texts are encoded once; what is kept of them is their sums and the distinct id
pairs with their numbers, as arrays. Pairs are counted with partial sums. The counts then
come back to the documents in two ways: fewer than `HOT` pairs can hold more than 1/HOT
of all links, so these are broadcast, whatever the collection; documents' rarer pairs are
joined by key, and no key of that join is hot.

Edge cases: texts that are null, empty, or whose joined A or B bytes differ from the space and
the text (a U+2581 in the text, for instance) have no tokens: zeros and an empty
``groups_sha256``. Special strings inside a text are plain text. Rows that repeat come back
as often and count as often; a null doc_id stays null. Columns other than doc_id and text
are left aside.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import byte_texts, map_batches, pick, slices
from tallyhouse.session import materialize

#: Tokens of A that one lane of the state vector merges.
LANE = 512
#: Fewer than so many id pairs are broadcast (24 bytes each).
HOT = 200_000
#: Bytes of text that are encoded and merged at a time (a token takes some hundred bytes while it
#: is worked on); a longer text is alone.
_BYTES = 1 << 20


# How byte-level tokenizers of this kind cut a text into pre-tokens. Up to U+024F
# the library's classes of characters and those here are the same; other texts go through
# the library whole.
_PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_BEYOND = regex.compile(r"[^\x00-\u024F]")
#: Pre-tokens whose ids a task keeps.
_KEPT = 400_000


def is_word(pre_token: str) -> bool:
    """Whether it is a space and letters."""
    return pre_token[0] == " " and pre_token[1:].isalpha()


class ByteTokenizer:
    """A: a byte-level tokenizer file of the ``tokenizers`` library.

    Pre-tokens are encoded one independent of the others, so each distinct one goes through
    the library once while it is kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        cut = said["pre_tokenizer"] or {}
        self.plain = (not said["normalizer"] and cut.get("type") == "ByteLevel"
                      and cut.get("use_regex", True) and not cut.get("add_prefix_space"))
        self.kept: dict[str, list[int]] = {}
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size(with_added_tokens=True)
        letters = _byte_letters()
        self.entries = [bytes(letters.get(c, 0) for c in self.library.id_to_token(i) or "")
                        for i in range(size)]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """Words after a space are encoded as one text, in which they stay pre-tokens, and told
        apart by their bytes; others one by one."""
        words, others = [], []
        for p in new:
            (words if is_word(p) else others).append(p)
        self.kept.update(zip(others, self._library(others)))
        if words:
            ids = self._library(["".join(words)])[0]
            ends = np.cumsum([len(self.entries[i]) for i in ids])
            until = np.searchsorted(ends, np.cumsum([len(p.encode()) for p in words])) + 1
            self.kept.update((p, ids[x:y]) for p, x, y in zip(words, [0, *until[:-1].tolist()], until.tolist()))

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts]
        if not self.plain:
            return self._library(texts)
        cut = [_PRE_TOKEN.findall(t) if t.isascii() or not _BEYOND.search(t) else None for t in texts]
        whole = iter(self._library([t for t, c in zip(texts, cut) if c is None]))
        if len(self.kept) > _KEPT:
            self.kept.clear()
        self._learn(set(chain.from_iterable(c for c in cut if c is not None)).difference(self.kept))
        return [next(whole) if c is None else list(chain.from_iterable(map(self.kept.__getitem__, c)))
                for c in cut]


class PieceTokenizer:
    """B: a model file of the ``sentencepiece`` library."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

        def entry(i: int) -> bytes:
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                return bytes([int(piece[3:5], 16)])
            return piece.replace("▁", " ").encode()

        self.entries = [entry(i) for i in range(self.library.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable bytes of Latin-1
    stand for themselves, the others in order for U+0100 and up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def merge(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray,
          lane: int = LANE) -> np.ndarray:
    """For each token of A the token of B that ends where it ends, or -1.

    ``ends_a`` and ``ends_b`` rise over all documents; the starts say where each document's
    tokens begin, and end with the number of tokens. Ends never fall within a document, and
    tokens of no bytes are linked with the first token at their end.
    """
    found = np.full(len(ends_a), -1, np.int64)
    # Lanes: from every `lane`-th token of a document on, in both arrays.
    sizes = np.diff(starts_a)
    lanes = -(-sizes // lane)
    doc = np.repeat(np.arange(len(sizes)), lanes)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a = starts_a[:-1][doc] + within * lane
    stop_a = np.minimum(a + lane, starts_a[1:][doc])
    after = np.searchsorted(ends_b, ends_a[np.maximum(a - 1, 0)], "right")
    b = np.where(within == 0, starts_b[:-1][doc], after)
    stop_b = starts_b[1:][doc]
    while True:
        going = (a < stop_a) & (b < stop_b)
        if not going.all():  # documents, or lanes, that are through
            a, b, stop_a, stop_b = a[going], b[going], stop_a[going], stop_b[going]
        if not len(a):
            return found
        left, right = ends_a[a], ends_b[b]
        same = left == right
        found[a[same]] = b[same]
        a = a + (left <= right)
        b = b + (right <= left)


def _flat(ids: list[list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, where each text's begin, and the end of each token over all texts."""
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64)))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(starts[-1]))
    return flat, starts, np.cumsum(lengths[flat])


def _named(entries: list[bytes]) -> np.ndarray:
    """Ids in decimal, each followed by what separates it from the next."""
    names = np.empty((3, len(entries)), object)
    for row, mark in enumerate(",|;"):
        names[row] = [f"{i}{mark}" for i in range(len(entries))]
    return names


def _written(ids_a, ids_b, found, starts_a, starts_b, names_a, names_b) -> Iterator[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    cut_a = found >= 0
    cut_b = np.zeros(len(ids_b), bool)
    cut_b[found[cut_a]] = True
    group_a = np.cumsum(cut_a) - cut_a  # how many groups were finished before a token
    group_b = np.cumsum(cut_b) - cut_b
    first_b = np.concatenate(([0], np.flatnonzero(cut_b) + 1))  # where each group's B tokens begin
    last_a = np.concatenate((np.flatnonzero(cut_a) + 1, [len(ids_a)]))  # and where its A tokens end
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[np.arange(len(ids_a)) + first_b[group_a]] = names_a[np.where(cut_a, 1, 0), ids_a]
    out[np.arange(len(ids_b)) + last_a[group_b]] = names_b[np.where(cut_b, 2, 0), ids_b]
    edges = (starts_a + starts_b).tolist()
    for x, y in zip(edges[:-1], edges[1:]):
        yield "".join(out[x:y].tolist())[:-1]


_ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, pair array<long>, n array<int>")


def _align(load_a: Callable, load_b: Callable, lane: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer_a, tokenizer_b = load_a(), load_b()
        entries_a, entries_b = tokenizer_a.entries, tokenizer_b.entries
        long_a, long_b = (np.array([len(e) for e in x], np.int64) for x in (entries_a, entries_b))
        names_a, names_b = _named(entries_a), _named(entries_b)
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for part in slices(texts, _BYTES):
                mine = [t.decode() for t in texts[part]]
                ids_a, ids_b = tokenizer_a.encode(mine), tokenizer_b.encode(mine)
                for i, text in enumerate(texts[part]):
                    want = b" " + text
                    if (not text or b"".join(map(entries_a.__getitem__, ids_a[i])) != want
                            or b"".join(map(entries_b.__getitem__, ids_b[i])) != want):
                        ids_a[i], ids_b[i] = [], []
                flat_a, starts_a, ends_a = _flat(ids_a, long_a)
                flat_b, starts_b, ends_b = _flat(ids_b, long_b)
                found = merge(ends_a, ends_b, starts_a, starts_b, lane)
                groups = _written(flat_a, flat_b, found, starts_a, starts_b, names_a, names_b)
                written = list(groups)
                cuts = np.flatnonzero(found >= 0)
                edge = np.searchsorted(cuts, starts_a)
                pairs = flat_a[cuts] * len(entries_b) + flat_b[found[cuts]]
                distinct, times = [], []
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    one, n = np.unique(pairs[x:y], return_counts=True)
                    distinct.append(one)
                    times.append(n.astype(np.int32))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in distinct]))).astype(np.int32)
                none = [np.zeros(0, np.int64)]
                columns = [
                    *[batch.column(c).slice(part.start, len(mine)) for c in ("row", "doc_id")],
                    pa.array(np.diff(starts_a)), pa.array(np.diff(starts_b)),
                    pa.array(np.diff(edge)), pa.array(np.diff(edge)),
                    pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(distinct + none))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(
                        np.concatenate(times + none).astype(np.int32)))]
                names = [c.split()[0] for c in _ALIGNED.split(", ")]
                if keep:
                    columns.append(pa.array(written))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _loaders(path_a, path_b) -> tuple[Callable, Callable]:
    """Paths may be functions, which are then called where the file is read."""
    def load(kind, path):
        return lambda: kind(path() if callable(path) else path)

    return load(ByteTokenizer, path_a), load(PieceTokenizer, path_b)


def aligned(docs: DataFrame, path_a, path_b, lane: int = LANE) -> DataFrame:
    """``doc_id, groups``: each text's groups in writing, of ``docs (doc_id, text)``."""
    rows = pick(docs, "doc_id", "text").select(
        F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = map_batches(rows, _align(*_loaders(path_a, path_b), lane, True), _ALIGNED + ", groups string")
    return found.select("doc_id", "groups")


def align(docs: DataFrame, path_a, path_b, lane: int = LANE, hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of
    ``docs (doc_id, text)``. The tokenizer files must be readable on every worker."""
    rows = pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = materialize(map_batches(rows, _align(*_loaders(path_a, path_b), lane, False), _ALIGNED),
                        "aligned")
    width = len(_loaders(path_a, path_b)[1]().entries)
    pairs = texts.select("row", F.explode(F.arrays_zip("pair", "n")).alias("x")).select(
        "row", "x.pair", F.col("x.n").cast("long").alias("n"))
    counts = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    total = counts.agg(F.sum("count")).first()[0] or 0
    best = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("top"))
    counts = materialize(
        counts.withColumn("b", F.col("pair") % width).join(F.broadcast(best), "b")
        .select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best")), "counted")
    often = F.col("count") * hot > total
    common = F.broadcast(counts.filter(often))
    known = pairs.join(common, "pair", "left")
    n_best = F.sum(F.col("n") * F.col("best")).alias("n_best")
    count_sum = F.sum(F.col("n") * F.col("count")).alias("count_sum")
    at_hot = known.filter("count IS NOT NULL").groupBy("row").agg(n_best, count_sum)
    rest = (known.filter("count IS NULL").select("row", "pair", "n")
            .join(counts.filter(~often), "pair").groupBy("row").agg(n_best, count_sum))
    sums = at_hot.unionByName(rest).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    no = F.lit(0).cast("long")
    return texts.drop("pair", "n").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", no).alias("n_best"),
        F.coalesce("count_sum", no).alias("count_sum"), "groups_sha256")
