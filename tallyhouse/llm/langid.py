"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte costs
``-log2(count / (total + kinds))`` in the longest context that has seen it; each longer
context that is known, but has not seen it, costs an escape of
``-log2(kinds / (total + kinds))``; a byte that no context has seen costs 8 bits more.
Statistics are frozen while a text is scored, so what a byte costs in all languages is a
function of its last ``ORDER`` bytes. These costs are tabled once, for every string the
trees hold, and a text is scored by looking its strings up, from the longest down.

The trees are learned from a bounded sample of distinct texts (`sample`); every text is scored
in whole. How many bits a byte may cost before a text counts as written in none of the languages
is taken per language from all further texts, in whole, that are left out of the fit (`limits`).

Edge cases: a null text, and one without any letter, is ``und`` with score 0. So is every
text if there is nothing to learn from. Languages with equal code lengths are settled by
name. Rows that repeat are scored each on their own; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import (bounded, byte_texts, hide, map_batches, pick, place, slices,
                                   unhide)
from tallyhouse.session import materialize

ORDER = 4
#: Learned from per language: so many texts, each of at most so many characters.
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 65_536
#: A text that costs more bits a byte is written in none of the languages, where there are no
#: further texts to tell; else so many bits a byte more than the dearest of those, but for the share
#: `STRAY` of them that is dearer yet. The first bits of a text do not count: a word alone does not
#: tell enough. Costs are counted in steps of 1 / `STEPS` bits, rounded up.
MOST_BITS, MARGIN, FREE_BITS = 12.0, 2.0, 64.0
STRAY, STEPS = 0.005, 1000
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_PAD = b"\n" * ORDER


def learnable(doc_id: Column) -> Column:
    """Three quarters of the ids; the others are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("text").alias("h"))


def _chosen(docs: DataFrame, texts: int) -> DataFrame:
    """``lang, h`` of the texts to learn from."""
    first = Window.partitionBy("lang").orderBy("h")
    return materialize(_labelled(docs).select("lang", "h").distinct().withColumn(
        "rank", F.row_number().over(first)).filter(F.col("rank") <= texts).select("lang", "h"), "sample")


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``lang, text``: at most ``texts`` distinct labelled texts per language to learn from; of a
    longer text a piece of ``chars`` characters.

    Those whose hash is least are taken, and the piece begins where the hash says. Ranked are
    hashes alone, and every task sends the least of them only, so neither a hot language
    nor a text that repeats gathers anywhere.
    """
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    piece = F.col("text").substr(start.cast("int"), F.lit(chars))
    return (_labelled(docs).join(bounded(_chosen(docs, texts)), ["lang", "h"])
            .select("lang", "h", piece.alias("text")).dropDuplicates(["lang", "h"]).select("lang", "text"))


def _strings(data: bytes) -> np.ndarray:
    """The ``ORDER`` + 1 bytes that end at each place after the first ``ORDER``."""
    a = np.frombuffer(data, np.uint8)
    n = len(a) - ORDER
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER + 1):
        out <<= np.uint64(8)
        out |= a[i: i + n]
    return out


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("lang").to_pylist()
        texts = byte_texts(batch.column("text"))
        for name in sorted(set(names)):
            data = [_strings(_PAD + t) for t, n in zip(texts, names) if n == name]
            strings, counts = np.unique(np.concatenate(data), return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * len(strings), pa.string()),
                "string": pa.array(strings.astype(np.int64)), "n": pa.array(counts)})


class _Table:
    """Finds the row of each of many 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.slot_key = np.zeros(1 << self.bits, np.uint64)
        self.slot_row = np.full(1 << self.bits, -1, np.int32)
        slots = self._slots(keys)
        self.slot_key[slots] = keys
        self.slot_row[slots] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.slot_key[slots] != keys)
        self.shared = np.zeros(1 << self.bits, bool)
        self.shared[slots[lost]] = True
        order = np.argsort(keys[lost])
        self.lost_keys, self.lost_rows = keys[lost][order], lost[order].astype(np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slots = self._slots(keys)
        row = self.slot_row[slots]
        wrong = self.slot_key[slots] != keys
        row[wrong] = -1
        again = np.flatnonzero(wrong & self.shared[slots])
        if len(again):
            at = np.searchsorted(self.lost_keys, keys[again])
            at[at == len(self.lost_keys)] = 0
            found = self.lost_keys[at] == keys[again]
            row[again[found]] = self.lost_rows[at[found]]
        return row


@dataclass
class Model:
    """Costs in bits, a column for each language: of strings, and of leaving contexts."""

    langs: list[str]
    strings: list[tuple[_Table, np.ndarray]]  # by order, 0 first
    escapes: list[tuple[_Table, np.ndarray]]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits that the last byte of each string takes in each language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.arange(len(keys))
        for k in range(ORDER, -1, -1):
            part = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            table, bits = self.strings[k]
            row = table.rows(part)
            hit = row >= 0
            if len(left) == len(out):
                out[hit] = bits[row[hit]]
            else:
                out[left[hit]] += bits[row[hit]]
            left, keys = left[~hit], keys[~hit]
            if not len(left):
                return out
            table, bits = self.escapes[k]
            row = table.rows(part[~hit] >> np.uint64(8))
            known = row >= 0
            out[left[known]] += bits[row[known]]
        out[left] += 8
        return out


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> Model:
    """Context trees of every language in ``docs (text, lang)``.

    The driver gets the distinct strings of the sample, whose size its bounds set.
    """
    schema = "lang string, string long, n long"
    own = sample(pick(docs, "text", "lang"), texts, chars)
    counted = (map_batches(own, _count_strings, schema)
               .groupBy("lang", "string").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counted["lang"].unique())
    strings, escapes = [], []
    below, below_keys = None, None
    own = [counted[counted["lang"] == name] for name in langs]
    own = [(x["string"].to_numpy().astype(np.uint64), x["n"].to_numpy()) for x in own]
    for k in range(ORDER + 1):
        per = []
        for keys, n in own:
            short, place = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(place, n, len(short))
            context, at = np.unique(short >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(at, counts), np.bincount(at)
            per.append((short, -np.log2(counts / (total + kinds)[at]),
                        context, -np.log2(kinds / (total + kinds))))
        every = np.unique(np.concatenate([p[0] for p in per])) if per else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([p[2] for p in per])) if per else every
        bits = np.zeros((len(every), len(langs)))
        leave = np.zeros((len(contexts), len(langs)))
        for j, (short, cost, context, escape) in enumerate(per):
            leave[np.searchsorted(contexts, context), j] = escape
            if k:
                shorter = every & np.uint64((1 << 8 * k) - 1)
                bits[:, j] = below[np.searchsorted(below_keys, shorter), j]
            else:
                bits[:, j] = 8
            bits[:, j] += leave[np.searchsorted(contexts, every >> np.uint64(8)), j]
            bits[np.searchsorted(every, short), j] = cost
        strings.append((_Table(every), bits.astype(np.float32)))
        escapes.append((_Table(contexts), leave.astype(np.float32)))
        below, below_keys = bits, every
    return Model(langs, strings, escapes)


def code_lengths(model: Model, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
    """Bits that each text takes in each language."""
    out = np.zeros((len(texts), len(model.langs)))
    data = b"".join(_PAD + t for t in texts)
    ends = np.cumsum([len(t) + ORDER for t in texts])
    for at in range(0, len(data) - ORDER, block):
        costs = model.costs(_strings(data[at: at + block + ORDER])).astype(np.float64)
        # Place i holds the cost of byte at + i + ORDER; the padding between texts has none.
        first, last = np.searchsorted(ends, [at + ORDER, at + ORDER + len(costs) - 1], "right")
        for d in range(first, min(last, len(texts) - 1) + 1):
            a = max(ends[d] - len(texts[d]) - at - ORDER, 0)
            b = min(ends[d] - at - ORDER, len(costs))
            if b > a:
                out[d] += costs[a:b].sum(0)
    return out


def _verdicts(model: Model, column: pa.Array) -> Iterator[tuple[str, float, float | None]]:
    texts = byte_texts(column)
    for part in slices(texts):
        bits = code_lengths(model, texts[part]) if model.langs else None
        for i, t in enumerate(texts[part]):
            if bits is None or not _LETTER.search(t.decode("utf-8", "replace")):
                yield UNKNOWN, 0.0, None
                continue
            over = bits[i] - bits[i].min()
            yield (model.langs[int(over.argmin())], float(1 / np.exp2(-over).sum()),
                   float(bits[i].min() / len(t)))


def _free(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added where columns have them already."""
    out = []
    for name in wanted:
        while name in names:
            name += "_"
        out.append(name)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the posterior of that language under equal
    priors) and ``bits_per_byte`` (null for ``und``) after its own columns; where they have
    these names already, underscores are added."""
    at = docs.columns.index(text)
    new = _free(docs.columns, "lang_pred", "score", "bits_per_byte")
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, new, kinds)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_verdicts(model, batch.column(at)))
            names, scores, bits = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(bits, pa.float64())],
                [*batch.schema.names, *new])

    return map_batches(docs, score, schema)


def _rate(text: Column) -> Column:
    """Bits a byte without the first ones."""
    return F.col("bits_per_byte") - FREE_BITS / F.octet_length(text)


def limits(docs: DataFrame, model: Model, texts: int = SAMPLE_TEXTS, stray: float = STRAY) -> dict[str, float]:
    """Per language the most bits a byte of its texts: `MARGIN` over the dearest of all labelled
    texts of ``docs (text, lang)`` that the model was not learned from, but for the dearest
    ``stray`` of them, which labels may be wrong about. Languages without such texts are left out.

    Rows are counted by cost, so a language is as many rows as there are steps of cost.
    """
    docs = pick(docs, "text", "lang")
    further = _labelled(docs).join(bounded(_chosen(docs, texts)), ["lang", "h"], "left_anti").select("text")
    costs = predict(further, model).filter(F.col("lang_pred") != UNKNOWN).groupBy(
        "lang_pred", F.ceil(_rate(F.col("text")) * STEPS).alias("cost")).agg(F.count("*").alias("n"))
    every = Window.partitionBy("lang_pred")
    dearer = F.sum("n").over(every.orderBy(F.desc("cost")))
    most = (costs.select("lang_pred", "cost", dearer.alias("dearer"), F.sum("n").over(every).alias("all"))
            .filter(F.col("dearer") > stray * F.col("all")).groupBy("lang_pred").agg(F.max("cost").alias("most")))
    return {r["lang_pred"]: r["most"] / STEPS + MARGIN for r in most.collect()}


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of every row of
    ``docs (doc_id, text, lang)``; learned from the texts that are not held out."""
    docs = pick(docs, "doc_id", "text", "lang")
    model = learn(docs.filter(learnable(F.col("doc_id"))))
    held = docs.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "text")
    return predict(held, model).drop("text")


def accepted(docs: DataFrame, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that are written in one of the learned languages."""
    need = pick(docs, "doc_id", "text", "lang")
    fit = need.filter(learnable(F.col("doc_id")))
    model = learn(fit)
    most = limits(fit, model)
    text = place(docs, "text")
    scored = predict(hide(docs), model, text)
    limit = F.coalesce(*[F.when(F.col("lang_pred") == k, F.lit(v)) for k, v in most.items()], F.lit(most_bits))
    return unhide(scored.filter((F.col("lang_pred") != UNKNOWN) & (_rate(F.col(text)) <= limit)), docs)
