"""Token counts from pre-token frequencies.

A tokenizer of this kind cuts a text into pre-tokens and each pre-token into pieces, one
independent of the others. So pieces are counted once per distinct pre-token of the whole
collection, joined to the pre-token frequencies of each text, and summed; no ids are made.

Pre-tokens in many texts would be hot join keys. With R (text, pre-token) pairs, fewer than
K = `HOT` pre-tokens can be in R / K texts or more: these few are broadcast, whatever the
size of the collection, and counted where the text is read; the rare rest is joined by key.

Edge cases: null and empty texts have no bytes and no tokens. Special strings inside a text
are one token each, as the library has it by default. Rows that repeat (same id, same text)
come back as often as they came; so do rows with a null id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tallyhouse.llm.common import map_batches, pick, real_id, row_key
from tallyhouse.session import materialize

#: At most so many pre-tokens are broadcast, none longer than so many characters.
HOT = 1_000_000
HOT_CHARS = 64
#: A text with more tokens than this is over the limit.
LIMIT = 2048
_ROWS = 500_000

# Up to U+024F normal form C changes nothing and the library's pattern can be applied here
# as it is; other texts go through the library's own normaliser and pre-tokenizer.
_BEYOND = regex.compile(r"[^\x00-ɏ]")
_PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
_SPLIT = regex.compile("|".join(regex.escape(s) for s in _SPECIAL))

_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer, read once per process."""
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


_ALPHABET = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)


def pre_tokens(tokenizer: Tokenizer, text: str) -> tuple[list[str], int]:
    """Normalised pre-tokens of ``text`` before the byte alphabet, and its special strings."""
    parts = _SPLIT.split(text) if "<|" in text else [text]
    found: list[str] = []
    for part in parts:
        if _BEYOND.search(part):
            part = tokenizer.normalizer.normalize_str(part)
        else:
            part = part.lower()
        found += _PATTERN.findall(part)
    return found, len(parts) - 1


def pieces(tokenizer: Tokenizer, pre_token: str) -> int:
    return sum(len(tokenizer.model.tokenize(form))
               for form, _ in _ALPHABET.pre_tokenize_str(pre_token))


_TEXTS = "_d long, _h long, n_bytes long, known long, token array<string>, n array<long>"


def _frequencies(path: str, common=None):
    """Per text: bytes, tokens known so far, and the frequencies of its other pre-tokens.

    Known are the special strings and the pre-tokens in ``common``, a broadcast dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        sizes = common.value if common else {}
        for batch in batches:
            n_bytes, known, tokens, numbers = [], [], [], []
            size = start = 0
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                found, total = pre_tokens(tokenizer, text)
                rest = {}
                for token, n in Counter(found).items():
                    pieces_of = sizes.get(token)
                    if pieces_of is None:
                        rest[token] = n
                    else:
                        total += n * pieces_of
                n_bytes.append(len(text.encode()))
                known.append(total)
                tokens.append(list(rest))
                numbers.append(list(rest.values()))
                size += len(rest)
                if size > _ROWS or i == batch.num_rows - 1:
                    rows = [batch.column(c).slice(start, i + 1 - start) for c in ("_d", "_h")]
                    yield pa.RecordBatch.from_arrays(
                        [*rows, pa.array(n_bytes, pa.int64()), pa.array(known, pa.int64()),
                         pa.array(tokens, pa.list_(pa.string())),
                         pa.array(numbers, pa.list_(pa.int64()))],
                        ["_d", "_h", "n_bytes", "known", "token", "n"])
                    n_bytes, known, tokens, numbers = [], [], [], []
                    size, start = 0, i + 1

    return run


def _count_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            counts = [pieces(tokenizer, t) for t in batch.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())],
                                             [*batch.schema.names, "pieces"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs (doc_id, text)``.

    The tokenizer file at ``path`` must be readable on every worker. Its special strings
    and its pattern are those of `_SPECIAL` and `_PATTERN`.
    """
    keyed = pick(docs, "doc_id", "text").select(*row_key(F.col("doc_id"), F.col("text")), "text")
    pairs = map_batches(keyed, _frequencies(path), _TEXTS).select(F.explode("token").alias("token"))
    distinct = pairs.groupBy("token").agg(F.count("*").alias("texts"))
    vocabulary = materialize(map_batches(
        distinct, _count_pieces(path), "token string, texts long, pieces long"), "pieces")
    total = vocabulary.agg(F.sum("texts")).first()[0] or 0
    often = (F.col("texts") >= -(-total // hot)) & (F.length("token") <= HOT_CHARS)
    common = {r["token"]: r["pieces"] for r in vocabulary.filter(often).toLocalIterator()}
    sizes = docs.sparkSession.sparkContext.broadcast(common)
    texts = map_batches(keyed, _frequencies(path, sizes), _TEXTS)
    # One row carries what is known of the text itself; its key is no pre-token and never hot.
    header = F.struct(F.concat(F.lit("\n"), F.col("_h").cast("string")).alias("token"),
                      F.col("known").alias("n"), F.col("n_bytes"), F.lit(1).alias("rows"))
    own = F.transform(F.arrays_zip("token", "n"), lambda x: F.struct(
        x["token"].alias("token"), x["n"].alias("n"), F.lit(0).cast("long").alias("n_bytes"),
        F.lit(0).alias("rows")))
    rows = texts.select("_d", "_h", F.explode(F.concat(F.array(header), own)).alias("x"))
    summed = (rows.select("_d", "_h", "x.*")
              .join(vocabulary.filter(~often).select("token", "pieces"), "token", "left")
              .groupBy("_d", "_h").agg(
                  F.sum("rows").alias("rows"), F.sum("n_bytes").alias("n_bytes"),
                  F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n")))
    tokens = F.expr("n div rows")
    return summed.select(
        real_id(F.col("_d")).alias("doc_id"), F.expr("n_bytes div rows").alias("n_bytes"),
        tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")).drop("copy")
