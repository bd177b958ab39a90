"""Token alignment, Katz backoff and the prefix trie against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from brute_force import Katz, alignment_rows, in_order, score_rows, trie_rows
from pyspark.sql import functions as F
from test_text_operators import frame, odd, rows_of  # noqa: F401

from tallyhouse.llm import alignment, katz, prefix_trie

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- alignment ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    a, b = alignment.ByteTokenizer(A), alignment.PieceTokenizer(B)
    return a.entries, b.entries, lambda t: a.encode([t])[0], lambda t: b.encode([t])[0]


def test_alignment(spark, odd, tokenizers):  # noqa: F811
    rows = [r[:2] for r in odd] + [
        (200, "<|endoftext|> and </s> <s> <unk> <0x41>"), (201, "a▁b"), (202, "日本語 \U0001F600 é é"),
        (203, " lead and  two \n\n lines\t\x00\x7f"), (204, "x" * 3000), (205, " ​"), (206, " "),
        (207, "ﬁ ① Å"), (None, "日本語")]
    got = alignment.align(frame(spark, [(d, t, "en", "s") for d, t in rows]), A, B, lane=16, hot=50)
    want = alignment_rows(rows, *tokenizers)
    assert rows_of(got, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == want
    assert any(r[1] == 0 for r in want) and any(r[3] < min(r[1], r[2]) for r in want)


def test_alignment_is_the_same_without_broadcasts_and_in_one_lane(spark, odd):  # noqa: F811
    docs = frame(spark, odd)
    some = rows_of(alignment.align(docs, A, B, lane=7, hot=1))
    assert some == rows_of(alignment.align(docs, A, B, lane=10**9, hot=10**9))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\x0b\x1c\x85\xa0'’s're12ab.,<|>"), st.characters(max_codepoint=0x24F),
                                  st.characters(exclude_categories=["Cs"]))), max_size=6))
def test_pre_tokens_are_the_library_s(texts):
    ours = _BYTES[0] if _BYTES else _BYTES.append(alignment.ByteTokenizer(A)) or _BYTES[0]
    assert ours.plain
    assert ours.encode(texts) == ours._library([" " + t for t in texts])


_BYTES = []


def test_groups_spell_the_text(spark, tokenizers):
    text = "Über den <|endoftext|> Wolken 😀 antidisestablishmentarianism"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.groups for r in alignment.aligned(docs, A, B).collect()}
    assert found[2] == ""
    for side in (0, 1):
        ids = [int(i) for g in found[1].split(";") for i in g.split("|")[side].split(",")]
        assert b"".join(tokenizers[side][i] for i in ids).decode() == " " + text


def test_merge_against_sets_of_ends():
    pick = np.random.default_rng(2)
    for lane in (1, 3, 64):
        a, b, starts_a, starts_b, at = [], [], [0], [0], 0
        for _ in range(40):
            size = int(pick.integers(0, 60))
            for out, starts in ((a, starts_a), (b, starts_b)):
                cuts = set(pick.integers(1, size, pick.integers(0, size)).tolist()) | {size} if size > 1 else set()
                out += sorted(at + c for c in cuts)
                starts.append(len(out))
            at += size
        a, b = np.array(a), np.array(b)
        found = alignment.merge(a, b, np.array(starts_a), np.array(starts_b), lane)
        where = {e: i for i, e in enumerate(b.tolist())}
        assert found.tolist() == [where.get(e, -1) for e in a.tolist()]


# --- Katz backoff ------------------------------------------------------------------------------


def _held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def _near(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, odd, order):  # noqa: F811
    pick = random.Random(order)
    words = [f"v{min(int(pick.expovariate(0.05)), 120)}" for _ in range(4000)] + ["It's", "ÉTÉ", "x" * 200]
    rows = [r[:2] for r in odd] + [(100 + i, " ".join(pick.choices(words, k=pick.randint(0, 90)))) for i in range(120)]
    docs = frame(spark, [(d, t, "en", "s") for d, t in rows]).repartition(3)
    want = score_rows(rows, order, _held)
    assert any(r[1] for r in want) and any(r[3] < r[2] for r in want)
    _near(rows_of(katz.score_texts(docs, order, block=2000, part=3000), *COLUMNS), want)
    _near(rows_of(katz.score_texts(docs, order), *COLUMNS), want)


def test_katz_probabilities_add_up():
    pick = random.Random(4)
    texts = [pick.choices([f"v{i}" for i in range(30)], k=20) for _ in range(40)]
    model = Katz(texts, 3)
    words = {w for t in texts for w in t} | {"<end>", "never seen"}
    for h in [(), ("v1",), ("<start>",), ("v1", "v2"), tuple(texts[0][:2]), ("?", "v3")]:
        assert sum(model.p(h, w) for w in words) == pytest.approx(1)


@pytest.mark.parametrize("texts", [[None], ["", None, ""], ["a"] * 50, ["a b c"] * 50 + ["d"]])
def test_katz_on_few_words(spark, texts):
    for ids in (range(len(texts)), [2] * len(texts), [None] * len(texts)):
        rows = list(zip(ids, texts))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        _near(rows_of(katz.score_texts(docs), *COLUMNS), score_rows(rows, 2, _held))


def test_katz_beats_single_words_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = katz.score_texts(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[1] > sums[0]


# --- prefix trie -------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def _trie(spark, rows, **sizes):
    df = spark.createDataFrame(rows, TURNS)
    df = df.select("*", F.lit(1), F.lit(2), F.lit(3)).toDF(*df.columns, "c", "k1", "Turn")
    out = prefix_trie.trie(df, **sizes)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                           "saved_tokens", "ends_sha256"]
    return rows_of(out)


@pytest.fixture(scope="module")
def talk():
    pick = random.Random(9)
    rows = [(None, 1, "user", "nobody's"), (3, None, None, None), (3, 1, "user", "é"), (-7, 0, "user", "a"),
            (-5, 0, "user", "a"), (-5, 1, None, "b"), (404, 1, "user", "the base is absent")]
    for c in range(10, 90):
        for t in range(pick.randint(1, 14)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", pick.choice(["a", "b", "ccc"]) if t < 5 else f"t{c % 20}"))
    for c in range(200, 400):  # one conversation, very often
        rows += [(c, 0, "user", "hello"), (c, 1, "assistant", "again"), (c, 2, "user", "and again")]
    rows += [(500, t // 2, "user", f"turn {t % 3}") for t in range(3000)] * 2  # a very long one, with ties
    rows += [(505, t // 2, "user", f"turn {t % 3}") for t in range(3000)] * 2
    return rows


def test_trie(spark, talk):
    short = [r for r in talk if r[0] not in (500, 505)] + [r for r in talk if r[0] in (500, 505) and r[1] < 30]
    want = trie_rows(short)
    assert _trie(spark, short) == want
    assert _trie(spark, short, width=64, depth=1) == want  # a sketch too small to prove much


def test_trie_of_long_conversations(spark, talk):
    got = _trie(spark, [r for r in talk if r[0] in (500, 505)])
    depth = max(r[1] for r in got)
    assert depth == 6000 and len(got) >= 6001
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 2 and root[5] == sum(r[4] == 0 for r in got)
    assert root[6] == sum((r[3] - 1) * 6 for r in got if r[1])


def test_trie_of_few_rows(spark):
    for rows in ([(None, 1, "a", "b")], [(5, None, None, None)] * 3, [(7, 1, "u", "x")], [(4, 1, "u", "x"), (0, 1, "u", "x")]):
        assert _trie(spark, rows) == trie_rows(rows)
    assert spark.createDataFrame([], TURNS).transform(prefix_trie.trie).count() == 0


def test_lists_of_ids_are_hashed_in_order(spark):
    ids = list(range(-50, 5000))
    random.Random(1).shuffle(ids)
    rows = spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 9)], "k1 long, k2 long, c long")
    import hashlib
    got = {(r.k1, r.k2): r.ends for r in prefix_trie.ends(rows, 7).collect()}
    assert got == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(),
                   (1, 3): hashlib.sha256(b"9").hexdigest()}


@pytest.mark.parametrize("run", [lambda d: alignment.align(d, A, B), katz.score_texts])
def test_empty_documents(spark, run):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert run(docs).collect() == []


def test_registered_tables_are_whole(spark):
    from tallyhouse.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = in_order([tuple(r) for r in docs.select("doc_id", "text").collect()])
    _near(rows_of(QUERIES["op12_katz_score"](spark, folder), *COLUMNS), score_rows(rows, katz.ORDER, _held))


@pytest.mark.parametrize("values", [[], [0], [0, 0, 7], [255, 256, 1 << 40], [1, (1 << 64) - 1]])
def test_katz_packs_numbers(values):
    numbers = np.array(values, np.uint64)
    assert katz.unpack(katz.pack(numbers)).tolist() == values
    assert katz.unpack_sorted(katz.pack_sorted(numbers)).tolist() == values


def test_katz_packs_small():
    """Sorted hashes take their gaps only, counts a byte or two: what blocks and parts exchange."""
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 100_000, np.uint64))
    assert len(katz.pack_sorted(keys)) <= 7 * len(keys) + 1
    assert len(katz.pack(np.full(100_000, 300))) == 200_001
    assert {"keys binary", "n binary"} <= {c.strip() for c in katz._ASK.split(",")}


def test_alignment_tells_words_as_its_pre_tokens_do():
    """Every character that pre-tokens are cut by here: a space and letters, and nothing else."""
    letters = alignment.regex.compile(r" \p{L}+")
    for c in map(chr, range(0x250)):
        for p in (c, " " + c, " a" + c, "a" + c, " " + c + "b"):
            assert alignment.is_word(p) == bool(letters.fullmatch(p)), ascii(p)
    assert not alignment.is_word(" ")
