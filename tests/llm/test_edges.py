"""Inputs that broke an operator once: repeats, short texts, words made to collide."""

import collections

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute_force import jaccard_rows, substring_rows
from pyspark.sql import functions as F
from test_text_operators import frame, rows_of

from tallyhouse.llm import (common, fingerprints, jaccard_join, katz, langid, mixing, substrings,
                            token_counts)
from tallyhouse.session import configure

TEXTS = "doc_id long, text string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, TEXTS).withColumns({"source": F.lit("x"), "lang": F.lit("en")})


# --- slices without any set that needs a signature ---------------------------------------------

SMALL = [[(1, "hello world foo")], [(1, "")], [(1, None)], [(i, "a b") for i in range(6)],
         [(None, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "x y z")]]


@pytest.mark.parametrize("rows", SMALL)
@pytest.mark.parametrize("words, share", [(3, 90), (5, 80)])
def test_jaccard_of_few_shingles(spark, rows, words, share):
    df = docs_of(spark, rows)
    want = jaccard_rows(rows, share, words)
    assert rows_of(jaccard_join.similarity_classes(df, words, share)) == want
    alone = sum(r[1] == 0 for r in want)
    found = jaccard_join.one_of_each(df, words, share).count()
    assert found == alone + len({t for _, t in rows if t})


@pytest.mark.parametrize("words, share", [(3, 90), (5, 80)])
def test_jaccard_of_one_text_very_often(spark, words, share):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.range(25_000).coalesce(1).select(
        F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("s").alias("source"))
    got = jaccard_join.similarity_classes(df, words, share)
    assert got.filter(f"component_id <> 0 OR n_shingles <> {61 - words}").isEmpty() and got.count() == 25_000
    assert jaccard_join.one_of_each(df, words, share).count() == 1


# --- repeated rows in the mix --------------------------------------------------------------------


def _sums(df):
    """Per source: target, words taken, and the largest size."""
    out = collections.defaultdict(lambda: [0.0, 0, 0])
    for r in df.collect():
        at = out[r.source_size, r.target]
        at[0], at[1], at[2] = r.target, at[1] + r.taken, max(at[2], r.size)
    return out


@pytest.mark.parametrize("ids", ["equal", "missing", "half"])
def test_mix_of_repeated_rows(spark, ids):
    """1,000 equal texts of one source, beside two other sources, come within half a text."""
    number = {"equal": lambda i: 7, "missing": lambda i: None, "half": lambda i: i if i % 2 else None}[ids]
    rows = [(number(i), "one two three four", "x") for i in range(1000)]
    rows += [(5000 + i, " ".join(["w"] * (1 + i % 7)), s) for i in range(600) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(df)
    for target, taken, size in _sums(got).values():
        assert abs(target - taken) <= size / 2 + 1e-6
    for r in got.collect():
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
    assert rows_of(got) == rows_of(mixing.mix_sources(df.repartition(3)))
    mix = mixing.mixture(df.withColumn("copy", F.lit("mine")))
    assert mix.columns[-2:] == ["copy", "copy_"]
    assert mix.count() == sum(r.taken // r.size for r in got.collect())


def test_rounding_in_blocks_carries_what_is_left(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 40)), s) for i in range(400) for s in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = df.select("source", *mixing.measured())
    classes = keyed.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = mixing.targets(sizes)
    rate = F.when(F.col("source") == "a", 0.4371).otherwise(1.13) + F.col("size") * 0.001
    rated = classes.join(goals, "source").select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    for stride in (5, 1000):
        out = mixing.rounded_classes(rated, 3, stride)
        assert out.count() == classes.count()
        off = rated.select("source", "size", "rate").join(out, ["source", "size"]).groupBy("source").agg(
            F.sum(F.col("size") * (F.col("copies") - F.col("rate") * F.col("n"))).alias("off"))
        assert all(abs(r.off) <= 0.5 + 1e-6 for r in off.collect())  # half the smallest text


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(1)
    size = {f"s{i:04d}": int(x) for i, x in enumerate(rng.pareto(0.7, 500) * 50)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(
        list(size.items()), "source string, source_size long")).collect()}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    left, open_, want = float(sum(size.values())), set(size), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * size[s] < level * weight[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    assert got == pytest.approx(want)


# --- words made to collide -----------------------------------------------------------------------


def thue_morse(a, b, n):
    word = [a, b]
    while len(word) < n:
        word += [b if x == a else a for x in word]
    return word, [b if x == a else a for x in word]


def test_word_hashes_have_no_polynomial_collisions():
    for n in (64, 1024, 4096):
        one, other = ("".join(w).encode() for w in thue_morse("a", "b", n))
        words, _ = common.words_of([one, other])
        assert words[0] != words[1]
        one, other = (" ".join(w).encode() for w in thue_morse("a", "b", n))
        words, starts = common.words_of([one, other])
        assert common.grams(words[:n], n)[0] != common.grams(words[n:], n)[0]


def test_operators_tell_such_words_apart(spark):
    one, other = ("".join(w) for w in thue_morse("a", "b", 1024))
    rest = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*rest[:30], one, *rest[30:]])), (2, " ".join([*rest[:30], other, *rest[30:]]))]
    assert rows_of(substrings.remove_repeats(docs_of(spark, rows))) == substring_rows(rows)
    assert rows_of(jaccard_join.similarity_classes(docs_of(spark, rows))) == jaccard_rows(rows)
    found = fingerprints.fingerprint_pairs(docs_of(spark, [(1, one + " x y z"), (2, other + " x y z")])).collect()
    assert len({r.fingerprint for r in found}) == 2


# --- tables of one row, all null, all equal ------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("rows", [[(1, "one text")], [(None, None)] * 3, [(2, "a b c")] * 40, [(1, ""), (1, "")]])
@pytest.mark.parametrize("run", [
    langid.identify, lambda d: token_counts.count_tokens(d, TOKENIZER), fingerprints.fingerprint_pairs,
    substrings.remove_repeats, mixing.mix_sources, jaccard_join.similarity_classes])
def test_plain_tables(spark, run, rows):
    docs = frame(spark, [(d, t, "en", "s") for d, t in rows])
    assert run(docs).count() == len(rows)


def test_broadcasts_are_bounded_by_bytes(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString()

    narrow = spark.range(100).select("id", F.lit("x").alias("text"))
    wide = narrow.withColumn("text", F.repeat(F.lit("x"), 400_000))
    listed = narrow.select(F.split(F.repeat(F.lit("word "), 100_000), " ").alias("words"))
    assert hinted(common.bounded(narrow)) and not hinted(common.bounded(wide))
    assert not hinted(common.bounded(listed)) and not hinted(common.bounded(narrow, 100))


def test_limits_come_from_all_texts_that_the_fit_left_out(spark):
    """Of 400 further texts one is dear, wherever its hash puts it; two of 100 are more than stray."""
    rows = [(f"the cat sat on mat {i} and the dog ran", "en") for i in range(401)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.learn(docs, 1)
    plain = langid.limits(docs, model, 1)["en"]
    dear = "zq§x vj§w " * 9
    one = docs.unionByName(spark.createDataFrame([(dear, "en")], docs.schema))
    assert abs(langid.limits(one, model, 1)["en"] - plain) < 0.5
    assert langid.limits(one, model, 1, 0.0)["en"] > plain + 1
    many = docs.limit(100).unionByName(spark.createDataFrame([(dear + c, "en") for c in "ab"], docs.schema))
    assert langid.limits(many, model, 1)["en"] > plain + 1


def test_large_rows_are_written_and_sent_in_small_lots(spark, monkeypatch):
    found, materialize = {}, katz.materialize

    def kept(df, label, rows=None):
        out = materialize(df, label, rows)
        files = [pq.ParquetFile(f.replace("file://", "")).metadata for f in out.inputFiles()]
        found[label] = max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups))
        return out

    monkeypatch.setattr(katz, "materialize", kept)
    monkeypatch.setattr(katz, "ANSWERS", 2)
    docs = spark.createDataFrame([(i, f"a{i} b c{i % 9} d") for i in range(200)], "doc_id long, text string").coalesce(1)
    assert katz.score_texts(docs, block=256, part=2048).count() == 200
    assert found == {"blocks": 1, "counts": 2, "weights": 2}
    assert configure(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "32m"
