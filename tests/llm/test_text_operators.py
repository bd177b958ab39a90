"""Operators against brute force, and their stated edge cases."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from brute_force import (code_length, contamination_rows, in_order, jaccard_rows, removed, shingle_set,
                         substring_rows)
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyhouse import session
from tallyhouse.llm import (common, decontaminate, fingerprints, jaccard_join, langid, licenses,
                            mixing, substrings, token_counts, url_filter, warc)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents, with columns that clash with the operators' own names."""
    full = [(d, t, lang, source, len(t or "")) for d, t, lang, source in rows]
    df = spark.createDataFrame(full, DOCS)
    for extra in ("Text", "_d", "_h", "n", "words", "size", "hash", "score", "pos", "node"):
        df = df.withColumn(f"x{extra}", F.lit(1))
    return df.toDF(*[c[1:] if c.startswith("x") else c for c in df.columns])


def rows_of(df, *names):
    return in_order([tuple(r) for r in (df.select(*names) if names else df).collect()])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, near copies, shared passages."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Élan", "über", "ſ", "ΑΣ"]
    passage = " ".join(pick.choices(words, k=70))
    base = pick.choices(words, k=120)
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "one", "en", None),
            (4, "One", "en", "b"), (5, "one two", None, "b"), (6, "12 34", "en", "b")]
    for i in range(7, 40):
        text = pick.choices(words, k=pick.randint(5, 150))
        if i % 3 == 0:
            text[5:5] = passage.split()
        rows.append((i, ("\x0b" if i % 2 else "  ").join(text), "en", f"s{i % 4}"))
    for i in range(40, 60):
        copy = list(base)
        for _ in range(pick.randint(0, 3)):
            copy[pick.randrange(120)] = "new"
        rows.append((i, " ".join(copy), "en", "s1"))
    rows += [rows[45], rows[45], (45, " ".join(base), "de", "s1"), (None, " ".join(base), "de", "s1")]
    rows.append((70, " ".join(["again"] * 3000 + base), "en", "s2"))
    return rows


def test_substrings(spark, odd):
    pairs = [(r[0], r[1]) for r in odd]
    for limits in ({}, {"group_words": 60}):
        got = rows_of(substrings.remove_repeats(frame(spark, odd), **limits))
        assert got == substring_rows(pairs)
    got = rows_of(substrings.remove_repeats(frame(spark, odd), window=12, anchor=4))
    assert got == substring_rows(pairs, 12)


def test_texts_without_repeats(spark, odd):
    docs = frame(spark, odd)
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    left = [[x for x, g in zip(w, gone) if not g] for w, gone in removed([(r[0], r[1]) for r in odd], 50)]
    had = [bool((r[1] or "").split()) for r in odd]
    assert out.count() == sum(bool(k) or not h for k, h in zip(left, had)) < len(odd)
    for row in common.pick(out, "doc_id", "text", "n_chars").collect():
        assert row.n_chars == len(row.text or "")
    texts = {r.text for r in common.pick(out, "text").collect()}
    assert {" ".join(x.decode() for x in k) for k, h, r in zip(left, had, odd)
            if k and len(k) < len((r[1] or "").encode().split())} <= texts


def test_jaccard(spark, odd):
    pairs = [(r[0], r[1]) for r in odd]
    assert rows_of(jaccard_join.similarity_classes(frame(spark, odd))) == jaccard_rows(pairs)
    got = rows_of(jaccard_join.similarity_classes(frame(spark, odd), 2, 70))
    assert got == jaccard_rows(pairs, 70, 2)


def test_jaccard_joins_chains_that_share_no_center(spark):
    """Copies that are each near the base, but not each other, whatever their order."""
    pick = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(30):
        copy = list(base)
        for j in pick.sample(range(10, 190), 3):
            copy[j] = f"{i}-{j}"
        rows.append((i, " ".join(copy)))
    rows.append((99, " ".join(base)))
    got = rows_of(jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")))
    want = jaccard_rows(rows)
    assert got == want and {r[2] for r in want} == {0}


def test_fine_marks_tell_long_sets_apart():
    rng = np.random.default_rng(5)
    whole = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    for kept, other in ((2000, 2000), (2900, 2600), (1100, 900), (2700, 2700)):
        a, b = whole[:kept], np.concatenate((whole[kept - other // 2: kept], rng.integers(
            0, 1 << 63, other - other // 2).astype(np.uint64)))
        apart = len(np.setxor1d(a, b))
        x, y = (jaccard_join.fine_marks(v).view(np.uint64) for v in (a, b))
        if len(x) and len(y):
            size = min(len(x), len(y))
            x, y = (np.bitwise_xor.reduce(v.reshape(-1, size)) for v in (x, y))
            told = int(np.bitwise_count(x ^ y).sum())
            # Never more than they differ in, and here more than alike sets of 80 % can differ in.
            assert (len(a) + len(b)) * 20 / 180 < told <= apart


def test_long_texts_that_share_much_are_judged_by_few_sets(spark, monkeypatch):
    """Texts around the threshold, in chains; marks settle most pairs before sets travel."""
    rng = np.random.default_rng(6)
    base, rows = [f"w{i}" for i in range(1300)], []
    for i in range(24):
        words = list(base)
        at = int(rng.integers(0, 1300)) if i % 3 else 40 * i
        for j in range(at, at + (60 if i % 3 else 500)):
            words[j % 1300] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    pairs, settled = [], jaccard_join.settled

    def counted(spark, make, label):
        out = settled(spark, make, label)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "settled", counted)
    got = rows_of(jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80))
    assert got == jaccard_rows(rows, 80, 5)
    assert 0 < sum(pairs) < 24 * 23 / 2 / 2


def test_jaccard_in_several_passes(spark, monkeypatch):
    """What one job shuffles is bounded: signatures and pairs take several, with the same links."""
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(14):
        words = list(base)
        for j in range(4 * i, 4 * i + 5):
            words[j % 120] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    made, settled = [], session.settled

    def counted(spark, make, label):
        made.append(label)
        return settled(spark, make, label)

    monkeypatch.setattr(session, "settled", counted)
    monkeypatch.setattr(jaccard_join, "settled", counted)
    monkeypatch.setattr(jaccard_join, "LEAST_PASS", 700)
    monkeypatch.setattr(jaccard_join, "PASS", 2)
    got = rows_of(jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80))
    assert got == jaccard_rows(rows, 80, 3)
    assert made.count("met") > made.count("pairs") and made.count("compared") > made.count("judged")


def test_one_of_each(spark, odd):
    docs = frame(spark, odd)
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    classes = jaccard_rows([(r[0], r[1]) for r in odd])
    alone = sum(1 for r in classes if r[1] == 0)
    assert out.count() == alone + len({r[2] for r in classes if r[1]})


def test_one_of_each_keeps_unrelated_texts_with_missing_or_equal_ids(spark):
    pick = random.Random(8)
    a, b, c, d, e = (" ".join(f"{x}{pick.randrange(500)}" for _ in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, a), (7, c), (7, d), (7, c), (9, d), (None, e), (8, e), (None, "")]
    docs = frame(spark, [(i, t, "en", "s") for i, t in rows])
    got = common.pick(jaccard_join.one_of_each(docs), "doc_id", "text").collect()
    assert in_order([tuple(r) for r in got]) == in_order(
        [(None, a), (None, b), (7, c), (7, d), (8, e), (None, "")])


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 30), st.integers(0, 30), st.sampled_from([(0, 1), (1, 2), (2, 4)]),
       st.integers(0, 2**31))
def test_alike_sets_share_a_signature(size, less, more, levels, seed):
    pick = np.random.default_rng(seed)
    a = np.unique(pick.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.concatenate([a[min(less, size - 1):], pick.integers(0, 2**63, more).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both < 90 * (len(a) + len(b) - both) or both == len(a) == len(b):
        return
    found = []
    for s in (a, b):
        number = jaccard_join.band(len(s))
        found.append(set(jaccard_join.signatures([s, s], [number, number + 1], 90, *levels)[1].tolist()))
    assert found[0] & found[1]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 300), st.integers(0, 60), st.integers(0, 2**31))
def test_marks_differ_in_no_more_places_than_sets_differ(size, more, seed):
    pick = np.random.default_rng(seed)
    a = np.unique(pick.integers(0, 2**63, size).astype(np.uint64))
    b = np.unique(np.concatenate([a[more // 2:], pick.integers(0, 2**63, more).astype(np.uint64)]))
    x, y = jaccard_join._marks(a).view(np.uint64), jaccard_join._marks(b).view(np.uint64)
    apart = sum(int(v).bit_count() for v in x ^ y)
    assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_contamination_cuts_each_text_into_words_once(spark, odd, monkeypatch):
    cut, words_of = [], decontaminate.words_of
    monkeypatch.setattr(decontaminate, "words_of", lambda text: cut.append(text) or words_of(text))
    bench = spark.createDataFrame([(1, odd[10][1]), (2, "one")], "item_id long, text string")
    decontaminate.decontaminate(frame(spark, odd), bench).collect()
    assert len(cut) == 2  # items, documents


def test_contamination(spark, odd):
    items = [(1, odd[10][1]), (2, "one"), (3, None), (4, ""), (5, "W3 w4, W5"), (6, odd[12][1].upper()),
             (6, odd[12][1]), (None, "élan ſ"), (7, "ONE"), (8, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contamination_rows([(r[0], r[1]) for r in odd], items)
    assert sum(r[5] for r in want) > 3
    assert rows_of(decontaminate.decontaminate(frame(spark, odd), bench)) == want
    clean = decontaminate.clean(frame(spark, odd), bench)
    assert clean.count() == sum(not r[5] for r in want)
    none = decontaminate.decontaminate(frame(spark, odd), bench.filter("false"))
    assert {r[2] for r in rows_of(none)} == {0}


def test_contamination_by_words_whose_lower_case_depends_on_neighbours(spark):
    """A capital sigma is lower-cased by what stands around it, across the ends of words."""
    phrase = "Η Δ.Σ. ΛΟΓΟΣ.Α του ΟΣ'Α και ΑΣ: Σ"
    rows = [(1, f"x {phrase} y"), (2, "Δ.Σ."), (3, "ΛΟΓΟΣ.Α x"), (4, "λογος α")]
    items = [(1, phrase), (2, "Σ"), (3, "ΛΟΓΟΣ Α")]
    docs = frame(spark, [(i, t, "el", "s") for i, t in rows])
    got = rows_of(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == contamination_rows(rows, items) and [r[3] for r in got] == [3, 1, 1, 0]


def test_contamination_without_broadcasts(spark, odd, monkeypatch):
    items = [(1, odd[10][1]), (2, "one"), (5, odd[20][1])]
    monkeypatch.setattr(decontaminate, "bounded", lambda df, limit=0: df)
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = decontaminate.decontaminate(frame(spark, odd), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == contamination_rows([(r[0], r[1]) for r in odd], items)


def test_proximity(spark):
    docs = [(1, "alpha x beta"), (2, "alpha x x x x beta"), (3, "beta alpha"), (4, "alpha")]
    keyed = spark.createDataFrame(docs, "doc_id long, text string").select(
        *common.row_key(F.col("doc_id"), F.col("text")), "text")
    wanted = decontaminate.phrases(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    terms = wanted.select(F.explode("terms").alias("term"))
    search = decontaminate.search_terms(wanted, decontaminate.term_counts(keyed, terms))
    index = decontaminate.postings(keyed, terms)
    for slack, want in ((0, []), (1, [1]), (2, [1, 3]), (4, [1, 2, 3])):
        got = decontaminate.proximity_matches(index, search, slack)
        assert sorted(r["_d"] for r in got.collect()) == want


def test_token_counts(spark, odd):
    extra = ["Σ ΑΣ İstanbul's I'll \x1c\x1d <|endoftext|>a<|startoftext|> <|ENDOFTEXT|> 中文 é １２ ½",
             "<|endoftext|><|endoftext|>", "'s'S'T don't \x85 \xa0 ²³ ª º ŉ ǅ ẞ", "ﬁ ſ ﷺ  a　b ''s!!'re",
             "x" * 5000, "e\u0301 \u1100\u1161"]
    rows = odd + [(100 + i, t, "en", "s") for i, t in enumerate(extra)]
    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for d, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 2048))
    for hot in (10, 1_000_000):
        assert rows_of(token_counts.count_tokens(frame(spark, rows), TOKENIZER, hot=hot)) == in_order(want)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pre_tokens_are_the_library_s(text):
    library = Tokenizer.from_file(TOKENIZER) if not hasattr(test_pre_tokens_are_the_library_s, "t") \
        else test_pre_tokens_are_the_library_s.t
    test_pre_tokens_are_the_library_s.t = library
    found, special = token_counts.pre_tokens(library, text)
    n = special + sum(token_counts.pieces(library, p) for p in found)
    assert n == len(library.encode(text, add_special_tokens=False).ids)


def test_language_id(spark):
    pick = random.Random(1)
    rows = []
    for i in range(300):
        lang, words = pick.choice([("aa", ["bar", "foo", "baz"]), ("bb", ["énu", "tila", "kor"])])
        rows.append((i, " ".join(pick.choices(words, k=8)), lang, "s"))
    rows += [(400, None, "aa", "s"), (401, "12 !", "aa", "s"), (402, "", None, "s"), (None, "foo bar", None, "s"),
             (403, "foo " * 80_000, None, "s"), (404, "tila", "aa", "s"), (404, "tila", "aa", "s")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(docs).collect()}
    assert langid.identify(docs).count() == len(rows)
    for d, _, lang, _ in rows[:300]:
        assert (d, lang) in got
    for d in (400, 401, 402):
        assert got[(d, "und")].score == 0
    assert (403, "aa") in got and (None, "aa") in got and (404, "bb") in got
    assert all(0 <= r.score <= 1 for r in got.values())
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
               for r in got.values() if r.doc_id is not None)
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    nothing = langid.identify(docs.filter("false"))
    assert nothing.count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_code_lengths_are_exact(spark):
    train = {"aa": ["abracadabra", "banana bread"], "bb": ["über alles", "çava"]}
    docs = spark.createDataFrame([(t, k) for k, v in train.items() for t in v], "text string, lang string")
    model = langid.learn(docs)
    texts = [t.encode() for t in ("abra banana", "über", "zz", "", "ça " * 40, "\x00\x01")]
    got = langid.code_lengths(model, texts, block=7)
    for j, lang in enumerate(model.langs):
        known = [t.encode() for t in train[lang]]
        for i, t in enumerate(texts):
            assert got[i, j] == pytest.approx(code_length(known, langid.ORDER, t), rel=1e-5)


def test_fingerprints(spark, odd):
    rows = [(r[0], r[1]) for r in odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprint_pairs(frame(spark, odd)).collect()
    assert len(got) == len(rows)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    texts = [r.text or "" for r in order]
    want = []
    for i, r in enumerate(order):
        changed = fingerprints.edited(texts[i], texts[(i + 1) % len(texts)])
        want.append((r.doc_id, len(texts[i]), hashlib.sha256(changed.encode()).hexdigest()))
    assert in_order([(r.doc_id, r.n_chars, r.edited_sha256) for r in got]) == in_order(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_pairs(docs.filter("false")).count() == 0
    one = fingerprints.fingerprint_pairs(docs.filter("doc_id = 10")).collect()[0]
    assert one.near_next == 1


def _sketch(text):
    return fingerprints.encode(fingerprints.sketch_hashes([text.encode()])[0])


def test_sketches_estimate_and_merge(spark):
    pick = random.Random(2)
    words = [f"v{i}" for i in range(3000)]
    a = pick.choices(words, k=2000)
    b = a[:1500] + pick.choices(words, k=700)
    x, y = _sketch(" ".join(a)), _sketch(" ".join(b))
    s, t = shingle_set(" ".join(a), 5), shingle_set(" ".join(b), 5)
    assert abs(fingerprints.resemblance(x, y) - len(s & t) / len(s | t)) < 0.15
    assert abs(fingerprints.containment(x, y) - len(s & t) / len(s)) < 0.2
    assert abs(fingerprints.distinct_shingles(x) / len(s) - 1) < 0.3
    assert _sketch("") == "" and fingerprints.resemblance("", "") == 1 and fingerprints.resemblance("", x) == 0
    assert _sketch("a b") == _sketch("a \n b") != _sketch("a b c")
    parts = [(i % 2, " ".join(pick.choices(words, k=300))) for i in range(8)] + [(None, None), (None, "k l")]
    docs = fingerprints.add_fingerprint(spark.createDataFrame(parts, "g long, text string"))
    got = {r.g: r.fingerprint for r in fingerprints.merge_by(docs, "g").collect()}
    for g in (0, 1, None):
        assert got[g] == fingerprints.merge([_sketch(t or "") for k, t in parts if k == g])


def test_mix(spark, odd):
    docs = frame(spark, odd)
    got = mixing.mix_sources(docs)
    rows = got.collect()
    assert len(rows) == len(odd)
    assert rows_of(got) == rows_of(mixing.mix_sources(docs))
    sizes = {}
    for _, t, _, source in odd:
        sizes[source] = sizes.get(source, 0) + len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    want, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 3 * sizes[s]
            left -= want[s]
            open_.discard(s)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        by.setdefault((r.source_size, round(r.target, 3)), []).append((r.taken, r.size))
    assert set(by) == {(sizes[s], round(want[s], 3)) for s in names}
    for (_, target), taken in by.items():  # no mix is nearer than half a text, if only one is left
        assert abs(sum(t for t, _ in taken) - target) <= max(n for _, n in taken) / 2
    mix = mixing.mixture(docs)
    assert mix.columns == [*docs.columns, "copy"]
    assert mix.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mixing.mix_sources(docs.filter("false")).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs.filter("doc_id < 3")).collect()} == {0}


RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow",
         "com/de/": "block"}


def test_url_filter(spark):
    urls = [("http://a.example.org/es/1?x", "a.example.org", "/es/1", "example.org/es/"),
            ("http://EXAMPLE.org/en/12", "example.org", "/en/12", "example.org/en/1"),
            ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/"),
            ("http://x.org", "x.org", "", None), ("x.org/es/", "", "", None), (None, "", "", None),
            ("a://b.com/de/#z://c.org/", "b.com", "/de/", "com/de/"), ("http://org/", "org", "/", "org/"),
            ("http://m.spamcasino.net/q", "m.spamcasino.net", "/q", None), ("", "", "", None),
            ("http://b.com/fr/?://", "b.com", "/fr/", "com/fr/"), ("http://b.com?a/fr/", "b.com", "", None)]
    pages = [(i, u[0], "<p>spam casino the them</p>" if i else None) for i, u in enumerate(urls)]
    pages += [pages[0], (None, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = url_filter.judge(df, RULES).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.page_id is not None:
            _, host, path, rule = urls[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict in ("allow", "block")
            if rule:
                assert r.verdict == RULES[rule]
    seeded = url_filter.judge(df, RULES, ("spam", "casino")).collect()
    assert next(r for r in seeded if r.page_id == 8).verdict == "block"
    assert url_filter.judge(df.filter("false"), RULES).count() == 0


def test_segmentation(spark):
    counts = spark.createDataFrame([("the", 50), ("them", 20), ("me", 9), ("park", 8), ("car", 9)], "word string, n long")
    runs = spark.createDataFrame([("themepark",), ("carzq",), ("the",)], "run string")
    got = {r.run: r.words for r in url_filter.segment(runs, counts).collect()}
    assert got["the"] == ["the"] and "".join(got["carzq"]) == "carzq" and got["carzq"][0] == "car"
    assert got["themepark"] == ["the", "me", "park"]


def test_warc(spark, tmp_path):
    page = ("<html><head><title>A &amp; B</title><script>x('</p>')</script></head><body><p>Eins&nbsp;zwei"
            "<br>drei <b>v</b>ier</p><!-- <p>no</p> --><a href='/x'>l</a></body></html>")
    pages = [(1, "http://a/ b", page), (2, None, None), (2, None, None), (None, "u", "plain < text")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("record", F.lit(1))
    records = warc.responses(df)
    out = warc.derive(records)
    rows = out.collect()
    assert len(rows) == 4 and all(r.error is None for r in rows)
    first = next(r for r in rows if r.page_id == 1)
    assert first.text == "A & B\nEins\xa0zwei\ndrei vier\nl"
    source, _ = warc.parse(bytes(records.filter("page_id = 1").first().record))
    for kind in ("conversion", "metadata"):
        fields, block = warc.parse(bytes(first[kind]))
        assert warc.field(fields, "WARC-Type") == kind
        assert warc.field(fields, "WARC-Refers-To") == warc.field(source, "WARC-Record-ID") == first.refers_to
        assert warc.field(fields, "WARC-Block-Digest") == warc.digest(block)
        assert warc.field(fields, "WARC-Target-URI") == "http://a/%20b"
    notes = warc.parse(bytes(first.metadata))[1].decode().split("\r\n")
    assert "source-header: Content-Type: text/html; charset=utf-8" in notes and "links: 1" in notes
    assert "title: A & B" in notes and f"source-payload-digest: {warc.digest(page.encode())}" in notes
    damaged = [(1, b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nx"), (2, b""), (3, None),
               (4, warc.build([("WARC-Type", "request")], b"")), (5, b"junk\r\n\r\n")]
    bad = warc.derive(spark.createDataFrame(damaged, "page_id long, record binary")).collect()
    assert all(r.error and r.conversion is None for r in bad)
    path = str(tmp_path / "out")
    warc.write(out.select(F.explode(F.array("conversion", "metadata")).alias("record")), path)
    data, n = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))), 0
    while data:
        fields, block = warc.parse(data)
        assert warc.digest(block) == warc.field(fields, "WARC-Block-Digest")
        data, n = data[data.index(b"\r\n\r\n") + 8 + len(block):], n + 1
    assert n == 8
    assert warc.derive(records.filter("false")).count() == 0


def test_licenses(spark):
    files = [("a/LICENSE", "Released under the MIT License"), ("a/b/x.c", "int x;"), ("a/b/c/y.c", None),
             ("a/b/z.c", "/* Licensed under the Apache License, Version 2.0. */\nint z;"),
             ("d/w.c", ""), (None, "All rights reserved."), (None, None), ("LICENCE.txt", "nothing to see"),
             ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
             ("a/b/x.c", "int x;"), ("q.c", "licensed"), ("e/f/LICENSE", "All rights\nreserved.")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "id long, path string, text string")
    got = {r.id: r for r in licenses.scan(df.withColumn("dir", F.lit(1))).collect()}
    assert len(got) == len(files)
    want = {0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("GPL-3.0", "inherited"), 3: ("Apache-2.0", "own"),
            4: (None, "none"), 5: ("Proprietary", "own"), 6: (None, "none"), 7: (None, "none"),
            8: ("GPL-3.0", "own"), 9: ("MIT", "inherited"), 10: (None, "none"), 11: ("Proprietary", "own")}
    assert {i: (r.license, r.origin) for i, r in got.items()} == want
    assert got[1].from_path == "a/LICENSE" and got[2].from_path == "a/b/c/COPYING"
    assert licenses.scan(df.filter("false")).count() == 0


def test_license_cosines_are_those_of_all_lines(spark):
    """Lines left out early could not have reached the threshold."""
    import math
    import re
    lines = [*licenses.TEMPLATES.values(), "the license", "public license version", "all my rights",
             "under the sea", "released under license mit yes", "rights reserved"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id long, text string")
    got = {r.id: (r.license, r.cosine) for r in licenses.scan(df.withColumn("path", F.lit("x"))).collect()}
    split = [re.findall(r"[^\W_]+", t.lower()) for t in lines]
    n = len(lines)
    known = {w for t in licenses.TEMPLATES.values() for w in re.findall(r"[^\W_]+", t.lower())}
    idf = {w: math.log((1 + n) / (1 + sum(w in s for s in split if w in known))) + 1
           for s in split for w in s}

    def vector(words):
        return {w: words.count(w) * idf[w] for w in words}

    def cosine(a, b):
        return (sum(a[w] * b.get(w, 0) for w in a)
                / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())))

    for i, words in enumerate(split):
        scores = [(-round(cosine(vector(words), vector(re.findall(r"[^\W_]+", t.lower()))), 9), k)
                  for k, t in sorted(licenses.TEMPLATES.items())]
        best = min(scores)
        if -best[0] >= licenses.THRESHOLD:
            assert got[i][0] == best[1] and got[i][1] == pytest.approx(-best[0], abs=1e-6)
        else:
            assert got[i][0] is None


def test_license_notices_in_paragraphs_and_bodies_of_licenses(spark):
    prose = " ".join(f"w{i}" for i in range(15))
    mit = " ".join(licenses.PASSAGES["MIT"][0].split())
    gpl3, lgpl = licenses.PASSAGES["GPL-3.0"][0], licenses.PASSAGES["LGPL-3.0"][0]
    cases = [
        (f"{prose} Released under the MIT License. {prose}", "MIT"),
        (f"{prose}\n# This work is licensed under\n# the GNU General Public\n# License, version 3.\n{prose}", "GPL-3.0"),
        (f"Copyright (c) 2020 Jane Doe. All rights reserved.\n\n{mit}\n{prose}", "MIT"),
        (f"{prose} {mit.replace('hereby ', '').replace('publish, ', '')} {prose}", "MIT"),
        ("MIT License", "MIT"), ("SPDX-License-Identifier: MIT", "MIT"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0"),
        ("SPDX-License-Identifier: Zlib", "Zlib"), ("SPDX-License-Identifier: Nobody-1.0", None),
        ("Copyright (c) 2020 Jane Doe. All rights reserved.", "Proprietary"),
        (f"{prose} all rights and duties {prose}", None), (f"{prose} the public license of {prose}", None),
        (f"{prose}\n  GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n{prose}", "GPL-3.0"),
        (f"{prose}\n * {gpl3}\n{prose}", "GPL-3.0"), (f"{prose}\n * {lgpl}\n{prose}", "LGPL-3.0"),
        (prose * 40, None), (None, None), ("", None)]
    df = spark.createDataFrame([(i, f"{i}.txt", t) for i, (t, _) in enumerate(cases)],
                               "id long, path string, text string")
    got = {r.id: r.license for r in licenses.scan(df.union(df)).collect()}
    assert got == {i: name for i, (_, name) in enumerate(cases)}


@pytest.mark.parametrize("operator", [
    lambda d: substrings.remove_repeats(d), lambda d: jaccard_join.similarity_classes(d),
    lambda d: token_counts.count_tokens(d, TOKENIZER), lambda d: jaccard_join.one_of_each(d),
    lambda d: substrings.without_repeats(d), lambda d: mixing.mixture(d), lambda d: langid.accepted(d)])
def test_empty_tables(spark, odd, operator):
    assert operator(frame(spark, odd).filter("false")).count() == 0


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = [b"a b  c", b"", b"  ", b"a b c d e " * 30, b"xx" * 50, b"a b c"]
    words, starts = common.words_of(texts)
    assert np.diff(starts).tolist() == [len(t.split()) for t in texts]
    monkeypatch.setattr(common, "_BLOCK", 8)
    again = common.words_of(texts)
    assert (again[0] == words).all() and (again[1] == starts).all()


def test_components(spark):
    pick = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, pick.randrange(101, 140)) for _ in range(30)]
    got = {r.node: r.component for r in common.components(
        spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(c == 100 for n, c in got.items() if n >= 100)
