"""Benchmark decontamination by a distributed positional inverted index.

1. *Index.* A posting is a term, a document and a position. Postings are stored for the terms
   that searches start from; how often each term of the test items occurs in the collection
   is counted first, and each test phrase is searched from its rarest terms.
2. *Intersection.* The lists of a phrase's `RAREST` rarest terms, each shifted by the term's
   offset in the phrase, are intersected: a place that all of them name may begin the phrase
   (`phrase_matches`). With room to spare between the offsets it is a proximity match
   (`proximity_matches`).
3. *Check.* Candidate places are compared word by word with the phrase.

A phrase is a window of `WINDOW` consecutive words of a test item; an item of fewer words, but
not none, is one phrase. Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased. Postings are kept under these words, and counts and phrases use them alike: the
lower case of other letters can depend on their neighbours.

Texts are cut into words once, and written as such: cutting takes most of the time, and
counts, postings and checks all start from words.

Everything is DataFrame functions. What is made from the test items (terms, phrases) is
broadcast while it is small (`bounded`) and joined by key beyond that.

Edge cases: null texts have no words; so have items without any. A null item id sorts as an
empty string does and is left out of the digest's list. Items that repeat count once per id.
A null document id is kept. Documents that repeat are returned each, with equal findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import (bounded, marked, pick, place, real_id, row_key,
                                   split_by_key, unhide)
from tallyhouse.session import materialize

WINDOW = 10
RAREST = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words as they are indexed and compared."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def split_texts(docs: DataFrame) -> DataFrame:
    """``_d, _h, w`` of every row of ``docs (_d, _h, text)``, written; ``w`` is null with its text."""
    return materialize(docs.select("_d", "_h", words_of(F.col("text")).alias("w")), "words")


def _words_in(docs: DataFrame) -> Column:
    """The words of ``docs (.., text)``, or of what `split_texts` made of it."""
    return F.col("w") if "w" in docs.columns else words_of(F.col("text"))


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``phrase, item_id, words, terms``: the distinct windows of each item."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = (words.select("item_id", "w", F.explode(starts).alias("i"))
            .select("item_id", F.slice("w", F.col("i") + 1, F.lit(window)).alias("words")).distinct())
    return each.select(F.xxhash64("item_id", "words").alias("phrase"), "item_id", "words",
                       F.col("words").alias("terms"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: occurrences in ``docs (.., text)`` of each of ``terms (term)``."""
    found = (docs.select(F.explode(_words_in(docs)).alias("term"))
             .join(bounded(terms), "term").groupBy("term").agg(F.count("*").alias("k")))
    return terms.join(found, "term", "left").select("term", F.coalesce("k", F.lit(0)).alias("n"))


def search_terms(wanted: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``phrase, place, term, offset``: each phrase's rarest terms, rarest first.

    A phrase with a term that never occurs is searched no further.
    """
    each = wanted.select("phrase", F.posexplode("terms").alias("offset", "term"))
    once = each.groupBy("phrase", "term").agg(F.min("offset").alias("offset"))
    order = Window.partitionBy("phrase").orderBy("n", "term")
    ranked = (once.join(counts, "term").withColumn("place", F.row_number().over(order))
              .withColumn("least", F.min("n").over(Window.partitionBy("phrase"))))
    return ranked.filter((F.col("place") <= rarest) & (F.col("least") > 0)).select(
        "phrase", "place", "term", "offset")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, _d, _h, pos`` for every occurrence of ``terms (term)`` in ``docs (_d, _h, text)``."""
    return (docs.select("_d", "_h", F.posexplode(_words_in(docs)).alias("pos", "term"))
            .join(bounded(terms), "term").select("term", "_d", "_h", "pos"))


def phrase_matches(index: DataFrame, search: DataFrame) -> DataFrame:
    """``phrase, _d, _h, start``: where the shifted lists of all search terms of a phrase meet."""
    need = search.groupBy("phrase").agg(F.count("*").alias("need"))
    shifted = (index.join(bounded(search.join(need, "phrase")), "term")
               .select("phrase", "_d", "_h", "need", "place", (F.col("pos") - F.col("offset")).alias("start"))
               .filter("start >= 0"))
    met = shifted.groupBy("phrase", "_d", "_h", "start").agg(
        F.max("need").alias("need"), F.count_distinct("place").alias("have"))
    return met.filter("have = need").select("phrase", "_d", "_h", "start")


def proximity_matches(index: DataFrame, search: DataFrame, slack: int) -> DataFrame:
    """``phrase, _d, _h``: documents in which some occurrence of the rarest term has an
    occurrence of every other search term at most ``slack`` words from where the phrase
    would have it."""
    need = search.groupBy("phrase").agg(F.count("*").alias("need"))
    shifted = (index.join(bounded(search.join(need, "phrase")), "term")
               .select("phrase", "_d", "_h", "need", "place", (F.col("pos") - F.col("offset")).alias("start")))
    # Starts meet in cells of slack + 1 positions: a pair within slack is in one or in neighbours.
    cell = F.floor(F.col("start") / (slack + 1))
    first = shifted.filter("place = 1").select(
        "phrase", "_d", "_h", "need", F.col("start").alias("s"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    other = shifted.filter("place > 1").select("phrase", "_d", "_h", "place", "start", cell.alias("cell"))
    near = (first.join(other, ["phrase", "_d", "_h", "cell"])
            .filter(F.abs(F.col("start") - F.col("s")) <= slack)
            .groupBy("phrase", "_d", "_h", "s").agg(
                F.max("need").alias("need"), F.count_distinct("place").alias("have"))
            .filter("have = need - 1").select("phrase", "_d", "_h"))
    alone = shifted.filter("need = 1").select("phrase", "_d", "_h")
    return near.unionByName(alone).distinct()


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                rarest: int = RAREST) -> DataFrame:
    """``_d, _h, start, n, item_id``: every occurrence, in ``docs (_d, _h, w)``, of a phrase
    of ``items (item_id, text)``; ``n`` is its number of words."""
    wanted = materialize(phrases(items, window), "phrases")
    terms = materialize(wanted.select(F.explode("terms").alias("term")).distinct(), "terms")
    counts = materialize(term_counts(docs, terms), "term-counts")
    search = materialize(search_terms(wanted, counts, rarest), "search")
    probes = materialize(search.select("term").distinct(), "probes")
    index = materialize(postings(docs, probes), "postings")
    found = materialize(phrase_matches(index, search).dropDuplicates(), "matches")
    here, _ = split_by_key(docs, materialize(found.select("_d", "_h").distinct(), "matched"), ["_d", "_h"])
    texts = here.dropDuplicates(["_d", "_h"])
    checked = found.join(texts, ["_d", "_h"]).join(
        bounded(wanted.select("phrase", "item_id", "words")), "phrase")
    same = F.slice("w", F.col("start") + 1, F.size("words")) == F.col("words")
    return checked.filter(same).select("_d", "_h", "start", F.size("words").alias("n"), "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_d, _h, n_hit, n_items, ids`` for each text of ``docs (_d, _h, w)`` in which a
    phrase occurs: words inside occurrences, items, and their ids, sorted as strings."""
    found = materialize(occurrences(docs, items, window), "occurrences")
    # Words hit: a start covers up to the next start, or its whole phrase.
    starts = found.groupBy("_d", "_h", "start").agg(F.max("n").alias("n"))
    after = F.lead("start").over(Window.partitionBy("_d", "_h").orderBy("start"))
    reach = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("_d", "_h").orderBy("start"))
    hit = (starts.withColumn("end", F.least(reach, F.coalesce(after, reach)))
           .groupBy("_d", "_h").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit")))
    ids = found.groupBy("_d", "_h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string")))
                                        .alias("ids"), F.count_distinct("item_id").alias("n_items"))
    return hit.join(ids, ["_d", "_h"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of
    ``docs (doc_id, text)``, searched for the phrases of ``items (item_id, text)``."""
    keyed = pick(docs, "doc_id", "text").select(*row_key(F.col("doc_id"), F.col("text")), "text")
    texts = split_texts(keyed)
    found = contamination(texts, pick(items, "item_id", "text"), window)
    none = F.lit(0).cast("long")
    count = F.when(F.col("w").isNotNull(), F.size("w").cast("long")).otherwise(none)
    return texts.select("_d", "_h", count.alias("n_words")).join(
        found, ["_d", "_h"], "left").select(
            real_id(F.col("_d")).alias("doc_id"), "n_words", F.coalesce("n_hit", none).alias("n_hit"),
            F.coalesce("n_items", none).alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", none) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs (doc_id, text, ..)`` in which no phrase of ``items`` occurs."""
    keyed = marked(docs).select("_d", "_h", F.col(place(docs, "text")).alias("text"))
    found = materialize(contamination(split_texts(keyed), pick(items, "item_id", "text"), window)
                        .select("_d", "_h"), "contaminated")
    return unhide(split_by_key(marked(docs), found, ["_d", "_h"])[1], docs)
