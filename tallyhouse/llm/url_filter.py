"""URL filters: rules first, then host word segmentation and naive Bayes.

*Parts.* The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; the path is what then follows up to ``?``, ``#`` or the end.

*Rules.* A rule ``host/path`` fits its host and all subdomains where the path begins with the
rule's. Of the rules that fit, the longest gives the verdict.

*Segmentation.* Runs of letters in hosts are split into words by the most probable path
(Viterbi) under a unigram model of all words of the pages; a string that is no such word
costs ten times more for each letter. Substrings of distinct runs are joined to the word
counts, so the dictionary is never held in one place.

*Classifier.* Multinomial naive Bayes over host words and path tokens (numbers count as one
token), learned from all pages that a rule decides. A page that no rule decides gets the
likelier verdict; a tie is ``allow``. Every distinct (host, path) is scored once. Words that are
known to speak for ``block`` can be given as ``seeds``; there are none by default. `accuracy`
tells how often the classifier agrees with the rules on pages it did not learn from.

Edge cases: a null url, or one without ``://``, has an empty host and path; it has no token
and gets the verdict of the priors. Without any rule's page nothing but seeds is learned from.
Rows that repeat are returned each. A null page id is kept; a null html has no words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import bounded, map_batches, pick
from tallyhouse.session import materialize

#: A word is at most so long.
LONGEST = 24
#: How many times each seed word is counted.
SEED_COUNT = 50
#: Of the rules' urls, one in so many is kept from learning when accuracy is measured.
FOLDS = 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower()),
                      F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null; of equally long ones the first by code point."""
    fitting = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        fitting.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("string")


def word_counts(pages: DataFrame) -> DataFrame:
    """``word, n``: words (runs of letters, lower-cased) of the pages' visible text."""
    text = F.regexp_replace(F.lower("html"), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    return (pages.select(F.explode(words).alias("word")).filter(F.length("word") <= LONGEST)
            .groupBy("word").agg(F.count("*").alias("n")))


def _best_paths(total: int):
    def split(run: str, known: dict[tuple[int, int], int]) -> list[str]:
        best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - LONGEST), end):
                n = known.get((start, end - start))
                cost = (math.log(total / n) if n else
                        math.log(total + 1) + (end - start - 1) * math.log(10))
                if best[start] + cost < best[end]:
                    best[end], back[end] = best[start] + cost, start
        words, end = [], len(run)
        while end:
            words.append(run[back[end]:end])
            end = back[end]
        return words[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("run").to_pylist()
            words = [split(r, {(k["at"], k["size"]): k["n"] for k in known}) for r, known in
                     zip(runs, batch.column("known").to_pylist())]
            yield pa.RecordBatch.from_pydict({"run": pa.array(runs, pa.string()),
                                              "words": pa.array(words, pa.list_(pa.string()))})

    return run


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``run, words`` for each distinct ``run`` of letters; ``counts (word, n)`` is written."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    at = F.explode(F.sequence(F.lit(0), F.length("run") - 1))
    cut = (runs.select("run", at.alias("at"))
           .select("run", "at", F.explode(F.sequence(F.lit(1), F.least(
               F.lit(LONGEST), F.length("run") - F.col("at")))).alias("size"))
           .select("*", F.col("run").substr(F.col("at") + 1, F.col("size")).alias("word")))
    known = (cut.join(counts, "word").groupBy("run")
             .agg(F.collect_list(F.struct("at", "size", "n")).alias("known")))
    known = runs.join(known, "run", "left").select("run", F.coalesce(
        "known", F.array().cast("array<struct<at:int,size:int,n:bigint>>")).alias("known"))
    return map_batches(known, _best_paths(total), "run string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``host, words``: the words of each distinct ``host``."""
    runs = F.regexp_extract_all("host", F.lit(r"\p{L}+"), F.lit(0))
    each = hosts.select("host", F.posexplode(runs).alias("i", "run"))
    parts = segment(each.select("run").distinct(), counts)
    return (each.join(parts, "run").groupBy("host")
            .agg(F.array_sort(F.collect_list(F.struct("i", "words"))).alias("x"))
            .select("host", F.flatten(F.transform("x", lambda x: x["words"])).alias("words")))


def url_tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``urls (host, path, ..)`` with ``tokens``."""
    parts = F.regexp_extract_all(F.lower("path"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    own = F.transform(parts, lambda t: F.concat(
        F.lit("p:"), F.when(t.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(t)))
    of_host = F.transform(F.coalesce("words", F.array().cast("array<string>")),
                          lambda w: F.concat(F.lit("h:"), w))
    return (urls.join(bounded(words), "host", "left")
            .select(*urls.columns, F.concat(of_host, own).alias("tokens")))


def learn(labelled: DataFrame, seeds: DataFrame) -> tuple[DataFrame, float]:
    """``token, weight`` and the prior, both as log odds of ``block``, from
    ``labelled (tokens, block, n)`` and ``seeds (token, n)``."""
    blocked = F.sum(F.when(F.col("block"), F.col("n")).otherwise(0))
    allowed = F.sum(F.when(~F.col("block"), F.col("n")).otherwise(0))
    counts = (labelled.select(F.explode("tokens").alias("token"), "block", "n")
              .unionByName(seeds.withColumn("block", F.lit(True)))
              .groupBy("token").agg(blocked.alias("b"), allowed.alias("a")))
    counts = materialize(counts, "token-counts")
    pages = labelled.agg(blocked.alias("b"), allowed.alias("a")).first()
    sums = counts.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    b, a, v = (sums["b"] or 0), (sums["a"] or 0), sums["v"]
    weight = F.log((F.col("b") + 1) / (b + v + 1)) - F.log((F.col("a") + 1) / (a + v + 1))
    prior = math.log(((pages["b"] or 0) + 1) / ((pages["a"] or 0) + 1))
    return materialize(counts.select("token", weight.alias("weight")), "weights"), prior


def labelled_urls(pages: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``host, path, n, rule, block, tokens`` of each distinct host and path, written, and
    the ``page_id, host, path`` of each page. ``block`` is null where no rule fits."""
    pages = pick(pages, "page_id", "url", "html")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"),
                         path_of(F.col("url")).alias("path"))
    urls = materialize(parts.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    counts = materialize(word_counts(pages), "words")
    words = materialize(host_words(urls.select("host").distinct(), counts), "host-words")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    blocking = [r for r, verdict in rules.items() if verdict == "block"]
    block = F.when(F.col("rule").isNotNull(), F.col("rule").isin(blocking))
    return materialize(url_tokens(urls.withColumn("rule", rule).withColumn("block", block), words),
                       "url-tokens"), parts


def block_odds(urls: DataFrame, weights: DataFrame, prior: float) -> DataFrame:
    """``urls`` with the classifier's log odds of ``block``."""
    scored = (urls.select("host", "path", F.explode("tokens").alias("token"))
              .join(bounded(weights), "token").groupBy("host", "path").agg(F.sum("weight").alias("w")))
    return urls.join(scored, ["host", "path"], "left").withColumn(
        "odds", F.lit(prior) + F.coalesce("w", F.lit(0.0))).drop("w")


def _seeds(pages: DataFrame, seeds: tuple[str, ...], seed_count: int) -> DataFrame:
    return pages.sparkSession.createDataFrame([(f"h:{w}", seed_count) for w in seeds], "token string, n long")


def accuracy(pages: DataFrame, rules: dict[str, str], folds: int = FOLDS) -> tuple[int, int]:
    """On the urls that rules decide and that are kept from learning (one in ``folds`` by hash):
    how many the classifier judges like the rules, and how many there are."""
    urls, _ = labelled_urls(pages, rules)
    decided = urls.filter("block IS NOT NULL")
    kept = F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == 0
    weights, prior = learn(decided.filter(~kept), _seeds(pages, (), 0))
    row = block_odds(decided.filter(kept), weights, prior).agg(
        F.count_if((F.col("odds") > 0) == F.col("block")), F.count("*")).first()
    return row[0], row[1]


def judge(pages: DataFrame, rules: dict[str, str], seeds: tuple[str, ...] = (),
          seed_count: int = SEED_COUNT) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_odds`` of every row of
    ``pages (page_id, url, html)``; ``rules`` maps ``host/path`` to ``allow`` or ``block``.
    ``block_odds`` is the classifier's log odds, whatever the rules say."""
    urls, parts = labelled_urls(pages, rules)
    weights, prior = learn(urls.filter("block IS NOT NULL"), _seeds(pages, seeds, seed_count))
    found = block_odds(urls, weights, prior)
    verdict = F.when(F.coalesce("block", F.col("odds") > 0), "block").otherwise("allow")
    judged = materialize(found.select("host", "path", "rule", verdict.alias("verdict"),
                                      F.col("odds").alias("block_odds")), "judged")
    return parts.join(bounded(judged), ["host", "path"]).select(
        "page_id", "host", "path", "rule", "verdict", "block_odds")
