"""Plain-text requests, answered in batch over ``messages(msg_id, text)``."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, display, ranks, text
from ..session import materialize, settled
from .joins import attach, attach_counted
from .modeling import FEATURES, score

# Vocabularies up to this size are searched by a CASE expression, then by an automaton up to
# this many terms and bytes in them (one node a byte at most). Of larger ones, terms of `LONG`
# characters or more are searched by joins, the others by an automaton, or by joins if they are too many.
CASE_TERMS = 100
# A CASE of this many terms or more is screened by one regular expression.
SCREENED_TERMS = 16
BROADCAST_TERMS = 200_000
AUTOMATON_BYTES = 2 << 20
BUNDLE_BYTES = 256 << 10
ANCHOR, LONG = 4, 8
# Anchors are broadcast, as hashes, up to this many at once; more of them take more passes over the texts.
BROADCAST_ANCHORS = 4_000_000

# Ordered keyword rules of each rule set, first hit wins. ``predict``
# closes the notebook rules; the dashboard rules look for known terms in between.
HELP = ("help", "how do i", "examples", "what can you do")
METRICS = ("metric", "metrics", "score", "r2", "mae", "rmse", "best model", "model comparison")
TOP_PRODUCTS = ("top product", "top products", "best product")
TOP_REGIONS = ("top region", "best region", "regions")
SEASONALITY = ("season", "monthly", "trend", "sales over time")
PREDICT_VERBS = ("predict", "forecast", "estimate")
NOTEBOOK_RULES = (("help", HELP), ("metrics", METRICS), ("top_products", TOP_PRODUCTS),
                  ("top_regions", TOP_REGIONS), ("seasonality", SEASONALITY))
DASHBOARD_FIRST = (("help", ("help", "what can you do", "examples")),
                   ("overview", ("summary", "overview", "dataset", "data")),
                   ("metrics", ("metric", "metrics", "best model", "r2", "rmse", "mae")))
DASHBOARD_LAST = (("top_products", TOP_PRODUCTS), ("top_regions", TOP_REGIONS),
                  ("seasonality", SEASONALITY),
                  ("predict", (*PREDICT_VERBS, "sales", "revenue", "quantity", "price", "region",
                               "category", "product", "date")))
KNOWN = ("product", "category", "region")

# Labels that a number may follow, in the order they are tried.
NUMBER_LABELS = {
    "quantity": ("quantity", "qty", "units", "items"),
    "price": ("price", "unit price", "selling price", "sale price"),
    "customer_purchase_count": ("customer_purchase_count", "customer purchase count",
                                "purchase count"),
    "hour": ("hour",),
}
HISTORY_LABEL = "history count"
WHOLE_NUMBERS = ("customer_purchase_count", "hour")
DATE_PATTERN = r"\b(20\d{2}-\d{2}-\d{2})\b"
#: Lines of a top list.
TOP_LINES = {"dashboard": 10, "notebook": 5}
DEFAULTS_NOTE = "Used dataset defaults for any missing inputs."
NO_DATE_NOTE = ("No parseable YYYY-MM-DD date was found, so default time features were used.")

# Texts that need no table.
STATIC_ANSWERS = {
    "empty": "Type a question or a prediction request.",
    "help": "Name a quantity, price, category, region, product or date and I estimate the "
            "sales. For example: 'Predict sales for quantity 3 price 120 category Electronics "
            "region North', 'Top products', 'Show model metrics', 'Monthly trend'.",
    "metrics": "Model metrics are not available yet.",
    "fallback": "Try asking about model metrics, top products, top regions, seasonality, "
                "dataset overview, or a sales prediction.",
    "needs_input": "I can make a prediction, but I need at least one input such as quantity, "
                   "price, product, category, region, or date.\n"
                   "Example: Predict sales for quantity 3 price 120 category Electronics region "
                   "West date 2025-04-01",
}
# What is said of lists without entries, and of predictions without a model.
NOTHING = {
    "top_products": "Top products are not available yet.",
    "top_regions": "Top regions are not available yet.",
    "seasonality": "Seasonality data is not available yet.",
    "predict": "The data is ready, but the model is not trained yet. Run the training step first, "
               "then ask for a prediction with quantity, price, product, category, region, or date.",
}


def _rules(message: Column, rules) -> list[Column]:
    return [F.when(text.contains_any(message, words), F.lit(intent)) for intent, words in rules]


def route(messages: DataFrame, ruleset: str = "default") -> DataFrame:
    """Add ``intent``.

    ``notebook`` and ``dashboard`` keep their own orders; the latter needs the columns
    of ``match_known``. ``default`` is the notebook order with prediction verbs first,
    so that a request to predict is not taken for a question about its own terms.
    """
    named = messages.withColumn("_message", F.lower(text.strip(F.col("text"))))
    message = F.col("_message")
    empty = F.when((message == "") | message.isNull(), F.lit("empty"))
    if ruleset == "dashboard":
        known = [F.when(F.col(c).isNotNull(), F.lit(f"segment_{c}")) for c in KNOWN]
        choices = [empty, *_rules(message, DASHBOARD_FIRST), *known,
                   *_rules(message, DASHBOARD_LAST), F.lit("fallback")]
    else:
        verbs = (("predict", PREDICT_VERBS),) if ruleset == "default" else ()
        choices = [empty, *_rules(message, (*verbs, *NOTEBOOK_RULES)), F.lit("predict")]
    return named.withColumn("intent", F.coalesce(*choices)).drop("_message")


def _any_of(words: Sequence[str]) -> str:
    """A regular expression for any of the words, which reads their common beginnings once."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        if "" in node:  # a word ends here, whatever longer ones go on
            return ""
        parts = [re.escape(letter) + pattern(rest) for letter, rest in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    firsts = "".join(re.escape(letter) for letter in sorted(root))
    return f"(?=[{firsts}]){pattern(root)}"


def _match_by_case(messages: DataFrame, terms: Sequence[str], out_col: str) -> DataFrame:
    """Longest first, so the first branch that holds is the answer; no shuffle. One regular
    expression tells the texts without any of many terms, which are not searched term by term."""
    if not terms:
        return messages.withColumn(out_col, F.lit(None).cast("string"))
    ordered = sorted(terms, key=lambda term: (-len(term), term))
    lowered = messages.withColumn("_message", F.lower("text"))
    message = F.col("_message")
    found = F.coalesce(*[F.when(message.contains(F.lower(F.lit(term))), F.lit(term)) for term in ordered])
    if len(terms) >= SCREENED_TERMS and all(term.isascii() for term in terms):  # alike lower in Python
        found = F.when(message.rlike(_any_of([term.lower() for term in terms])), found)
    return lowered.withColumn(out_col, found).drop("_message")


def _matching(df: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` with a partner in ``per_key``; hot keys are spread."""
    payload = next(c for c in per_key.columns if c != key)
    return attach(df, per_key, key).where(F.col(payload).isNotNull())


def _text_id() -> Column:
    """Names a text, case aside. Searches go by text, so equal messages are searched once
    and message ids may repeat or be missing."""
    return F.md5(F.lower("text"))


def _distinct_texts(messages: DataFrame) -> DataFrame:
    return messages.select(F.lower("text").alias("t")).where("t <> ''").distinct()


def _named(texts: DataFrame) -> DataFrame:
    return texts.select(F.md5("t").alias("_text"), "t")


def _texts(messages: DataFrame) -> DataFrame:
    """``(_text, t)``: the distinct lower-cased texts."""
    return _named(_distinct_texts(messages))


def _written_texts(messages: DataFrame) -> DataFrame:
    """The same, written without the names, which readers make again."""
    return _named(materialize(_distinct_texts(messages), "texts"))


def _distinct_terms(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.lower("term").alias("key"), "term").where("key <> ''").groupBy(
        "key").agg(F.min("term").alias("term"))


def term_automaton(terms: DataFrame, label: str = "automaton", roles: int = 1) -> DataFrame:
    """An Aho-Corasick automaton over ``terms (key, term)`` as one row: ``book``, and a join key.
    Terms of several roles have the number of theirs in a column ``role``, from 0.

    ``names`` are the terms of each role, shortest first; equally long ones from the last to the first.
    ``nodes`` are the distinct beginnings of keys, the empty one first; of each, the characters that lead
    on from it (``codes``), the nodes these lead to (``to``), and the best term of each role that ends
    there (``best0`` and so on: a place in its names, from 1; 0 for none). A step that a node does not
    list is the first node's.

    Goto and failure links come from joins of beginnings with the ends of beginnings: the nodes
    that a node can fall back to are its ends that are beginnings themselves, and a character leads
    to the longest of their children. Built over tables of a checked size.
    """
    terms = terms if "role" in terms.columns else terms.withColumn("role", F.lit(0))
    ranked = materialize(terms.withColumn("rank", F.row_number().over(
        Window.partitionBy("role").orderBy(F.length("term"), F.desc("term")))), label)

    def of_role(i: int, value: Column) -> Column:
        return F.when(F.col("role") == i, value)

    starts = ranked.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.length("key")), lambda n: F.left("key", n))).alias("s")).distinct()
    nodes = materialize(starts.agg(F.array_sort(F.collect_list("s")).alias("all")).select(
        F.posexplode("all").alias("id", "s")), label)
    ends = nodes.select("id", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("s") + 1), lambda at: F.substring("s", at, F.length("s")))).alias("end"))
    falls = ends.join(nodes.select(F.col("id").alias("to"), F.col("s").alias("end")), "end")
    children = nodes.where("s <> ''").select(
        F.expr("left(s, length(s) - 1)").alias("end"), F.right("s", F.lit(1)).alias("code"),
        F.col("id").alias("child"), F.length("s").alias("depth"))
    steps = (falls.join(children, "end").groupBy("id", "code")
             .agg(F.max_by("child", "depth").alias("child"), F.max("depth").alias("depth"))
             .where("id = 0 OR depth > 1"))
    listed = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("code", "child"))).alias("on"))
    best = (falls.join(ranked.select(F.col("key").alias("end"), "role", "rank"), "end")
            .groupBy("id").agg(*[F.max(of_role(i, F.col("rank"))).alias(f"best{i}") for i in range(roles)]))
    rows = nodes.select("id").join(listed, "id", "left").join(best, "id", "left").select(F.struct(
        "id", F.coalesce(F.array_join(F.col("on.code"), ""), F.lit("")).alias("codes"),
        F.coalesce(F.col("on.child"), F.array().cast("array<int>")).alias("to"),
        *[F.coalesce(f"best{i}", F.lit(0)).alias(f"best{i}") for i in range(roles)]).alias("node"))
    table = rows.agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    names = ranked.agg(F.array(*[
        F.array_sort(F.collect_list(of_role(i, F.struct("rank", "term"))))["term"] for i in range(roles)]).alias("names"))
    return materialize(table.select("nodes", names.scalar().alias("names")).select(
        F.struct("nodes", "names").alias("book"), F.lit(0).cast("long").alias("one")), label)


def _fold(book: Column, lowered: Column, out_cols: Sequence[str]) -> Column:
    """The best term of each role in a text: one step of the automaton a character."""
    nodes = book["nodes"]

    def best(state: Column, node: Column) -> list[Column]:
        return [F.greatest(state[f"best{i}"], node[f"best{i}"]) for i in range(len(out_cols))]

    def step(state: Column, code: Column) -> Column:
        node, first = F.get(nodes, state["at"]), F.get(nodes, F.lit(0))
        here, there = F.instr(node["codes"], code), F.instr(first["codes"], code)
        at = (F.when(here > 0, F.get(node["to"], here - 1))
              .when(there > 0, F.get(first["to"], there - 1)).otherwise(0))
        return F.struct(at.alias("at"), *[b.alias(f"best{i}") for i, b in enumerate(best(state, node))])

    def names(state: Column) -> Column:
        last = best(state, F.get(nodes, state["at"]))
        return F.struct(*[F.get(F.get(book["names"], F.lit(i)), last[i] - 1).alias(c) for i, c in enumerate(out_cols)])

    start = F.struct(F.lit(0).alias("at"), *[F.lit(0).alias(f"best{i}") for i in range(len(out_cols))])
    return F.aggregate(F.split(lowered, ""), start, step, names)


def _fold_all(texts: DataFrame, book: DataFrame, *out_cols: str) -> DataFrame:
    """``(_text, *out_cols)`` of the texts with a term of some role. The automaton is one broadcast row; texts meet
    it in bundles of about `BUNDLE_BYTES`, so that it is copied once a bundle and not once a text."""
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bundles = texts.groupBy(F.pmod(F.xxhash64("t"), F.lit(size // BUNDLE_BYTES + 1)).alias("bundle")).agg(
        F.collect_list("t").alias("ts")).withColumn("one", F.pmod("bundle", F.lit(1)))
    found = F.transform("ts", lambda t: F.struct(t.alias("t"), _fold(F.col("book"), t, out_cols).alias("b")))
    met = bundles.join(F.broadcast(book), "one")
    return (met.select(F.explode(found).alias("f")).select(F.md5("f.t").alias("_text"), "f.b.*")
            .where(F.coalesce(*out_cols).isNotNull()))


def _terms_of_roles(texts: DataFrame, vocabularies: Mapping[str, DataFrame]) -> list[DataFrame]:
    """``(_text, role)`` tables of the texts with a term; one table for all roles if one automaton may
    hold their terms, so that texts are folded over once."""
    roles = list(vocabularies)
    terms = materialize(reduce(DataFrame.unionByName, [
        _distinct_terms(vocabularies[role]).withColumn("role", F.lit(i)) for i, role in enumerate(roles)]), "terms")
    small = _is_small(terms)
    if small:
        return [_fold_all(texts, term_automaton(terms, roles=len(roles)), *roles)]
    found = [] if small is None else [
        _longest_terms(texts, terms.where(F.col("role") == i), role) for i, role in enumerate(roles)]
    return [best for best in found if best is not None]


def _longest_terms(texts: DataFrame, vocab: DataFrame, out_col: str) -> DataFrame | None:
    """``(_text, out_col)`` for the texts that contain a term; None if there are no terms.

    Up to `BROADCAST_TERMS` terms, and `AUTOMATON_BYTES` in them, are one automaton that texts are
    folded over, character by character, whatever the terms' length. Of more terms the long ones
    are searched by joins, and the others apart: the short ones, most places of a text may begin,
    so they would travel for every place.
    """
    terms = materialize(_distinct_terms(vocab), "terms")
    found = [_search(texts, part, out_col, anchor) for part, anchor in _term_classes(terms)]
    if not found:
        return None
    every = reduce(DataFrame.unionByName, found)
    return every if len(found) == 1 else every.groupBy("_text").agg(
        F.min(F.struct((-F.length(out_col)).alias("l"), out_col))[out_col].alias(out_col))


def _is_small(terms: DataFrame) -> bool | None:
    """Whether an automaton may hold the terms; None if there are none."""
    rows, size = terms.agg(F.count(F.lit(1)), F.sum(F.octet_length("key") + F.octet_length("term"))).first()
    return rows <= BROADCAST_TERMS and size <= AUTOMATON_BYTES if rows else None


def _term_classes(terms: DataFrame) -> list[tuple[DataFrame, int]]:
    """Terms that are searched together, and how many first characters are their anchor; 0 for an
    automaton."""
    if (small := _is_small(terms)) is None:
        return []
    if small:
        return [(terms, 0)]
    long = F.length("key") >= LONG
    classes = [(terms.where(~long), ANCHOR), (terms.where(long), LONG)]
    sizes = [_is_small(part) for part, _ in classes]
    return [(part, 0 if small else anchor) for (part, anchor), small in zip(classes, sizes) if small is not None]


def _search(texts: DataFrame, terms: DataFrame, out_col: str, anchor: int) -> DataFrame:
    return _terms_by_anchor(texts, terms, out_col, anchor) if anchor else _fold_all(
        texts, term_automaton(terms), out_col)


def _terms_by_anchor(texts: DataFrame, terms: DataFrame, out_col: str, anchor: int = ANCHOR) -> DataFrame:
    """The same by equi-joins: no text meets a term that does not occur in it. Every text position
    gives its next few characters (the anchor). Positions whose anchor starts some term
    give one substring per length such terms have, and those are looked up among the
    terms. The work is linear in the text, whatever the number of terms.

    Positions meet the anchors where they are, by hash, so only those that may start a term travel;
    anchors too many for one broadcast come in parts, one pass over the texts each.
    """
    width, widths = terms.agg(F.max(F.length("key")),
                              F.collect_set(F.least(F.length("key"), F.lit(anchor)))).first()
    anchors = materialize(terms.groupBy(F.left("key", F.lit(anchor)).alias("anchor")).agg(
        F.collect_set(F.length("key")).alias("sizes")), "anchors")
    known = anchors.select(F.xxhash64("anchor").alias("_a")).distinct()
    passes = -(-anchors.count() // BROADCAST_ANCHORS)

    positions = texts.select("_text", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("at"))
    # A term shorter than the anchor is its own anchor; only lengths in use are tried.
    starts = positions.select("_text", "t", "at", F.explode(F.array(*[F.lit(n) for n in sorted(widths)])).alias("n"))
    starts = starts.where("at + n <= length(t) + 1").withColumn("anchor", F.substring("t", F.col("at"), F.col("n")))
    # Hashes of a part have a remainder of their own, so no position is met twice.
    parts = [known.where(F.pmod("_a", F.lit(passes)) == i) for i in range(passes)]
    met = reduce(DataFrame.unionByName, [
        materialize(starts.withColumn("_a", F.xxhash64("anchor")).join(F.broadcast(part), "_a", "left_semi").select(
            "_text", F.substring("t", F.col("at"), F.lit(width)).alias("rest"), "n"), "starts") for part in parts])
    met = met.select("_text", "rest", F.left("rest", F.col("n")).alias("anchor"))
    found = _matching(met, anchors, "anchor").select(
        "_text", "rest", F.explode("sizes").alias("size")
    ).where(F.length("rest") >= F.col("size")).select(
        "_text", F.expr("left(rest, size)").alias("key")).distinct()
    return _matching(found, terms, "key").groupBy("_text").agg(
        F.min(F.struct((-F.length("term")).alias("l"), "term"))["term"].alias(out_col))


def _match_by_join(messages: DataFrame, vocab: DataFrame, out_col: str) -> DataFrame:
    best = _longest_terms(_written_texts(messages), vocab, out_col)
    if best is None:
        return messages.withColumn(out_col, F.lit(None).cast("string"))
    return attach(messages.withColumn("_text", _text_id()), best, "_text").drop("_text")


def _few_terms(vocab: DataFrame, case_terms: int) -> list[str] | None:
    """The terms, if there are at most ``case_terms``."""
    first = vocab.where("term <> ''").limit(case_terms + 1).collect()
    return [r["term"] for r in first] if len(first) <= case_terms else None


def match_terms(
    messages: DataFrame, vocab: DataFrame, out_col: str, case_terms: int = CASE_TERMS
) -> DataFrame:
    """Longest term contained in the text, case aside (ties: the smallest).

    Each message is judged by its own text: ids may repeat or be missing.
    """
    few = _few_terms(vocab, case_terms)
    if few is not None:
        return _match_by_case(messages, few, out_col)
    return _match_by_join(messages, vocab, out_col)


def match_known(
    messages: DataFrame, vocabularies: Mapping[str, DataFrame], case_terms: int = CASE_TERMS
) -> DataFrame:
    """T3 for products, categories and regions; a role without a vocabulary is NULL.

    Roles with large vocabularies are searched in one written table of distinct texts, by one
    automaton if it may hold the terms of them all, and attached to the messages by text at once. The result is written: routing, scenarios and
    answers all start from it, and a filter on what was found must not be pushed down into
    the searches. What the searches wrote goes at once.
    """
    return settled(messages.sparkSession, lambda: _known_in(messages, vocabularies, case_terms), "matched")


def _known_in(messages: DataFrame, vocabularies: Mapping[str, DataFrame], case_terms: int) -> DataFrame:
    columns = messages.columns
    few = {role: _few_terms(vocabularies[role], case_terms) for role in KNOWN if role in vocabularies}
    for role, terms in few.items():
        if terms is not None:
            messages = _match_by_case(messages, terms, role)
    large = [role for role, terms in few.items() if terms is None]
    if large:
        found = _terms_of_roles(_written_texts(messages), {role: vocabularies[role] for role in large})
        if found:
            known = reduce(lambda a, b: a.join(b, "_text", "full"), found)
            messages = attach(messages.withColumn("_text", _text_id()), known, "_text")
    missing = {role: F.lit(None).cast("string") for role in KNOWN if role not in messages.columns}
    return messages.withColumns(missing).select(*columns, *KNOWN)


def extract_numbers(messages: DataFrame, profile: str = "dashboard") -> DataFrame:
    """T4: ``<field>_given`` for every field a number is named for."""
    def labels(name: str) -> tuple[str, ...]:
        extra = (HISTORY_LABEL,) if (profile, name) == ("notebook", WHOLE_NUMBERS[0]) else ()
        return NUMBER_LABELS[name] + extra
    return messages.withColumns({
        f"{name}_given": text.number_after(F.col("text"), labels(name), name in WHOLE_NUMBERS)
        for name in NUMBER_LABELS})


def extract_date(messages: DataFrame) -> DataFrame:
    """T5: ``date_given`` (first 20YY-MM-DD that is a date) and what to note about it."""
    found = F.regexp_extract("text", DATE_PATTERN, 1)
    dated = messages.withColumn("_found", found).withColumn(
        "date_given", F.try_to_timestamp(F.nullif("_found", F.lit("")), F.lit("yyyy-MM-dd")))
    asked = (F.col("_found") == "") & F.lower("text").contains("date")
    note = F.when(F.col("date_given").isNotNull(), F.concat(
        F.lit("Used date "), F.date_format("date_given", "yyyy-MM-dd"),
        F.lit(" to derive time features."))).when(asked, F.lit(NO_DATE_NOTE))
    return dated.withColumn("date_note", note).drop("_found")


def feature_defaults(frame: DataFrame, profile: str = "dashboard") -> dict[str, float | str]:
    """What a scenario is filled with, from one frame: medians and modes.

    The dashboard takes the medians of the calendar parts and hour 0; the notebook
    takes the parts of the median date.
    """
    labels = [c for c in ("category", "region") if c in frame.columns]
    numeric = ["quantity", "price", "customer_purchase_count"]
    common = ranks.modes(frame, labels)
    result: dict[str, float | str] = {c: common[c] or "Unknown" for c in labels}
    if profile == "notebook":
        micros = frame.withColumn("_micros", F.unix_micros("date"))
        medians = ranks.exact_medians(micros, [*numeric, "_micros"])
        middle = F.timestamp_micros(F.lit(int(medians["_micros"])))
        parts = frame.sparkSession.range(1).select(
            F.month(middle).alias("month"), F.weekday(middle).alias("day_of_week"),
            F.hour(middle).alias("hour"), dates.is_weekend(middle).alias("is_weekend")).first()
        result |= parts.asDict()
        result["customer_purchase_count"] = float(int(medians["customer_purchase_count"]))
    else:
        medians = ranks.exact_medians(frame, [*numeric, "month", "day_of_week"])
        result |= {"month": int(medians["month"]), "day_of_week": int(medians["day_of_week"]),
                   "hour": 0, "is_weekend": int(medians["day_of_week"] >= 5)}
        result["customer_purchase_count"] = medians["customer_purchase_count"]
    return result | {c: medians[c] for c in ("quantity", "price")}


def build_scenarios(
    messages: DataFrame, dimension: DataFrame | None, defaults: Mapping[str, float | str],
    profile: str = "dashboard",
) -> DataFrame:
    """One feature row per message: what the text says, else what its product usually
    has, else the default. Adds ``signal_count`` and ``notes``.

    ``messages`` has the columns of ``match_known``. Messages without a product, and
    those about a hot one, are spread over tasks in the join with ``dimension``, which is None
    for a table without products.
    """
    read = extract_date(extract_numbers(messages, profile))
    known = {"category": "string", "price": "double", "quantity": "double"}
    if dimension is None:
        joined = read.withColumns({f"{c}_usual": F.lit(None).cast(kind) for c, kind in known.items()})
    else:
        usual = dimension.select("product", *[
            (F.col(c) if c in dimension.columns else F.lit(None).cast(kind)).alias(f"{c}_usual")
            for c, kind in known.items()])
        joined = attach_counted(read, usual, "product")
    given = {c: F.col(f"{c}_given") for c in NUMBER_LABELS}
    date = F.col("date_given")

    def pick(name: str, *options: Column) -> Column:
        default = defaults[name]
        kind = "string" if isinstance(default, str) else "double"
        return F.coalesce(*[o.cast(kind) for o in options], F.lit(default).cast(kind)).alias(name)

    signals = [F.col(c) for c in ("product", "price_usual", "quantity_usual", "category", "region")]
    signals += [*given.values(), date]
    notes = F.array_compact(F.array(
        F.when(F.col("product").isNotNull(),
               F.concat(F.lit("Detected product '"), "product", F.lit("'."))),
        F.col("date_note")))
    return joined.select(
        "msg_id", "text", "product",
        pick("quantity", given["quantity"], F.col("quantity_usual")),
        pick("price", given["price"], F.col("price_usual")),
        pick("category", F.col("category"), F.col("category_usual")),
        pick("region", F.col("region")),
        pick("month", F.month(date)).cast("int").alias("month"),
        pick("day_of_week", F.weekday(date)).cast("int").alias("day_of_week"),
        # A date without a time sets the hour to 0, even where the text names an hour.
        pick("hour", F.hour(date), given["hour"]).cast("int").alias("hour"),
        pick("is_weekend", F.when(date.isNotNull(), dates.is_weekend(date)))
        .cast("int").alias("is_weekend"),
        pick("customer_purchase_count", given["customer_purchase_count"]),
        reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in signals])
        .alias("signal_count"),
        F.array_join(notes, "\n").alias("notes"))


def score_scenarios(
    scenarios: DataFrame, model: PipelineModel, require_signal: bool = True
) -> DataFrame:
    """Predictions for the scenarios; those the text says nothing about are refused."""
    asked = scenarios.where("signal_count > 0") if require_signal else scenarios
    return score(model, asked)


def prediction_answers(scored: DataFrame, model: str) -> DataFrame:
    """(msg_id, intent, answer): the prediction, the model, the inputs and the notes."""
    inputs = [F.concat(F.lit(f"{c}: "), display.format_value(F.col(c), scored.schema[c].dataType))
              for c in FEATURES if c in scored.columns]
    notes = F.when(F.col("notes") == "", F.lit(DEFAULTS_NOTE)).otherwise(F.col("notes"))
    answer = F.concat_ws(
        "\n\n", F.concat(F.lit("Predicted sales: "), display.format_currency(F.col("prediction"))),
        F.lit(f"Model: {model}"), F.concat(F.lit("Inputs used:\n"), F.concat_ws("\n", *inputs)),
        F.concat(F.lit("Notes:\n- "), F.replace(notes, F.lit("\n"), F.lit("\n- "))))
    return scored.select("msg_id", F.lit("predict").alias("intent"), answer.alias("answer"))


def refusals(scenarios: DataFrame) -> DataFrame:
    """What is told to those whose request names no input."""
    return scenarios.where("signal_count = 0").select(
        "msg_id", F.lit("needs_input").alias("intent"),
        F.lit(STATIC_ANSWERS["needs_input"]).alias("answer"))


def untrained(routed: DataFrame) -> DataFrame:
    """What is told to those who ask for a prediction before there is a model."""
    return routed.where("intent = 'predict'").select(
        "msg_id", "intent", F.lit(NOTHING["predict"]).alias("answer"))


def _lines(df: DataFrame, position: Column, line: Column, title: str, nothing: str = "") -> DataFrame:
    """A short ordered table as one text, or ``nothing`` if it has no rows."""
    ordered = F.array_sort(F.collect_list(F.struct(position.alias("p"), line.alias("l"))))
    text_ = F.concat(F.lit(f"{title}\n"), F.array_join(F.transform(ordered, lambda r: r["l"]), "\n"))
    return df.agg(F.when(F.count(F.lit(1)) > 0, text_).otherwise(nothing).alias("answer"))


def _ranked(top: DataFrame, label: str, title: str, k: int = 10, nothing: str = "") -> DataFrame:
    """Best k labels with their sales; ``top`` is a top-k table, so the list is short."""
    line = F.concat_ws(": ", F.coalesce(F.col(label).cast("string"), F.lit(display.MISSING)),
                       display.format_currency(F.col("sales")))
    position = F.struct(-F.col("sales"), F.col(label).cast("string"))
    return _lines(top.orderBy(F.desc("sales"), label).limit(k), position, line, title, nothing)


def overview_answer(overview: DataFrame) -> DataFrame:
    counts = [F.concat(F.lit(f"{name.title()}: "), F.format_number(name, 0))
              for name in ("categories", "regions") if name in overview.columns]
    parts = [F.concat(F.lit("Rows: "), F.format_number("rows", 0)),
             F.concat(F.lit("Columns: "), F.format_number("columns", 0)),
             F.concat(F.lit("Total sales: "), display.format_currency(F.col("total_sales"))),
             F.concat(F.lit("Date range: "), F.col("first_date").cast("string"), F.lit(" to "),
                      F.col("last_date").cast("string")), *counts]
    return overview.select(F.concat_ws("\n", *parts).alias("answer"))


def metrics_answer(board: DataFrame) -> DataFrame:
    """The leaderboard as text; one row per model, best first."""
    line = F.concat_ws(" ", "model", *[
        F.concat(F.lit(f"{m}="), F.format_number(m, 2)) for m in ("mae", "rmse", "r2")])
    return _lines(board, F.struct("rmse", "model"), line, "Best model first")


def answer_book(tables: Mapping[str, DataFrame], profile: str = "dashboard") -> DataFrame:
    """(intent, answer) for every intent with one answer; a handful of rows.

    Top lists have ten lines, five in the ``notebook`` profile. Lists without entries, lists that
    the table has no column for, and metrics without a leaderboard are answered by saying so.
    """
    lines = TOP_LINES[profile]
    parts = {"overview": overview_answer(tables["overview"])}
    for intent, name, label, title in (("top_products", "top_product", "product", "Top products"),
                                       ("top_regions", "top_region", "region", "Top regions")):
        if name in tables:
            parts[intent] = _ranked(tables[name], label, title, lines, NOTHING[intent])
    if "monthly_sales" in tables:
        months = tables["monthly_sales"].orderBy("month").limit(12)
        month_line = F.concat_ws(": ", "month", display.format_currency(F.col("sales")))
        parts["seasonality"] = _lines(months, F.struct("month"), month_line, "Seasonality snapshot",
                                      NOTHING["seasonality"])
    if "leaderboard" in tables:
        parts["metrics"] = metrics_answer(tables["leaderboard"])
    spark = tables["overview"].sparkSession
    fixed = spark.createDataFrame(
        [(k, v) for k, v in {**STATIC_ANSWERS, **NOTHING}.items() if k not in parts and k != "predict"],
        "intent string, answer string")
    return reduce(DataFrame.unionByName, [
        part.select(F.lit(intent).alias("intent"), "answer") for intent, part in parts.items()
    ], fixed)


def segment_book(
    summaries: Mapping[str, DataFrame], leaders: Mapping[tuple[str, str], DataFrame]
) -> DataFrame:
    """(topic, answer) for every segment of every role, all computed at once."""
    parts = []
    for role, summary in summaries.items():
        lines = [
            F.concat(F.lit("Rows: "), F.format_number("rows", 0)),
            F.concat(F.lit("Total sales: "), display.format_currency(F.col("total_sales")))]
        if "average_quantity" in summary.columns:
            lines.append(F.concat(F.lit("Average quantity: "),
                                  F.format_number("average_quantity", 2)))
        if "average_price" in summary.columns:
            lines.append(F.concat(F.lit("Average price: "),
                                  display.format_currency(F.col("average_price"))))
        for (by, of), table in leaders.items():
            if by != role:
                continue
            row = F.struct("rank", F.concat_ws(
                ": ", "label", display.format_currency(F.col("sales"))).alias("l"))
            top = table.groupBy("segment").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(row)), lambda r: r["l"]), "\n").alias(f"_{of}"))
            summary = summary.join(top, "segment", "left")
            lines.append(F.concat(F.lit(f"Top {of}s:\n"), F.col(f"_{of}")))
        parts.append(summary.select(
            F.concat(F.lit(f"segment_{role}:"), "segment").alias("topic"),
            F.concat_ws("\n", F.concat(F.lit(f"{role.title()} summary for "), "segment"), *lines
                        ).alias("answer")))
    return reduce(DataFrame.unionByName, parts)


def answers(routed: DataFrame, book: DataFrame, segments: DataFrame | None) -> DataFrame:
    """(msg_id, intent, answer) for the messages that ask for no prediction; ``segments`` are
    None for a table without labels.

    The book has one row per intent, of which there are about ten, and is broadcast;
    segments grow with the data and are attached with hot ones spread out.
    """
    topic = F.coalesce(*[
        F.when(F.col("intent") == f"segment_{c}",
               F.concat(F.lit(f"segment_{c}:"), F.lower(F.col(c)))) for c in KNOWN])
    topics = routed.select("msg_id", "intent", topic.alias("topic"))
    asked = materialize(topics, "topics").where(F.col("intent") != "predict")
    told = (asked.withColumn("_segment", F.lit(None).cast("string")) if segments is None else
            attach_counted(asked, segments.withColumnRenamed("answer", "_segment"), "topic"))
    return told.join(F.broadcast(book), "intent", "left").select(
        "msg_id", "intent", F.coalesce("_segment", "answer").alias("answer"))
