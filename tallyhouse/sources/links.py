"""IO4: data-file links in a table of web pages (page_id, url, html)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of the data files looked for.
DATA_SUFFIXES = (".csv", ".xlsx", ".xls", ".json", ".txt")
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))

# Text that is not markup: comments, scripts, styles.
_NOT_MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*:)"


def _split(url: Column) -> dict[str, Column]:
    """Parts of a URL, each with its delimiter, so that joining them gives the URL back."""
    return {
        "scheme": F.regexp_extract(url, _SCHEME, 1),
        "host": F.regexp_extract(url, rf"{_SCHEME}?(//[^/?#]*)", 2),
        "path": F.regexp_extract(url, rf"{_SCHEME}?(?://[^/?#]*)?([^?#]*)", 2),
        "query": F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1),
    }


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; only paths that have some take the slow way."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    steps = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda kept, part: F.when(part == ".", kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1))))
        .otherwise(F.array_append(kept, part)))
    open_end = F.when(last.isin(".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"),
                  F.concat(F.array_join(steps, "/"), open_end)).otherwise(path)


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` as found on page ``base``."""
    b, r = _split(base), _split(link)
    folder = F.regexp_extract(b["path"], r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    root = F.concat(b["scheme"], b["host"])
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return (
        F.when(link == "", base)
        .when(r["scheme"] != "", link)
        .when(r["host"] != "", F.concat(b["scheme"], link))
        .when(link.startswith("#"), F.concat(root, b["path"], b["query"], link))
        .when(link.startswith("?"), F.concat(root, b["path"], link))
        .when(r["path"].startswith("/"), F.concat(root, _without_dots(r["path"]), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, r["path"])), rest)))


def discover_links(
    pages: DataFrame, suffixes: Sequence[str] | None = DATA_SUFFIXES
) -> DataFrame:
    """(page_id, link, first_pos): links of each page once, by where they first occur.

    Whole pages are searched; ``suffixes=None`` keeps every link.
    """
    markup = F.regexp_replace("html", _NOT_MARKUP, " ")
    found = pages.select("page_id", "url", F.posexplode(
        F.regexp_extract_all(markup, F.lit(_HREF), F.lit(1))).alias("pos", "raw"))
    href = F.regexp_replace("raw", r"""^(["'])(.*)\1$""", "$2")
    for entity, char in ENTITIES:
        href = F.replace(href, F.lit(entity), F.lit(char))
    links = found.select("page_id", "url", "pos", F.trim(href).alias("href")).select(
        "page_id", "pos", resolve_url(F.col("url"), F.col("href")).alias("link"))
    if suffixes is not None:
        lowered = F.lower("link")
        wanted = F.lit(False)
        for suffix in suffixes:
            wanted = wanted | lowered.endswith(suffix.lower())
        links = links.where(wanted)
    return links.groupBy("page_id", "link").agg(F.min("pos").alias("first_pos"))
