"""Column expressions over text: cleaning, casing, numbers, keyword rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode, not only U+0020.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Words that stand for a missing cell after trimming.
MISSING_WORDS = ("", "nan", "None")

# Ordered keyword rules, first category with a hit wins.
CATEGORY_RULES: dict[str, tuple[str, ...]] = {
    "Electronics": ("laptop", "computer", "usb", "wireless", "headphone", "monitor", "camera",
                    "keyboard", "mouse", "speaker", "charger", "phone", "tablet"),
    "Home": ("candle", "lamp", "chair", "table", "storage", "kitchen", "bath", "towel", "mug",
             "plate", "frame", "mirror", "cushion"),
    "Office": ("paper", "pen", "notebook", "folder", "binder", "calculator", "printer", "desk",
               "staple"),
    "Apparel": ("shirt", "jeans", "jacket", "shoe", "sneaker", "dress", "skirt", "coat", "sock"),
    "Beauty": ("cream", "soap", "shampoo", "lotion", "makeup", "perfume", "skincare", "face wash"),
    "Grocery": ("tea", "coffee", "snack", "cereal", "bread", "rice", "pasta", "sugar"),
}

_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def clean(col: Column) -> Column:
    """Trimmed text, with the missing-value words turned into NULL."""
    value = strip(col)
    for word in MISSING_WORDS:
        value = F.nullif(value, F.lit(word))
    return value


def squeeze(col: Column) -> Column:
    """Trimmed text with every run of white space as one blank."""
    return F.trim(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " "))


def title(col: Column) -> Column:
    """Capitalise every run of letters (``t-shirt don't`` -> ``T-Shirt Don'T``).

    Text made of letters and blanks only, the usual case, stays on ``initcap``;
    the split into runs is paid for only where another character occurs.
    """
    lowered = F.lower(col)
    runs = F.regexp_extract_all(lowered, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    return F.when(
        col.rlike(f"[^{_CASED} ]"), F.array_join(F.transform(runs, F.initcap), "")
    ).otherwise(F.initcap(lowered))


def to_number(col: Column) -> Column:
    """``($1,234.50)`` -> -1234.5; letters and signs are dropped, the rest must parse."""
    signed = F.regexp_replace(col, r"\(([^)]+)\)", "-$1")
    return F.regexp_replace(signed, r"[^0-9.\-]", "").try_cast("double")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda found, word: found | word, [text.contains(word) for word in words])


def categorize(
    col: Column, rules: Mapping[str, Sequence[str]] = CATEGORY_RULES, default: str = "Other"
) -> Column:
    """First category, in rule order, with a keyword inside the lower-cased text."""
    lowered = F.lower(col)
    return F.coalesce(
        *[F.when(contains_any(lowered, words), F.lit(name)) for name, words in rules.items()],
        F.lit(default),
    )


def number_after(text: Column, labels: Sequence[str], as_int: bool = False) -> Column:
    """T4: number that follows the first label (in the given order) found before one. A pattern runs
    only over texts that hold its words."""
    lowered = F.lower(text)

    def after(label: str) -> Column:
        words = label.split(" ")
        spelled = r"\s+".join(re.escape(word) for word in words)
        found = F.regexp_extract(text, rf"(?i){spelled}\s*[:=]?\s*\$?(-?\d+(?:\.\d+)?)", 1)
        there = reduce(lambda a, b: a & b, [lowered.contains(word.lower()) for word in words])
        return F.when(there, found.try_cast("double"))  # no number, no double

    value = F.coalesce(*[after(label) for label in labels])
    return F.bround(value, 0) if as_int else value
