"""Values as people read them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "N/A"
NO_ROWS = "_No rows available._"


def _number(value: Column) -> Column:
    whole = F.abs(value - F.round(value, 0)) < 1e-9
    finite = F.abs(value) < float("inf")
    return F.when(finite & whole, F.format_number(F.round(value, 0), 0)).when(
        finite & ~F.isnan(value), F.format_number(value, 2))


def format_value(col: Column, kind: T.DataType) -> Column:
    """Thousands separators, two decimals unless whole, ``N/A`` for missing or blank."""
    if isinstance(kind, T.BooleanType):
        shown = F.when(col, "True").when(~col, "False")
    elif isinstance(kind, T.IntegralType):
        shown = F.format_number(col, 0)
    elif isinstance(kind, T.NumericType):
        shown = _number(col.cast("double"))
    else:
        shown = F.nullif(F.replace(F.trim(col.cast("string")), F.lit("\n"), F.lit(" ")), F.lit(""))
    return F.coalesce(shown, F.lit(MISSING))


def format_currency(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(col.cast("double"), 2)), F.lit(MISSING))


def format_ratio(col: Column) -> Column:
    percent = F.replace(F.format_number(col.cast("double") * 100, 1), F.lit(","), F.lit(""))
    return F.coalesce(F.concat(percent, F.lit("%")), F.lit(MISSING))


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def formatted(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every listed column as display text."""
    return df.withColumns({
        c: escape_markdown(format_value(F.col(f"`{c}`"), df.schema[c].dataType))
        for c in cols or df.columns})


def markdown_table(df: DataFrame, max_rows: int = 10) -> str:
    """Markdown of the first ``max_rows`` rows in the order ``df`` has; only those are fetched."""
    rows = formatted(df).limit(max_rows).collect()
    if not rows:
        return NO_ROWS
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
