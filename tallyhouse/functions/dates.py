"""Column expressions over dates: parsing, calendar parts, time grains."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (shape, format, order): a format is tried only where the text has its shape, so rows in
# another format cost a regex test rather than a parser exception. ``None`` is the ISO cast.
# ``order`` marks formats that share a shape and differ in which of month and day is first.
MONTH_FIRST, DAY_FIRST = "month", "day"
_D, _TIME, _AMPM = r"\d{1,2}", r" \d{1,2}:\d{2}", r" \d{1,2}:\d{2} ?[AaPp][Mm]"


def _slashed() -> list[tuple[str, str | None, str | None]]:
    """Every numeric format with slashes, month first and day first."""
    found: list[tuple[str, str | None, str | None]] = []
    for year, digits in (("yyyy", r"\d{4}"), ("yy", r"\d{2}")):
        for clock, shape in (("", ""), (" H:mm", _TIME), (" H:mm:ss", _TIME + r":\d{2}"),
                             (" h:mm a", _AMPM)):
            for order, days in ((MONTH_FIRST, "M/d"), (DAY_FIRST, "d/M")):
                found.append((f"^{_D}/{_D}/{digits}{shape}$", f"{days}/{year}{clock}", order))
    return found


DATE_FORMATS: tuple[tuple[str, str | None, str | None], ...] = (
    (r"^\d{4}-\d{1,2}-\d{1,2}", None, None),
    *_slashed(),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", None),
    (rf"^\d{{4}}/{_D}/{_D}{_TIME}$", "yyyy/M/d H:mm", None),
    (rf"^\d{{4}}/{_D}/{_D}{_TIME}:\d{{2}}$", "yyyy/M/d H:mm:ss", None),
    (rf"^{_D}\.{_D}\.\d{{4}}$", "d.M.yyyy", None),
    (rf"^{_D}\.{_D}\.\d{{4}}{_TIME}$", "d.M.yyyy H:mm", None),
    (rf"^{_D}-[A-Za-z]{{3}}-\d{{4}}$", "d-MMM-yyyy", None),
    (rf"^{_D}-[A-Za-z]{{3}}-\d{{2}}$", "d-MMM-yy", None),
    (rf"^{_D} [A-Za-z]{{3}} \d{{4}}$", "d MMM yyyy", None),
    (rf"^[A-Za-z]{{3}} {_D}, \d{{4}}$", "MMM d, yyyy", None),
    (rf"^[A-Za-z]{{3}} {_D} \d{{4}}$", "MMM d yyyy", None),
    (rf"^[A-Za-z]{{3,9}} {_D}, \d{{4}}$", "MMMM d, yyyy", None),
    (r"^\d{8}$", "yyyyMMdd", None),
)

UNIX_EPOCH = "1970-01-01"
#: Two-digit years from here on are of the century before.
PIVOT_YEAR = 2069


def _parse(col: Column, shape: str, fmt: str | None) -> Column:
    if fmt is None:
        return F.when(col.rlike(shape), col.try_cast("timestamp"))
    text = F.initcap(F.lower(col)) if "MMM" in fmt else col
    if fmt.endswith(" a"):  # the marker is upper case and stands alone
        text = F.upper(F.regexp_replace(col, r"(?i) ?([ap]m)$", " $1"))
    parsed = F.try_to_timestamp(text, F.lit(fmt))
    if "yyyy" not in fmt:
        parsed = F.when(F.year(parsed) >= PIVOT_YEAR, parsed - F.expr("interval 100 years")
                        ).otherwise(parsed)
    return F.when(col.rlike(shape), parsed)


def to_timestamp_any(
    col: Column, formats: Sequence[tuple[str, str | None, str | None]] = DATE_FORMATS
) -> Column:
    """C4: first format that parses the text; NULL where none does."""
    return F.coalesce(*[_parse(col, shape, fmt) for shape, fmt, _ in formats],
                      F.lit(None).cast("timestamp"))


# Texts by their shape: every digit a 9, every letter an a. Longer shapes than any format's
# are cut, so that free text costs little.
_SHAPED = "".join(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]))
_SHAPES = "9" * 10 + "a" * 52
_LONGEST = 40
_SLASHED = rf"^{_D}/{_D}/(\d{{4}}|\d{{2}})( |$)"
_CLOCK = (r"^(([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?|(0?[1-9]|1[0-2]):[0-5]\d ?[AaPp][Mm])$")


def text_shape(col: Column) -> Column:
    """``07/Mar/2024`` is ``99/aaa/9999``."""
    return F.substring(F.translate(col, _SHAPED, _SHAPES), 1, _LONGEST)


def _is_date(month: Column, day: Column, year: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = (F.when(month == 2, 28 + leap.cast("int")).when(month.isin(4, 6, 9, 11), 30).otherwise(31))
    return month.between(1, 12) & day.between(1, last)


def _has(shape: Column, pattern: str) -> Column:
    """Whether texts of a shape can match a format's pattern."""
    return shape.rlike(pattern.replace("[AaPp][Mm]", "[A-Za-z]{2}"))


@dataclass(frozen=True)
class Election:
    """The formats a column is read with, and what is doubtful about them.

    ``unparsed`` counts the texts whose shape no format has.
    """

    formats: tuple[tuple[str, str | None, str | None], ...]
    order: str
    ambiguous: int
    unparsed: int


def elect_formats(
    df: DataFrame, names: Sequence[str],
    formats: Sequence[tuple[str, str | None, str | None]] = DATE_FORMATS,
) -> dict[str, Election]:
    """C4: for each column one order of month and day, and only the formats it needs.

    One pass over all columns counts texts by shape, and for texts with slashes whether they
    are dates with the month first, with the day first, and the same date both ways; no text
    is parsed. The order that reads more texts wins, month first on a tie. Kept are the formats of
    that order, and those without one, whose shape occurs. ``ambiguous`` texts mean different
    dates in the two orders. Formats with an order are two numbers, a slash after each, and a year.
    """
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("text")) for c in names]))
    col = F.col("text")
    parts = F.split(col, "[/ ]", 4)
    one, two, year = (F.get(parts, F.lit(i)).try_cast("int") for i in range(3))
    year = F.when(year >= 100, year).when(year >= PIVOT_YEAR - 2000, year + 1900).otherwise(year + 2000)
    on_time = F.coalesce(F.get(parts, F.lit(3)).rlike(_CLOCK), F.lit(True))
    slashed = col.rlike(_SLASHED) & on_time
    month, day = (F.coalesce(slashed & _is_date(m, d, year), F.lit(False)) for m, d in ((one, two), (two, one)))
    # Dates repeat: equal texts are added up in the map tasks, and each is looked at once.
    distinct = df.select(texts.alias("t")).select("t.*").where("text is not null").groupBy("name", "text").agg(
        F.count(F.lit(1)).alias("n"))
    counts = distinct.select(
        "name", text_shape(col).alias("shape"), month.alias("month"), day.alias("day"),
        F.coalesce(slashed & (one == two), F.lit(False)).alias("same"), "n",
    ).groupBy("name", "shape", "month", "day", "same").agg(F.sum("n").alias("n"))
    patterns = list(dict.fromkeys(f[0] for f in formats))
    ordered = dict.fromkeys(f[0] for f in formats if f[2])
    shape, n, no = F.col("shape"), F.col("n"), F.lit(False)
    any_order, any_known = (reduce(lambda x, y: x | y, [_has(shape, p) for p in ps], no)
                            for ps in (ordered, patterns))
    total = {"month": any_order & F.col("month"), "day": any_order & F.col("day"),
             "ambiguous": any_order & F.col("month") & F.col("day") & ~F.col("same"), "unread": ~any_known}
    rows = counts.groupBy("name").agg(
        *[F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias(k) for k, test in total.items()],
        *[F.max(_has(shape, p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    found = {}
    for row in rows:
        order = DAY_FIRST if row["day"] > row["month"] else MONTH_FIRST
        occurs = {p for i, p in enumerate(patterns) if row[f"p{i}"]}
        kept = tuple(f for f in formats if f[2] in (None, order) and f[0] in occurs)
        found[row["name"]] = Election(kept, order, row["ambiguous"], row["unread"])
    return {c: found.get(c, Election((), MONTH_FIRST, 0, 0)) for c in names}


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def is_weekend(date: Column) -> Column:
    return F.coalesce((F.weekday(date) >= 5).cast("int"), F.lit(0))


def bucket(date: Column, grain: str) -> Column:
    """Label of the period a date falls in: month end, Sunday that ends the week, or day."""
    day = F.to_date(date)
    if grain == "M":
        return F.last_day(day)
    if grain == "W":
        return F.date_add(F.to_date(F.date_trunc("week", day)), 6)
    return day


def next_buckets(first: Column, last: Column, grain: str) -> Column:
    """Every bucket label from ``first`` to ``last``."""
    if grain == "M":
        months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
        return F.transform(months, F.last_day)
    step = "interval 7 days" if grain == "W" else "interval 1 day"
    return F.sequence(first, last, F.expr(step))
