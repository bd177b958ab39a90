"""Row cleaning, derived columns, imputation, model features.

Each step is ``DataFrame -> DataFrame`` for ``df.transform``; every role is optional.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, ranks, text
from ..roles import MEASURES, column_kinds, resolve_model_roles, resolve_roles
from ..session import materialize
from .joins import attach

LABELS = ("category", "product", "region")
IDS = ("customer_id", "order_id")
NEGATIVE_IS_MISSING = {"report": ("quantity", "price", "discount"),
                       "model": ("quantity", "price", "sales")}
COPIES = "_copies"
# Whether a row's date is a text that no format reads, and how many cells of it are missing.
UNREAD, GAPS = "_unread", "_gaps"
MODEL_MEASURES = ("quantity", "price", "sales", "customer_purchase_count")
# Lower bounds of the model frame.
LOWER_BOUNDS = {"quantity": 1.0, "price": 0.01, "sales": 0.01}


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def _is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(new)) if new else df


def clean_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Trim text; blank, ``nan`` and ``None`` become missing."""
    return _replace(df, {c: text.clean(F.col(c)) for c in (cols or text_columns(df))})


def title_case(
    df: DataFrame, cols: Sequence[str] = LABELS, collapse: bool = True
) -> DataFrame:
    """Title-case labels, after joining runs of blanks to one if ``collapse``."""
    found = _present(df, cols)
    # A step of its own: ``title`` reads its input three times.
    plain = _replace(df, {c: text.squeeze(F.col(c).cast("string")) if collapse
                          else F.col(c).cast("string") for c in found})
    return _replace(plain, {c: text.title(F.col(c)) for c in found})


def numbers(df: DataFrame, cols: Sequence[str] = MEASURES) -> DataFrame:
    """Measures as double; text is coerced, NaN is missing."""
    def number(c: str) -> Column:
        if _is_text(df, c):
            return text.to_number(F.col(c))
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return _replace(df, {c: number(c) for c in _present(df, cols)})


def parse_dates(
    df: DataFrame, cols: Sequence[str] = ("date",), formats=None
) -> DataFrame:
    """C4: dates as timestamps; unparsable text is missing.

    Without ``formats``, each text column is read in the order of month and day that
    reads most of its rows (one pass that counts the shapes of all columns).
    """
    found = _present(df, cols)
    elected = {}
    if formats is None and (texts := [c for c in found if _is_text(df, c)]):
        elected = dates.elect_formats(df, texts)

    def date(c: str) -> Column:
        if _is_text(df, c):
            return dates.to_timestamp_any(F.col(c), elected[c].formats if c in elected else formats)
        return F.col(c).cast("timestamp")
    return _replace(df, {c: date(c) for c in found})


def derive_sales(df: DataFrame) -> DataFrame:
    """sales = quantity * price, where sales is absent or missing."""
    if not {"quantity", "price"} <= set(df.columns):
        return df
    product = F.col("quantity") * F.col("price")
    return df.withColumn(
        "sales", F.coalesce("sales", product) if "sales" in df.columns else product)


def _derive_ratio(df: DataFrame, new: str, divisor: str) -> DataFrame:
    if new in df.columns or not {"sales", divisor} <= set(df.columns):
        return df
    return df.withColumn(new, F.try_divide(
        F.col("sales").cast("double"), F.col(divisor).cast("double")))


def derive_price(df: DataFrame) -> DataFrame:
    """price = sales / quantity, if there is no price column."""
    return _derive_ratio(df, "price", "quantity")


def derive_quantity(df: DataFrame) -> DataFrame:
    """quantity = sales / price, if there is no quantity column."""
    return _derive_ratio(df, "quantity", "price")


def null_negatives(
    df: DataFrame, cols: Sequence[str] = NEGATIVE_IS_MISSING["report"]
) -> DataFrame:
    """A negative amount counts as missing."""
    return _replace(df, {c: F.when(F.col(c) >= 0, F.col(c)) for c in _present(df, cols)})


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is missing (NULL or NaN)."""
    return df.na.drop(how="all")


def dedupe(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; copies collapse in the map tasks first."""
    return df.dropDuplicates()


@dataclass
class Fills:
    """Values that missing cells are filled with, per kind of column."""

    numeric: dict[str, float] = field(default_factory=dict)
    datetime: dict[str, int] = field(default_factory=dict)
    categorical: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        filled: dict[str, Column] = {
            c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(float(v))), F.lit(float(v)))
            for c, v in self.numeric.items()}
        values = {c: F.timestamp_micros(F.lit(v)) for c, v in self.datetime.items()}
        values |= {c: F.lit(v) for c, v in self.categorical.items()}
        filled |= {c: F.coalesce(F.col(c), v.cast(df.schema[c].dataType))
                   for c, v in values.items()}
        return _replace(df, filled)

    def rows(self) -> list[tuple[str, str, str]]:
        """(column, kind, value as text), the driver-side record of what was imputed."""
        stamp = {c: datetime.fromtimestamp(v / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
                 for c, v in self.datetime.items()}
        return ([(c, "median", repr(float(v))) for c, v in self.numeric.items()]
                + [(c, "median", v) for c, v in stamp.items()]
                + [(c, "mode", v) for c, v in self.categorical.items()])


def _micros(as_of: datetime) -> int:
    return int(as_of.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


def fit_fills(
    df: DataFrame,
    as_of: datetime,
    numeric: Sequence[str] = (),
    datetime_cols: Sequence[str] = (),
    categorical: Sequence[str] = (),
    default: str = "Unknown",
    counts: tuple[int, Mapping[str, int]] | None = None,
    written: bool = False,
) -> Fills:
    """Fill values for the columns that have gaps, in a fixed number of passes.

    ``counts`` are the rows and the non-missing values per column, where they are known;
    ``written`` tells that ``df`` is a written table, which medians read without a copy.
    """
    wanted = [*numeric, *datetime_cols, *categorical]
    rows, present = ranks.filled_counts(df, wanted) if counts is None else counts
    numeric, datetime_cols, categorical = (
        [c for c in cols if present[c] < rows] for cols in (numeric, datetime_cols, categorical))

    def span(c: str) -> str:
        return f"_micros_{c}"

    timed = _replace(df, {span(c): F.unix_micros(F.col(c).cast("timestamp"))
                          for c in datetime_cols})
    medians = ranks.exact_medians(timed, [*numeric, *[span(c) for c in datetime_cols]], written)
    common = ranks.modes(df, categorical)
    today = _micros(as_of)
    return Fills(
        {c: 0.0 if medians[c] is None else medians[c] for c in numeric},
        {c: today if medians[span(c)] is None else int(medians[span(c)]) for c in datetime_cols},
        {c: default if common[c] is None else common[c] for c in categorical},
    )


def impute_median(df: DataFrame, cols: Sequence[str], written: bool = False) -> DataFrame:
    """C11: fill numeric gaps with the exact median, 0.0 if a column is all missing."""
    return fit_fills(df, datetime(1970, 1, 1), numeric=cols, written=written).apply(df)


def impute_median_ts(df: DataFrame, cols: Sequence[str], as_of: datetime) -> DataFrame:
    """Fill date gaps with the median instant, ``as_of`` if a column is all missing."""
    return fit_fills(df, as_of, datetime_cols=cols).apply(df)


def impute_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Fill text gaps with the most frequent value (ties: the smallest)."""
    return fit_fills(df, datetime(1970, 1, 1), categorical=cols, default=default).apply(df)


def keep_positive(df: DataFrame, cols: Sequence[str] = ("quantity", "price")) -> DataFrame:
    """C14: keep rows in which every one of the columns is above zero."""
    for c in _present(df, cols):
        df = df.where(F.col(c) > 0)
    return df


def with_category(df: DataFrame) -> DataFrame:
    """Category from the product text, or ``Other`` where a given one is missing."""
    if "category" in df.columns:
        return df.withColumn("category", F.coalesce("category", F.lit("Other")))
    if "product" in df.columns:
        return df.withColumn("category", text.categorize(F.col("product")))
    return df


def fill_role_defaults(
    df: DataFrame, as_of: datetime, profile: str = "dashboard"
) -> DataFrame:
    """Columns that are absent. ``model``: ids, region from country, empty date;
    ``dashboard``: date, quantity, price, region and category."""
    new: dict[str, Column] = {}
    if profile == "model":
        if "region" not in df.columns and "country" in df.columns:
            new["region"] = F.col("country")
        if "customer_id" not in df.columns:
            new["customer_id"] = F.lit("Unknown")
        if "date" not in df.columns:
            new["date"] = F.lit(None).cast("timestamp")
        df = _replace(df, new)
        if "order_id" not in df.columns:
            df = ranks.number_rows(df, df.columns, "order_id")
        return df
    if "date" not in df.columns:
        new["date"] = F.timestamp_micros(F.lit(_micros(as_of)))
    if "quantity" not in df.columns:
        new["quantity"] = F.lit(1.0)
    if "price" not in df.columns:
        new["price"] = F.lit(1.0)
    if "region" not in df.columns:
        new["region"] = F.lit("Unknown")
    if "category" not in df.columns:
        new["category"] = F.col("product") if "product" in df.columns else F.lit("Other")
    return _replace(df, new)


def time_features(df: DataFrame) -> DataFrame:
    """C17: month, day_of_week (Monday 0), hour, is_weekend."""
    date = F.col("date")
    return df.withColumns({
        "month": F.month(date), "day_of_week": F.weekday(date), "hour": F.hour(date),
        "is_weekend": dates.is_weekend(date)})


def customer_purchase_count(df: DataFrame, hot: list | None = None) -> DataFrame:
    """Rows of the same customer on every row; no customer, no count.

    Counted with map-side combining and joined back with hot customers spread out; a
    window would put all rows of one customer in one task.
    """
    counts = df.where("customer_id is not null").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("customer_purchase_count"))
    base = df.drop("customer_purchase_count")
    return attach(base, counts, "customer_id", hot)


def clip_lower(df: DataFrame, bounds: Mapping[str, float] = LOWER_BOUNDS) -> DataFrame:
    """Raise values below the bound to it."""
    return _replace(df, {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(low)))
                         for c, low in bounds.items() if c in df.columns})


def model_frame(df: DataFrame, as_of: datetime) -> DataFrame:
    """C20: the frame models and requests work on."""
    had_sales = "sales" in df.columns
    df = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    df = numbers(parse_dates(df), MODEL_MEASURES)
    if not had_sales:
        df = derive_sales(df)
    df = fill_role_defaults(df, as_of)
    if "sales" not in df.columns:
        df = derive_sales(df)
    if "customer_purchase_count" not in df.columns:
        if "customer_id" in df.columns:
            df = customer_purchase_count(df)
        else:
            df = df.withColumn("customer_purchase_count", F.lit(1))
    df = df.withColumns({
        "category": text.strip(F.coalesce(F.col("category").cast("string"), F.lit("Other"))),
        "region": text.strip(F.coalesce(F.col("region").cast("string"), F.lit("Unknown"))),
        "date": F.coalesce("date", F.timestamp_micros(F.lit(_micros(as_of)))),
        "customer_purchase_count": F.col("customer_purchase_count").cast("double"),
    })
    # The customer join and the median passes share one written copy.
    df = materialize(time_features(df), "model-frame")
    return clip_lower(impute_median(df, MODEL_MEASURES, written=True))


@dataclass
class Prepared:
    """Result of a cleaning run; the frames are lazy. ``counted`` holds each distinct
    row once, with the number of its copies, and what was counted on the way."""

    raw: DataFrame
    cleaned: DataFrame
    roles: dict[str, str | None]
    fills: Fills
    counted: Counted
    notes: list[str]
    dates: dates.Election | None = None


def _notes(
    df: DataFrame, roles: Mapping[str, str | None], fills: Fills, read: dates.Election | None
) -> list[str]:
    notes = ["Standardized column names to snake_case.", "Trimmed whitespace from text fields.",
             "Removed duplicate rows."]
    if "sales" in df.columns:
        notes.append("Ensured a canonical sales field was available for revenue analysis.")
    notes.append(
        f"Detected date column: {roles['date']}." if roles.get("date") else
        "No reliable date column was detected; time-based analysis is skipped.")
    if read and read.ambiguous:
        notes.append(f"{read.ambiguous} date(s) were read {read.order} first, like most of their column.")
    if read and read.unparsed:
        notes.append(f"{read.unparsed} date(s) could not be read and count as missing.")
    if "customer_id" not in df.columns:
        notes.append("No customer identifier was detected; "
                     "customer behavior is summarized per transaction.")
    for kind, how, values in (("Numeric", "median values", fills.numeric),
                              ("Categorical", "mode values", fills.categorical),
                              ("Date", "median dates", fills.datetime)):
        if values:
            notes.append(f"{kind} values were imputed for {len(values)} field(s) using {how}.")
    return notes


def clean_rows(df: DataFrame, formats=None) -> DataFrame:
    """C1-C8 on resolved columns: the row-wise part of cleaning, all in one stage."""
    steps = (clean_text, title_case, numbers, lambda d: parse_dates(d, formats=formats),
             derive_sales, derive_price, derive_quantity, null_negatives)
    for step in steps:
        df = df.transform(step)
    return df


@dataclass
class Counted:
    """Distinct rows, written, and what was counted while they were."""

    #: None once the cleaned table is handed off, which has them all.
    rows: DataFrame | None
    #: All rows; those that are not empty; and these without copies.
    all: int
    total: int
    distinct: int
    #: Non-missing values per column, and missing cells, of the distinct rows.
    present: dict[str, int]
    #: Sums over all rows, copies included, of the columns that were to be added up.
    sums: dict[str, int]


def count_copies(df: DataFrame, added: Sequence[str] = ()) -> Counted:
    """C9 and C10 in one shuffle: distinct rows with their number of copies, written once.

    Copies are added up in the map tasks, so a group of equal rows costs one row per
    task. Rows, gaps and the sums of the ``added`` columns (which do not make rows distinct)
    are observed by the tasks that write, which count once however often a task runs. The test
    for empty rows comes after the write: filtered earlier, it would be pushed below the
    cleaning expressions and evaluate them twice.
    """
    cols = [c for c in df.columns if c not in added]
    copies = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(
        F.count(F.lit(1)).alias(COPIES), *[F.sum(c).alias(c) for c in added])
    there = [ranks.present_value(df, c).isNotNull() for c in cols]
    empty = ~reduce(lambda x, y: x | y, there)
    seen = Observation()
    watched = copies.observe(
        seen, F.coalesce(F.sum(COPIES), F.lit(0)).alias("all"),
        F.coalesce(F.sum(F.when(~empty, F.col(COPIES))), F.lit(0)).alias("total"),
        F.count_if(~empty).alias("distinct"),
        *[F.count_if(t).alias(f"n{i}") for i, t in enumerate(there)],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"s{i}") for i, c in enumerate(added)])
    rows = materialize(watched, "distinct-rows").drop(*added).na.drop(how="all", subset=cols)
    got = seen.get
    return Counted(rows, got["all"], got["total"], got["distinct"], {c: got[f"n{i}"] for i, c in enumerate(cols)},
                   {c: got[f"s{i}"] for i, c in enumerate(added)})


def fill_gaps(
    df: DataFrame, as_of: datetime, impute_ids: bool = False,
    counts: tuple[int, Mapping[str, int]] | None = None,
) -> tuple[DataFrame, Fills]:
    """C11-C13 on every column of a written table; ids stay as they are unless ``impute_ids``."""
    kinds = column_kinds(df)
    skip = () if impute_ids else IDS
    fills = fit_fills(
        df, as_of, [c for c in kinds["numeric"] if c not in skip], kinds["datetime"],
        [c for c in kinds["categorical"] if c not in skip], counts=counts, written=True)
    return fills.apply(df), fills


def prepare(
    raw: DataFrame, as_of: datetime, mode: str = "token", impute_ids: bool = False,
    formats=None,
) -> Prepared:
    """Resolve, clean, deduplicate and impute a raw table.

    The deduplicated rows are written once; the passes that fit the fill values and
    everything downstream read that copy instead of repeating the shuffle.
    """
    named, roles = resolve_roles(raw, mode)
    gaps = sum((ranks.present_value(named, c).isNull().cast("int") for c in named.columns), F.lit(0))
    named = named.withColumn(GAPS, gaps)
    read, added = None, [GAPS]
    if formats is None and "date" in named.columns and _is_text(named, "date"):
        read = dates.elect_formats(clean_text(named.select("date")), ["date"])["date"]
        formats, added = read.formats, [GAPS, UNREAD]
        named = named.withColumn(UNREAD, F.col("date"))  # cleaned like the date itself
    typed = clean_rows(named, formats)
    if read:
        unread = F.col(UNREAD).isNotNull() & F.col("date").isNull()
        typed = typed.withColumn(UNREAD, unread.cast("int"))
    if "sales" not in typed.columns:
        raise ValueError("no sales column, and none can be derived from quantity and price")
    counted = count_copies(typed, added)
    if read:
        read = replace(read, unparsed=counted.sums[UNREAD])
    cleaned, fills = fill_gaps(counted.rows.drop(COPIES), as_of, impute_ids,
                               (counted.distinct, counted.present))
    for role in ("sales", "price", "quantity"):
        if role in cleaned.columns:
            roles[role] = roles.get(role) or role
    notes = _notes(cleaned, roles, fills, read)
    return Prepared(raw, cleaned, roles, fills, counted, notes, read)


def standardize_for_model(df: DataFrame, as_of: datetime) -> DataFrame:
    """C22, first half: roles, text, numbers, dates, sales and category."""
    named, _ = resolve_model_roles(df)
    trimmed = _replace(named, {c: text.strip(F.col(c)) for c in text_columns(named)})
    typed = parse_dates(numbers(trimmed, ("quantity", "price", "sales")))
    return with_category(derive_sales(typed))


def prepare_for_model(
    raw: DataFrame, as_of: datetime, impute_ids: bool = False
) -> DataFrame:
    """The modelling profile. Duplicates go before ids are made up, and sales is
    back-filled before it is imputed, so both steps can take effect."""
    standard = dedupe(standardize_for_model(raw, as_of))
    standard = fill_role_defaults(standard, as_of, "model")
    cased = title_case(clean_text(standard), collapse=False)
    signed = null_negatives(cased, NEGATIVE_IS_MISSING["model"])
    deduped = materialize(derive_sales(signed), "model-rows")
    filled = keep_positive(fill_gaps(deduped, as_of, impute_ids)[0])
    return customer_purchase_count(time_features(filled))
