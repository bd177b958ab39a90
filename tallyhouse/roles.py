"""SC1-SC5: map arbitrary column names to business roles. Works on names, never on rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import to_timestamp_any

# The roles, in the order in which they claim columns.
ROLE_ORDER = ("sales", "quantity", "price", "discount", "date", "category", "product", "region",
              "customer_id", "order_id")

# Other names of each role, best first.
ROLE_ALIASES: dict[str, tuple[str, ...]] = {
    "sales": ("revenue", "amount", "total_sales", "sales_amount", "gross_sales", "net_sales",
              "order_value", "total_revenue"),
    "quantity": ("qty", "units", "unit_sold", "units_sold", "items", "count", "items_sold"),
    "price": ("unit_price", "price_per_unit", "selling_price", "sale_price", "item_price",
              "cost_per_unit"),
    "discount": ("discount_rate", "discount_percent", "markdown", "promo_discount",
                 "promotion_discount"),
    "date": ("order_date", "transaction_date", "invoice_date", "sales_date", "purchase_date",
             "timestamp", "datetime", "date_time"),
    "category": ("product_category", "category_name", "department", "segment", "group",
                 "product_type"),
    "product": ("product_name", "item", "item_name", "sku", "product_code", "product_id",
                "product_title"),
    "region": ("area", "state", "city", "market", "territory", "zone", "store_region", "location"),
    "customer_id": ("customer", "customer_name", "client", "client_id", "buyer_id", "user_id",
                    "cust_id"),
    "order_id": ("order", "order_number", "transaction_id", "invoice_id", "receipt_id", "sale_id"),
}

# The nine roles and exact names of the modelling profile.
MODEL_ALIASES: dict[str, tuple[str, ...]] = {
    "date": ("invoice_date", "order_date", "transaction_date", "date", "timestamp"),
    "sales": ("sales", "revenue", "amount"),
    "quantity": ("quantity", "qty", "units"),
    "price": ("unit_price", "price", "selling_price", "sale_price"),
    "product": ("description", "product", "item", "product_name"),
    "region": ("country", "region", "market", "state", "city"),
    "customer_id": ("customer_id", "customerid", "client_id"),
    "order_id": ("invoice_no", "order_id", "transaction_id", "order_number"),
    "category": ("category", "product_category", "segment"),
}

# How roles are shown.
ROLE_LABELS = {
    "sales": "Sales", "quantity": "Quantity", "price": "Price", "discount": "Discount",
    "date": "Date", "category": "Category", "product": "Product", "region": "Region",
    "customer_id": "Customer ID", "order_id": "Order ID"}

# How close a name must be, and what a contained name scores.
MATCH_THRESHOLD = 0.72
CONTAINMENT_SCORE = 0.97
DATE_SHARE = 0.55
DATE_NAME_BONUS = 0.15
DATE_NAME_WORDS = ("date", "time", "timestamp", "datetime")

MEASURES = ("sales", "quantity", "price", "discount")


def normalize_name(name: object, split_camel: bool = True) -> str:
    """SC1: snake_case of a column name (``InvoiceDate`` -> ``invoice_date``)."""
    text = str(name).strip()
    if split_camel:
        text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_") or "column"


def unique_labels(labels: Iterable[str]) -> list[str]:
    """SC1: number repeated names from ``_2`` on, skipping numbers that are taken."""
    taken: set[str] = set()
    result = []
    for label in labels:
        fresh, number = label, 1
        while fresh in taken:
            number += 1
            fresh = f"{label}_{number}"
        taken.add(fresh)
        result.append(fresh)
    return result


def rename_normalized(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_labels(normalize_name(c) for c in df.columns))


def _words(name: str) -> str:
    """Name as delimited words without a plural s, so containment means whole words."""
    return "_" + "_".join(word.rstrip("s") or word for word in name.split("_")) + "_"


def _within(a: str, b: str) -> bool:
    return a in b or b in a


def closeness(column: str, name: str, mode: str = "token") -> float:
    """SC2: how well a column name fits a role name.

    One name inside the other scores high: as whole words in ``token`` mode, as any
    substring in ``fuzzy`` mode. ``token`` mode takes other substrings for chance
    (``count`` in ``country``); names apart from each other compare by spelling.
    """
    whole = _within(_words(column), _words(name))
    if whole or (mode == "fuzzy" and _within(column, name)):
        return CONTAINMENT_SCORE
    if mode == "token" and _within(column, name):
        return 0.0
    return SequenceMatcher(None, column, name).ratio()


def best_match(columns: Sequence[str], names: Sequence[str], mode: str = "token") -> str | None:
    """SC2/SC3: the column that fits a role best, or None.

    An exact name wins, in the order of ``names``; unless ``mode`` is ``exact`` the
    closest name comes next. Ties go to the first column.
    """
    exact = [name for name in names if name in columns]
    if exact or mode == "exact":
        return exact[0] if exact else None
    scores = {column: max(closeness(column, name, mode) for name in names) for column in columns}
    best = max(scores, key=scores.get, default=None)
    return best if best is not None and scores[best] >= MATCH_THRESHOLD else None


def assign_roles(
    columns: Sequence[str],
    aliases: Mapping[str, Sequence[str]] = ROLE_ALIASES,
    mode: str = "token",
) -> dict[str, str | None]:
    """Role -> source column; a column serves one role only.

    ``fuzzy`` mode goes through the roles once, so an early role may take a column
    whose exact name belongs to a later one; the others settle exact names first.
    """
    free = list(columns)
    roles: dict[str, str | None] = dict.fromkeys(aliases)
    for stage in (("fuzzy",) if mode == "fuzzy" else dict.fromkeys(("exact", mode))):
        for role, names in aliases.items():
            found = best_match(free, [role, *names], stage) if roles[role] is None else None
            if found is not None:
                roles[role] = found
                free.remove(found)
    return roles


def date_shares(df: DataFrame, columns: Sequence[str], sample_rows: int | None = None) -> DataFrame:
    """SC4: share of each column's values that are or parse as a date, in one pass.

    All rows count by default: a distributed table has no first rows to sample.
    """
    rows = df.select(*columns) if sample_rows is None else df.select(*columns).limit(sample_rows)

    def parsed(c: str) -> Column:
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        return to_timestamp_any(F.col(c)) if is_text else F.col(c).cast("timestamp")

    shares = rows.agg(*[
        F.try_divide(F.count(parsed(c)).cast("double"), F.count(F.col(c)).cast("double")).alias(c)
        for c in columns])
    return shares.unpivot([], list(columns), "column", "parsed_share")


def infer_date_column(
    df: DataFrame, taken: Iterable[str] = (), sample_rows: int | None = None
) -> str | None:
    """SC4: the column that looks most like a date, where no name says so."""
    excluded = set(taken)
    dates = (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)
    columns = [f.name for f in df.schema if isinstance(f.dataType, dates)
               and f.name not in excluded]
    if not columns:
        return None
    shares = {r["column"]: r["parsed_share"]
              for r in date_shares(df, columns, sample_rows).collect()}

    def score(column: str) -> float:
        if shares[column] is None:
            return 0.0
        named = any(word in normalize_name(column) for word in DATE_NAME_WORDS)
        return shares[column] + (DATE_NAME_BONUS if named else 0.0)

    best = max(columns, key=score)
    return best if score(best) >= DATE_SHARE else None


def resolve_roles(df: DataFrame, mode: str = "token") -> tuple[DataFrame, dict[str, str | None]]:
    """SC2: normalise names, rename the matched columns to their roles in one select."""
    named = rename_normalized(df)
    roles = assign_roles(named.columns, ROLE_ALIASES, mode)
    if roles["date"] is None:
        roles["date"] = infer_date_column(named, [c for c in roles.values() if c])
    return _rename(named, roles), roles


def resolve_model_roles(df: DataFrame) -> tuple[DataFrame, dict[str, str | None]]:
    """SC3: the modelling profile, exact names only."""
    named = rename_normalized(df)
    roles = assign_roles(named.columns, MODEL_ALIASES, "exact")
    return _rename(named, roles), roles


def _rename(df: DataFrame, roles: Mapping[str, str | None]) -> DataFrame:
    new = {source: role for role, source in roles.items() if source}
    labels = unique_labels([new[c] for c in df.columns if c in new]
                           + [c for c in df.columns if c not in new])
    kept = iter(labels[len(new):])
    return df.toDF(*[new[c] if c in new else next(kept) for c in df.columns])


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    """SC5: numeric, datetime and categorical columns by type."""
    kinds: dict[str, list[str]] = {"numeric": [], "datetime": [], "categorical": []}
    for field in df.schema:
        if isinstance(field.dataType, T.NumericType):
            kinds["numeric"].append(field.name)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kinds["datetime"].append(field.name)
        else:
            kinds["categorical"].append(field.name)
    return kinds


def metric_columns(df: DataFrame) -> list[str]:
    """SC5: the measures present, else every numeric column that is not an id."""
    found = [c for c in MEASURES if c in df.columns]
    return found or [c for c in column_kinds(df)["numeric"] if not c.endswith("_id")]


def explorer_axes(df: DataFrame) -> dict[str, str | None]:
    """SC5: default axes for exploring: the preferred column, else the next numeric one."""
    kinds = column_kinds(df)
    numeric, categorical = kinds["numeric"], kinds["categorical"]
    axes: dict[str, str | None] = {}
    for position, (axis, wanted) in enumerate(
            {"x": "quantity", "y": "sales", "z": "price"}.items()):
        fallback = numeric[position] if position < len(numeric) else None
        axes[axis] = wanted if wanted in numeric else fallback
    axes["color"] = "category" if "category" in categorical else (categorical or [None])[0]
    return axes
