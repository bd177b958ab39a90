"""Sales over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.measures import total
from ..session import materialize
from .sales import monthly_sales


def _grain(span_days: Column, days: Column) -> Column:
    """A10: M for long or busy ranges (and for none), W for medium ones, D for short ones."""
    return (F.when(span_days.isNull() | (span_days > 730) | (days > 365), "M")
            .when((span_days > 120) | (days > 90), "W").otherwise("D"))


def _span_days(first: Column, last: Column) -> Column:
    return F.floor((F.unix_micros(last) - F.unix_micros(first)) / F.lit(86_400_000_000))


def time_grain(df: DataFrame, col: str = "date") -> DataFrame:
    """A10: (span_days, days, grain) of a date column."""
    day = F.col(col)
    return df.agg(_span_days(F.min(day), F.max(day)).alias("span_days"),
                  F.count_distinct(F.to_date(day)).alias("days")).withColumn(
        "grain", _grain(F.col("span_days"), F.col("days")))


def choose_grain(df: DataFrame, col: str = "date") -> str:
    return time_grain(df, col).first()["grain"]


def daily_sales(df: DataFrame) -> DataFrame:
    """One row per day, written: all that trends and months need, from one pass over the table.

    ``first`` and ``last`` are the times of rows with sales, null on days without any.
    """
    sold = F.when(F.col("sales").isNotNull(), F.col("date"))
    return materialize(df.where("date is not null").groupBy(F.to_date("date").alias("day")).agg(
        F.sum("sales").alias("sales"), F.min(sold).alias("first"), F.max(sold).alias("last")
    ), "daily-sales")


def as_days(daily: DataFrame) -> DataFrame:
    """Daily sales as a table of one dated row per day, for the sums per month."""
    return daily.select(F.col("day").cast("timestamp").alias("date"), "sales")


def sales_trend(
    df: DataFrame, grain: str | None = None, daily: DataFrame | None = None
) -> DataFrame:
    """(bucket, sales) at the chosen grain; periods without rows are there with 0.

    The list of periods is made from the first and last bucket alone, so its length
    depends on the dates covered and not on the number of rows.
    """
    daily = (daily_sales(df) if daily is None else daily).where("first is not null")
    if grain is None:
        grain = daily.agg(_grain(_span_days(F.min("first"), F.max("last")), F.count("day"))
                          ).first()[0]
    buckets = daily.groupBy(dates.bucket(F.col("day"), grain).alias("bucket")).agg(
        total("sales").alias("sales"))
    periods = buckets.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last")).select(
        F.explode(dates.next_buckets(F.col("first"), F.col("last"), grain)).alias("bucket"))
    return periods.join(buckets, "bucket", "left").select(
        "bucket", F.coalesce("sales", F.lit(0.0)).alias("sales"))


def extremes(periods: DataFrame, label: str) -> DataFrame:
    """First period with the highest and first with the lowest sales, in one pass."""

    def first_best(sign: int) -> Column:
        return F.min(F.struct((F.col("sales") * sign).alias("by"), F.col(label).alias("label"),
                              F.col("sales").alias("sales")))

    return periods.agg(first_best(-1).alias("peak"), first_best(1).alias("low")).select(
        F.col("peak.label").alias("peak"), F.col("peak.sales").alias("peak_sales"),
        F.col("low.label").alias("low"), F.col("low.sales").alias("low_sales"))


def month_pattern(df: DataFrame) -> DataFrame:
    """Sales per month of the year, 1 to 12."""
    return df.where("date is not null").groupBy(F.month("date").alias("month")).agg(
        total("sales").alias("sales"))


def first_and_last_period(df: DataFrame) -> DataFrame:
    """The first and last calendar month and their sales."""
    months = monthly_sales(df)
    return months.agg(
        F.min("month").alias("first_period"), F.max("month").alias("last_period"),
        F.min_by("sales", "month").alias("first_period_sales"),
        F.max_by("sales", "month").alias("last_period_sales"))
