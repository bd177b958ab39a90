"""Equi-joins whose hot keys are spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# A key is hot when it holds more than 1/HOT_PARTS of the rows, so fewer than
# HOT_PARTS keys can be hot whatever the data.
HOT_PARTS = 64
# Hot keys are spread over this many join buckets.
SALTS = 64
# Tables with one row per key are broadcast up to this many rows, and bytes of what they hold.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS) -> list:
    """Keys with more than ``1/parts`` of the rows, from one pass with a fixed-size sketch.

    The sketch holds 128 times as many items as there can be hot keys. A miss costs
    balance, never a row: the join below is right for any list.
    """
    found, rows = df.agg(
        F.expr(f"approx_top_k(`{key}`, {parts}, {parts * 128})"), F.count(F.lit(1))).first()
    return [r["item"] for r in found or []
            if r["item"] is not None and r["count"] * parts > rows]


def attach(
    df: DataFrame, per_key: DataFrame, key: str, hot: list | None = None, salts: int = SALTS
) -> DataFrame:
    """Left join ``per_key`` (one row per key) to ``df`` without one task per hot key.

    Rows with a hot or missing key get one of ``salts`` bucket numbers, and only the
    matching rows of ``per_key`` are repeated per bucket. The number comes from the
    row's content and partition, so a task that runs again sends its rows the same way.
    """
    hot = hot_keys(df, key) if hot is None else hot
    spread = F.pmod(
        F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) + F.spark_partition_id(),
        F.lit(salts)).cast("int")

    def is_hot(col: Column) -> Column:
        return F.coalesce(col.isin(hot), F.lit(False)) if hot else F.lit(False)

    left = df.withColumn("_salt", F.when(
        F.col(key).isNull() | is_hot(F.col(key)), spread).otherwise(0))
    right = per_key.withColumn("_salt", F.explode(F.when(
        is_hot(F.col(key)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col(f"`{c}`") for c in per_key.columns if c != key])


def attach_counted(df: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """`attach` of a table that may be small: it is written and counted, and broadcast if it is, so
    that ``df`` stays where it is."""
    written = materialize(per_key, "per-key")
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in written.columns]))))
    rows, held = written.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if rows > BROADCAST_ROWS or held > BROADCAST_BYTES:
        return attach(df, written, key)
    return df.join(F.broadcast(written), key, "left").select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`") for c in per_key.columns if c != key])
