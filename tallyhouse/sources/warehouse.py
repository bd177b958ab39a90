"""Retail views over the star-schema tables of the warehouse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# Read without a join in front, so their scans decide how many tasks the work gets.
SPREAD_TABLES = ("events", "documents", "pages")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan) if name in SPREAD_TABLES else scan


def retail_fact(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line with the ten business roles and the row key ``h``.

    ``nation`` (25 rows) and ``region`` (5 rows) have a fixed size and are broadcast.
    Lines and orders both grow with the data and are merged, so that the wide lines
    move once per key and adaptive skew handling can split a hot order. The other
    joins carry no hint: the optimizer's size checks choose their strategy.
    """
    lineitem = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    places = table(spark, folder, "nation").join(
        F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")

    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = lineitem.join(
        buyers.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(part, F.col("l_partkey") == F.col("p_partkey"))

    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    per_unit = F.floor(cents / F.col("l_quantity").cast("bigint")).cast("decimal(16,0)")
    key = F.md5(F.concat_ws(
        "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").cast("string"), cents.cast("string")))
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (
        F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return lines.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.col("p_name").alias("product"),
        F.col("p_type").alias("category"),
        F.col("r_name").alias("region"),
        F.col("l_quantity").alias("quantity"),
        (per_unit * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("price"),
        (F.col("l_discount") + F.lit(0.0)).alias("discount"),
        net.cast("decimal(18,4)").alias("sales"),
        key.alias("h"),
    )


def _digit(start: int, below: str, length: int = 2) -> Column:
    return F.substring("h", start, length) < below


def retail_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """``retail_fact`` as text with gaps, padding, currency signs and repeated rows."""
    fact = retail_fact(spark, folder)
    price, sales = F.col("price").cast("string"), F.col("sales").cast("string")
    null = F.lit(None)
    once = fact.select(
        "order_id", "customer_id",
        F.when(_digit(1, "05"), null)
        .otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
        F.when(_digit(3, "08"), F.concat(F.lit("  "), F.upper("product"), F.lit(" ")))
        .otherwise(F.col("product")).alias("product"),
        F.when(_digit(5, "06"), null).when(_digit(5, "08"), F.lit("nan"))
        .otherwise(F.col("category")).alias("category"),
        F.when(_digit(7, "06"), null)
        .when(_digit(7, "13"), F.concat(F.lit("  "), F.upper("region"), F.lit("  ")))
        .otherwise(F.col("region")).alias("region"),
        F.when(_digit(9, "08"), null).when(_digit(9, "0b"), -F.col("quantity"))
        .otherwise(F.col("quantity")).alias("quantity"),
        F.when(_digit(11, "07"), null).when(_digit(11, "11"), F.concat(F.lit("$"), price))
        .when(_digit(11, "14"), F.concat(F.lit("("), price, F.lit(")")))
        .otherwise(price).alias("price"),
        "discount",
        F.when(_digit(13, "05"), null).when(_digit(13, "0f"), F.concat(F.lit("$"), sales))
        .otherwise(sales).alias("sales"),
        "h",
    )
    # A repeated row is emitted twice by the same task: one pass over the joins, not two.
    copies = F.when(_digit(15, "05"), F.lit(2)).otherwise(F.lit(1))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


def event_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Second source: real times of day, no quantity, price, region or product."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("date"), F.col("event_type").alias("category"),
        F.col("value").alias("sales"))


def request_messages(fact: DataFrame) -> DataFrame:
    """A log of plain-text requests, one per order line: (msg_id, text)."""
    count = F.col("quantity").cast("int").cast("string")
    price = F.col("price").cast("string")
    kind = F.substring("h", 3, 1)
    fixed = {
        "0": "Show model metrics", "1": "What are the top products?",
        "2": "What are the top regions?", "3": "help", "6": "Show the monthly trend",
        "8": "Give me a dataset overview", "9": "hello", "a": "   ",
    }
    text = F.concat(
        F.lit("Predict sales for quantity "), count, F.lit(" price "), price,
        F.lit(" category "), "category", F.lit(" region "), "region",
        F.lit(" date "), F.date_format("date", "yyyy-MM-dd"))
    about = F.concat(F.lit("Tell me about "), "category", F.lit(" in "), "region",
                     F.lit(" region"))
    estimate = F.concat(F.lit("Estimate sales for product "), "product", F.lit(" in "), "region",
                        F.lit(" region"))
    loose = F.concat(F.lit("Qty = "), count, F.lit(" unit  price: $"), price,
                     F.lit(" hour 14 purchase count 7"))
    message = F.when(kind == "4", about).when(kind == "5", estimate).when(kind == "7", loose)
    for digit, words in fixed.items():
        message = message.when(kind == digit, F.lit(words))
    return fact.select(F.col("h").alias("msg_id"), message.otherwise(text).alias("text"))
