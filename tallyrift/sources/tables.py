"""Uncertain databases from relational tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many rows are one task's, about, where rows are dealt by transaction or item.
TASK_ROWS = 250_000
#: So many parts at most may be broadcast, some 64 bytes each where they are held.
HELD_PARTS = 2_000_000


def dealt(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """The rows by hash of some columns; ``count``: how many there are. What a task holds doesn't grow with them.

    Left to itself Spark makes as few tasks as there are cores of what it shuffles. A number of partitions that is
    named stays; a few rows need none.
    """
    spark, parts = rows.sparkSession, math.ceil(count / TASK_ROWS)
    if parts <= spark.sparkContext.defaultParallelism:
        return rows.repartition(*by)
    return rows.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def count_lines(spark: SparkSession, sf_dir: str) -> int:
    """How many lines all orders have: the files' footers tell."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def validate(transactions: DataFrame) -> DataFrame:
    """The rows, with an error for a probability that is none; quantities and ids may not be null."""
    wrong = F.col("prob").isNull() | F.isnan("prob") | (F.col("prob") > 1) | F.col("tid").isNull() | F.col("item").isNull() | F.col("quantity").isNull()
    return transactions.withColumn("prob", F.when(wrong, F.raise_error(F.concat(F.lit("not a transaction item: "), F.to_json(F.struct("tid", "item", "prob"))))).otherwise(F.col("prob")))


def of_parts(lines: DataFrame, parts: DataFrame, count: int) -> DataFrame:
    """The lines with what their part has; ``count``: how many lines there are.

    Spark may broadcast ``HELD_PARTS`` parts, but not more, as the driver and each task would hold all of them. Where it doesn't,
    the lines are dealt as the parts are: into tasks that don't grow with their number.
    """
    if count > TASK_ROWS * lines.sparkSession.sparkContext.defaultParallelism:
        parts = dealt(parts, count, "p_partkey")
    if parts.count() > HELD_PARTS:
        parts = parts.hint("merge")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


def from_lines(spark: SparkSession, sf_dir: str, item: str = "brand") -> DataFrame:
    """tid, item, quantity, prob of orders: items are brand numbers or parts, the discount is the doubt."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    count = count_lines(spark, sf_dir)
    if item == "brand":
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("item"))
        lines = of_parts(lines, parts, count)
    else:
        lines = lines.withColumn("item", F.col("l_partkey").cast("int"))
    # Few lines of an order share an item, so sums before a shuffle would save nothing; dealt by order, the rows need no other shuffle later.
    lines = dealt(lines.select("l_orderkey", "item", "l_quantity", "l_discount"), count, "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("tid"), "item").agg(
        F.sum("l_quantity").alias("quantity"), F.max(1 - F.col("l_discount") * 5).alias("prob")
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, item, quantity, prob of users: items are event types by length and first letter."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value")
    item = (F.length("event_type") * 100 + F.ascii("event_type")).cast("int")
    return events.groupBy(F.col("user_id").alias("tid"), item.alias("item")).agg(
        F.count("*").cast("double").alias("quantity"), (F.count_if(F.col("value") > 20) / F.count("*")).alias("prob")
    )


def signed_profits(transactions: DataFrame) -> DataFrame:
    """item, profit: a quarter of the items has a loss."""
    return with_profit(transactions.select("item").distinct())


def with_profit(items: DataFrame) -> DataFrame:
    item = F.col("item")
    return items.select("item", F.when(item % 4 == 0, -1.0 * (item % 7 + 1)).otherwise(item % 9 + 1.0).cast("double").alias("profit"))


def part_profits(spark: SparkSession, sf_dir: str, item: str = "brand") -> DataFrame:
    """The profits of all brands or parts, from the table of parts: the lines need not be read for them."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    of = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") if item == "brand" else F.col("p_partkey").cast("int")
    return with_profit(parts.select(of.alias("item")).distinct())
