"""Text sources: a profit table (``item profit``) and an uncertain database (``item:quantity:probability`` tokens).

Both parsers take a DataFrame of lines (line_no, value), so they work on files and on streams of
lines alike; ``read_lines`` numbers the lines of files in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no and value. The number is given before anything is exploded.

    Numbers rise with the lines of a file. Of several files Spark decides which comes first; ``read_files`` orders them.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """line_no and value of all lines of some files: 0, 1, ... without gaps, files in the order of their names.

    So a later line wins over an earlier one across files as within one. Spark reads files in splits; each is counted
    once, and its lines are numbered behind those of the splits before, of which there are as many as tasks.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    splits = rows.groupBy("_file", "_from").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.orderBy("_file", "_from")) - F.col("_lines")
    met = rows.join(F.broadcast(splits.withColumn("_before", before)), ["_file", "_from"])
    return met.select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value")


def parse_profits(lines: DataFrame) -> DataFrame:
    """item, profit. Only lines of two fields count; of an item's lines the last wins."""
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.where(F.size(fields) == 2).select("line_no", fields[0].cast("int").alias("item"), fields[1].cast("double").alias("profit"))
    return rows.groupBy("item").agg(F.max_by("profit", "line_no").alias("profit"))


def parse_transactions(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """tid, item, quantity, prob, one row for each item of a transaction.

    A token has three parts once empty parts at its end are dropped; others are skipped. An item that
    occurs twice on a line counts as its last token says. A line without any such token is no
    transaction. Numbers that can't be read raise an error, or are skipped if ``lenient``. ``tid``
    rises with the lines; ``dense_tids`` numbers them from 1.
    """
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    exploded = lines.select(F.col("line_no").alias("tid"), F.posexplode(tokens).alias("pos", "token"))
    parts = exploded.withColumn("parts", F.split(F.regexp_replace("token", ":+$", ""), ":", -1)).where("size(parts) = 3")
    to = (lambda c, t: c.try_cast(t)) if lenient else (lambda c, t: c.cast(t))
    rows = parts.select(
        "tid", "pos", to(F.col("parts")[0], "int").alias("item"), to(F.col("parts")[1], "int").alias("quantity"), to(F.col("parts")[2], "double").alias("prob")
    )
    if lenient:
        rows = rows.where("item is not null and quantity is not null and prob is not null")
    last = F.max_by(F.struct("quantity", "prob"), "pos").alias("_last")
    return rows.groupBy("tid", "item").agg(last).select("tid", "item", "_last.quantity", "_last.prob")


def dense_tids(transactions: DataFrame) -> DataFrame:
    """The same rows with tids 1, 2, ... in order: numbered within ranges of tids, then shifted by the ranges before.

    Ranges hold about as many tids each, so no task numbers all of them.
    """
    from tallyrift.operators.encode import numbered

    dense = numbered(transactions.select("tid").distinct(), "_dense", "tid")
    return transactions.join(dense, "tid").select((F.col("_dense") + 1).alias("tid"), *[c for c in transactions.columns if c != "tid"])


def write_transactions(transactions: DataFrame, path: str) -> None:
    """The text form again, a line for each transaction, items in order."""
    token = F.concat_ws(":", "item", "quantity", "prob")
    rows = transactions.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("item", token.alias("t")))).alias("ts"))
    rows.orderBy("tid").select(F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("value")).write.text(path)
