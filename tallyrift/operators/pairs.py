"""Bounds and measures of pairs of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.operators.encode import with_rtu


def pair_rows(base: DataFrame, *also: str) -> DataFrame:
    """A row for each two items of a transaction, i1 < i2, from the transaction's own array."""
    each = F.struct("item", "u", "p")
    rows = base.groupBy("tid", *also).agg(F.array_sort(F.collect_list(each)).alias("a"))
    rows = rows.select("tid", *also, "a", F.posexplode("a").alias("i", "x"))
    rows = rows.select("tid", *also, "x", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("y"))
    return rows.select(
        "tid", *also, F.col("x.item").alias("i1"), F.col("y.item").alias("i2"),
        (F.col("x.u") + F.col("y.u")).alias("u"), (F.col("x.p") * F.col("y.p")).alias("p"),
    )


def pair_bounds(base: DataFrame) -> DataFrame:
    """i1, i2, bound: no itemset with both items has a larger expected utility."""
    return pair_rows(with_rtu(base), "rtu").groupBy("i1", "i2").agg(F.sum(F.col("rtu") * F.col("p")).alias("bound"))


def promising_pairs(bounds: DataFrame, threshold: float) -> DataFrame:
    return bounds.where(F.col("bound") >= threshold).select("i1", "i2")
