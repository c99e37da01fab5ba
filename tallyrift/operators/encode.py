"""From transactions and profits to the ranked base of the search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.functions.measures import existential_probability, expected_utility, positive, utility
from tallyrift.sources.shared import remove, stash
from tallyrift.sources.tables import TASK_ROWS, dealt


def priced(transactions: DataFrame, profits: DataFrame, unpriced: str = "exclude") -> DataFrame:
    """tid, item, quantity, profit, u, p of items that may occur. ``unpriced``: exclude or zero.

    The profit table is broadcast only if Spark's size threshold allows.
    """
    if unpriced not in ("exclude", "zero"):
        raise ValueError(f"unpriced: {unpriced}")
    joined = transactions.where("prob > 0").join(profits, "item", "left" if unpriced == "zero" else "inner")
    joined = joined.withColumn("profit", F.coalesce("profit", F.lit(0.0)))
    return joined.select("tid", "item", "quantity", "profit", utility().alias("u"), F.col("prob").alias("p"))


def transaction_utility(base: DataFrame) -> DataFrame:
    """tid, rtu, ptu, ntu: the sums of a transaction's positive utilities (twice named) and of the others."""
    return base.groupBy("tid").agg(
        F.sum(positive(F.col("u"))).alias("rtu"), F.sum(positive(F.col("u"))).alias("ptu"), F.sum(F.least("u", F.lit(0.0))).alias("ntu")
    )


def with_rtu(base: DataFrame) -> DataFrame:
    """The rows with their transaction's rtu: a window instead of a sum and a join, one shuffle by tid."""
    return base.withColumn("rtu", F.sum(positive(F.col("u"))).over(Window.partitionBy("tid")))


def measured_items(rows: DataFrame) -> DataFrame:
    """item, its bounds and its own measures (eu, ep), in one pass over rows with their rtu."""
    return rows.groupBy("item").agg(
        F.sum("rtu").alias("rtwu"), F.sum(F.col("rtu") * F.col("p")).alias("rtwu_weighted"), F.sum("p").alias("support"), F.count("*").alias("frequency"),
        expected_utility().alias("eu"), existential_probability().alias("ep"),
    )


def item_bounds(base: DataFrame) -> DataFrame:
    """item, rtwu, rtwu_weighted, support (expected), frequency: bounds on all itemsets with the item."""
    return measured_items(with_rtu(base)).select("item", "rtwu", "rtwu_weighted", "support", "frequency")


#: So many narrow rows at most are numbered by one task.
FEW_ROWS = 100_000


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """The rows with their place from 0 in the order given, which must be total: counted within ranges, then shifted by the ranges before.

    Ranges hold about as many rows each, so no task numbers all of them. They are written to the shared folder, as both
    passes must see the same ones. Up to ``FEW_ROWS`` rows are one range.
    """
    rows = stash(rows, "to-number")
    count = rows.count()
    if count <= FEW_ROWS:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    parts = max(math.ceil(count / TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stash(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    remove(rows.sparkSession, rows.stash_path)
    sizes = ranged.groupBy("_range").count()  # a row for each range
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt(ranged, count, "_range").withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_own") + F.col("_before")).select(*rows.columns, name)


def item_ranks(bounds: DataFrame, by: str = "rtwu_weighted") -> DataFrame:
    """item, bound, rank: ascending bound, then item, from 0."""
    return numbered(bounds.select("item", F.col(by).alias("bound")), "rank", "bound", "item").withColumn("rank", F.col("rank").cast("int"))


def promising(bounds: DataFrame, by: str = "rtwu_weighted", threshold: float = 0.0, min_support: float = 0.0) -> DataFrame:
    """Items whose bound is above zero and reaches the threshold, and whose expected support reaches ``min_support``."""
    return bounds.where((F.col(by) > 0) & (F.col(by) >= threshold) & (F.col("support") >= min_support))


def with_remaining(ranked: DataFrame, *order: str) -> DataFrame:
    """rem: the positive utility of the transaction's items that come later in the order (by rank, if none is given)."""
    after = Window.partitionBy("tid").orderBy(*(order or ("rank",))).rowsBetween(1, Window.unboundedFollowing)
    return ranked.withColumn("rem", F.coalesce(F.sum(positive(F.col("u"))).over(after), F.lit(0.0)))


def ranked_base(base: DataFrame, ranks: DataFrame) -> DataFrame:
    """tid, item, rank, bound, u, p, rem."""
    return with_remaining(base.join(ranks, "item").select("tid", "item", "rank", "bound", "u", "p"))


def as_rows(base: DataFrame) -> DataFrame:
    """A row for each transaction: t, its items with their u and p, and rtu. A transaction that has an item twice is an error."""
    rows = base.groupBy("tid").agg(F.collect_list(F.struct("item", "u", "p")).alias("t"), F.sum(positive(F.col("u"))).alias("rtu"))
    twice = F.raise_error(F.concat(F.lit("a transaction has an item twice: "), F.col("tid").cast("string"))).cast("double")
    return rows.withColumn("rtu", F.when(F.size("t") > F.size(F.array_distinct("t.item")), twice).otherwise(F.col("rtu")))


def items_of(rows: DataFrame) -> DataFrame:
    """The items of ``as_rows`` again, a row each: tid, rtu, item, u, p."""
    return rows.select("tid", "rtu", F.inline("t"))


def as_tails(ranked: DataFrame, *order: str) -> DataFrame:
    """A row for each transaction: lists of its items, their u, p, rem and bounds, in the order given (by rank, if none is).

    t_rem is the positive utility of the items after each, t_rtu that of all. From here on itemsets grow within their row, so no
    level of the search shuffles by transaction.
    """
    each = F.struct(*(order or ("rank",)), *[c for c in ("item", "u", "p", "bound") if c not in order])
    rows = ranked.groupBy("tid").agg(F.array_sort(F.collect_list(each)).alias("t"), F.sum(positive(F.col("u"))).alias("t_rtu"))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("rem"))
    step = lambda s, x: F.struct((s["sum"] + positive(x["u"])).alias("sum"), F.array_prepend(s["rem"], s["sum"]).alias("rem"))
    rem = F.aggregate(F.reverse("t"), start, step, lambda s: s["rem"])
    return rows.select("tid", *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("item", "u", "p", "bound")], rem.alias("t_rem"), "t_rtu")
