"""Exact quantiles of any number of values: range counts find the range that holds a rank, only that range is looked into.

Equal values become one row with its count before they are sorted, so a value that most rows have is no
task of its own; the rest is cut into ranges of key and value. Counts by range and key, of which there are
no more than ranges and keys together, say in which range of its key a rank lies and how far in.
No task or buffer holds all values of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.sources.shared import stash


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key a column for each of ``shares``, and n: what lies at that share of the way from the least to the largest value, in between if no row does.

    Null and NaN values are left out; a key that has no others has no row. A null key is a key.
    """
    names = list(shares)
    of = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    given = rows.where(F.col(f"`{value}`").isNotNull() & ~F.isnan(F.col(f"`{value}`").cast("double")))
    own = [f"_k{i}" for i in range(len(keys))] + [f"_none{i}" for i in range(len(keys))]
    none = [F.col(f"`{k}`").isNull().alias(f"_none{i}") for i, k in enumerate(keys)]
    same = given.select(*of, *none, F.lit(0).alias("_all"), F.col(f"`{value}`").cast("double").alias("v"), *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)])
    by = ["_all", *own]
    counted = same.groupBy(*by, "v").agg(F.count("*").alias("n"), *[F.first(f"_key{i}").alias(f"_key{i}") for i in range(len(keys))])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(counted.repartitionByRange(parts, *by, "v").withColumn("_range", F.spark_partition_id()), "value-ranges")
    bins = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("n")
    bins = bins.withColumn("_before", before).withColumn("_total", F.sum("n").over(Window.partitionBy(*by)))
    # Both neighbours of each share's place, counted from 0.
    places = F.array(*[F.struct(F.lit(c).alias("name"), (F.lit(float(q)) * (F.col("_total") - 1)).alias("at")) for c, q in shares.items()])
    wanted = bins.select(*by, "_range", "n", "_before", "_total", F.inline(places))
    wanted = wanted.select("*", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    wanted = wanted.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("n"))).drop("n")
    # What is left of the ranges: those with a rank that is asked for.
    inside = ranged.join(wanted.select(*by, "_range").distinct(), [*by, "_range"], "left_semi")
    ends = F.sum("n").over(Window.partitionBy(*by, "_range").orderBy("v"))
    found = inside.withColumn("_end", ends).join(wanted, [*by, "_range"])
    rank = F.col("rank") - F.col("_before")
    found = found.where((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("n")))
    lo, hi = F.min("v"), F.max("v")
    one = found.groupBy(*by, "name").agg((lo + (hi - lo) * (F.first("at") - F.floor(F.first("at")))).alias("x"), F.first("_total").alias("n"), *[F.first(f"_key{i}").alias(f"_key{i}") for i in range(len(keys))])
    wide = one.groupBy(*by, "n").agg(*[F.first(f"_key{i}").alias(f"_key{i}") for i in range(len(keys))], *[F.max(F.when(F.col("name") == c, F.col("x"))).alias(c) for c in names])
    return wide.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], "n", *names)


QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
#: A fixed value: so many times the distance of the quartiles, whiskers reach at most.
REACH = 1.5


def _fenced(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows with their key's quartiles and whether they lie beyond the whiskers."""
    found = quantiles(rows, [key], value, QUARTILES).select(F.col(f"`{key}`").alias("_of"), "q1", "q2", "q3")
    met = rows.where(F.col(f"`{value}`").isNotNull()).join(found, F.col(f"`{key}`").eqNullSafe(F.col("_of")))
    reach = (F.col("q3") - F.col("q1")) * REACH
    return met.withColumn("_beyond", (F.col(f"`{value}`") < F.col("q1") - reach) | (F.col(f"`{value}`") > F.col("q3") + reach))


def box_plot(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, q1, q2, q3, the ends of the whiskers (the last values within reach), the number of outliers, least and largest."""
    inner = F.when(~F.col("_beyond"), F.col(f"`{value}`"))
    by = _fenced(rows, key, value).groupBy(key)
    return by.agg(
        *[F.first(q).alias(q) for q in QUARTILES], F.min(inner).alias("whisker_low"), F.max(inner).alias("whisker_high"), F.count_if("_beyond").alias("outliers"),
        F.min(value).alias("least"), F.max(value).alias("largest"),
    )


def outliers(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows that a box plot shows as points of their own."""
    return _fenced(rows, key, value).where("_beyond").select(*[F.col(f"`{c}`") for c in rows.columns])
