"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in tests,
    a folder in the warehouse (which is shared as well) takes its place; on a cluster
    a warehouse that only one machine sees is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all machines share")
    return warehouse + "/_stash"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    A lost executor loses nothing, as the files outlive it, and later reads prune columns.
    ``release`` removes a table that nothing reads any more, ``clear_stash`` all of a session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Remove the files of tables that ``stash`` returned, once all that was made from them is written."""
    for t in tables:
        _remove(t.sparkSession, t.stash_path)


def clear_stash(spark: SparkSession) -> None:
    """Remove every table that ``stash`` wrote in this session."""
    _remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with, for each name of ``sums``, that column summed up from the first row in the order to this one.

    The order must be total, but for rows that are alike. Rows are cut into ranges of it of about the same size,
    each summed up by itself and shifted by what the ranges before it have, so no task sees all rows. The ranges
    are written to the shared folder, as both passes must see the same ones; ``release`` the result in the end.
    """
    given = rows.select("*", *[v.alias(f"_of_{n}") for n, v in sums.items()], *[o.alias(f"_by_{i}") for i, o in enumerate(order)])
    keys = [F.col(f"_by_{i}").asc_nulls_last() for i in range(len(order))]
    ranged = stash(given.repartitionByRange(partitions(rows.sparkSession), *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    # A row for each range, of which there are as many as shuffle partitions.
    whole = ranged.groupBy("_range").agg(*[F.sum(f"_of_{n}").alias(n) for n in sums])
    before = whole.select("_range", *[(F.sum(n).over(Window.orderBy("_range")) - F.col(n)).alias(f"_before_{n}") for n in sums])
    own = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(F.broadcast(before), "_range").select(
        *[F.col(f"`{c}`") for c in rows.columns], *[(F.sum(f"_of_{n}").over(own) + F.col(f"_before_{n}")).alias(n) for n in sums]
    )
    out.stash_path = ranged.stash_path
    return out
