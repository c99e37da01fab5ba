"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if the cluster names it, else a folder in the warehouse, which must be shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all machines share")
    return warehouse + "/_stash"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: the lineage ends at files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def clear(spark: SparkSession) -> None:
    """Remove all tables that ``stash`` wrote in this session and that nobody has removed."""
    remove(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's paths lead."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
