"""Records of experiment runs: scanning program output, reading, writing, finding the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a run prints, by metric: pattern and type.
METRICS = {
    "execution_time": (r"Execution time:\s*(\d+)\s*ms", "bigint"),
    "database_size": (r"Database size:\s*(\d+)", "bigint"),
    "num_items": (r"Number of items:\s*(\d+)", "bigint"),
    "items_after_filter": (r"Items after filtering:\s*(\d+)", "bigint"),
    "candidates_generated": (r"Candidates generated:\s*(\d+)", "bigint"),
    "utility_lists_created": (r"Utility lists created:\s*(\d+)", "bigint"),
    "rtwu_pruned": (r"RTWU pruned:\s*(\d+)", "bigint"),
    "branches_pruned": (r"Branches pruned:\s*(\d+)", "bigint"),
    "bulk_branches_pruned": (r"Bulk branches pruned:\s*(\d+)", "bigint"),
    "eu_remaining_pruned": (r"EU\+remaining pruned:\s*(\d+)", "bigint"),
    "ep_pruned": (r"Existential probability pruned:\s*(\d+)", "bigint"),
    "total_pruned": (r"Total pruned:\s*(\d+)", "bigint"),
    "peak_memory_reported": (r"Peak memory usage:\s*(\d+)\s*MB", "bigint"),
    "topk_found": (r"Top-K found:\s*(\d+)", "bigint"),
    "final_threshold": (r"Final threshold:\s*([\d.]+)", "double"),
    "successful_updates": (r"Successful updates:\s*(\d+)", "bigint"),
    "cas_retries": (r"CAS retries:\s*(\d+)", "bigint"),
    "cas_efficiency": (r"CAS efficiency:\s*([\d.]+)%", "double"),
    "thread_pool_size": (r"Thread pool size:\s*(\d+)", "bigint"),
}


def scan_metrics(outputs: DataFrame, text_col: str = "output") -> DataFrame:
    """A column for each metric, null if it isn't printed, and what follows from them."""
    text = F.col(text_col)

    def one(pattern: str, kind: str) -> Column:
        found = F.regexp_extract(text, f"(?i){pattern}", 1)
        return F.when(found != "", found.try_cast(kind))

    return derived(outputs.withColumns({name: one(*m) for name, m in METRICS.items()}))


def derived(runs: DataFrame) -> DataFrame:
    """pruning_ratio, pruning_percentage and transactions_per_second, null where they have no meaning."""
    ratio = F.when(F.col("candidates_generated") > 0, F.col("total_pruned") / F.col("candidates_generated"))
    seconds = F.col("execution_time") / 1000
    return runs.withColumns({
        "pruning_ratio": ratio, "pruning_percentage": ratio * 100,
        "transactions_per_second": F.when(seconds > 0, F.col("database_size") / seconds),
    })


def combined(*parts: DataFrame) -> DataFrame:
    """Rows with differing columns as one table, columns in order of name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def save(runs: DataFrame, path: str) -> None:
    runs = runs.select(*sorted(runs.columns))
    runs.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    runs.write.mode("overwrite").json(f"{path}/json")


def load(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """Successful runs only; the schema is given, not inferred. Columns of CSV go by the names of its header, in whatever order; one that isn't there is null."""
    if kind == "json":
        return successful(spark.read.schema(schema).json(f"{path}/json"))
    said = spark.read.option("header", True).csv(f"{path}/csv")  # all text: nothing but the header is read for it
    fields = StructType.fromDDL(schema).fields
    return successful(said.select(*[(F.col(f"`{f.name}`") if f.name in said.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]))


def append(rows: DataFrame, path: str, batch: int) -> None:
    """Add a batch of records to a growing table. A batch that is written again replaces itself, so a job that is repeated adds nothing twice."""
    rows.write.mode("overwrite").json(f"{path}/batch={batch}")


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of all batches that were written to their end, which Spark's mark in each says, with their number in ``batch``."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    marks = at.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(at) or []
    whole = sorted(m.getPath().getParent().toString() for m in marks)
    if not whole:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).json(whole)


def successful(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "SUCCESS")


def newest(files: DataFrame, path_col: str = "path", time_col: str = "modified") -> DataFrame:
    """path of the newest of some files."""
    return files.agg(F.max_by(path_col, F.struct(time_col, path_col)).alias("path"))


def newest_path(spark: SparkSession, pattern: str) -> str | None:
    """The newest file that a pattern matches, by Spark's own listing; the files' contents aren't read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"))
    return newest(files).first()[0]


def synthetic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made from orders by fixed rules, for the reports' queries."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.selectExpr(
        "o_orderkey as run",
        "case when o_orderkey % 17 = 0 then 'TIMEOUT' when o_orderkey % 23 = 0 then 'FAILED' else 'SUCCESS' end as status",
        "element_at(array('chess', 'mushroom', 'retail', 'kosarak'), cast(o_custkey % 4 + 1 as int)) as dataset",
        "element_at(array(5, 50, 100, 500, 1000), cast(o_orderkey % 5 + 1 as int)) as k",
        "element_at(array(0.00001d, 0.005d, 0.01d, 0.1d, 0.5d), cast(o_orderkey div 5 % 5 + 1 as int)) as min_prob",
        "o_totalprice / 100 as execution_time_ms",
        "cast(floor(o_totalprice / 100) as bigint) as execution_time",
        "(o_custkey % 4 + 1) * 1000 as database_size",
        "o_custkey % 50 + 10 as num_items",
        "o_custkey % 1000 + 1 as candidates_generated",
        "o_orderkey % 700 as rtwu_pruned", "o_orderkey % 300 as branches_pruned", "o_orderkey % 90 as bulk_branches_pruned",
        "o_orderkey % 110 as eu_remaining_pruned", "o_orderkey % 70 as ep_pruned",
        "o_orderkey % 700 + o_orderkey % 300 + o_orderkey % 90 + o_orderkey % 110 + o_orderkey % 70 as total_pruned",
        "100 + o_totalprice / 1000 as peak_memory_mb",
        "cast(50 + o_custkey % 50 as double) as cas_efficiency",
        "element_at(array(2, 4, 8, 16), cast(o_orderkey % 4 + 1 as int)) as thread_pool_size",
    )


RUNS_SQL = """runs as (
  select o_orderkey as run,
    case when o_orderkey % 17 = 0 then 'TIMEOUT' when o_orderkey % 23 = 0 then 'FAILED' else 'SUCCESS' end as status,
    ['chess', 'mushroom', 'retail', 'kosarak'][o_custkey % 4 + 1] as dataset,
    [5, 50, 100, 500, 1000][o_orderkey % 5 + 1] as k,
    [0.00001::double, 0.005, 0.01, 0.1, 0.5][o_orderkey // 5 % 5 + 1] as min_prob,
    o_totalprice / 100 as execution_time_ms, floor(o_totalprice / 100)::bigint as execution_time,
    (o_custkey % 4 + 1) * 1000 as database_size, o_custkey % 50 + 10 as num_items, o_custkey % 1000 + 1 as candidates_generated,
    o_orderkey % 700 as rtwu_pruned, o_orderkey % 300 as branches_pruned, o_orderkey % 90 as bulk_branches_pruned,
    o_orderkey % 110 as eu_remaining_pruned, o_orderkey % 70 as ep_pruned,
    o_orderkey % 700 + o_orderkey % 300 + o_orderkey % 90 + o_orderkey % 110 + o_orderkey % 70 as total_pruned,
    100 + o_totalprice / 1000 as peak_memory_mb, (50 + o_custkey % 50)::double as cas_efficiency,
    [2, 4, 8, 16][o_orderkey % 4 + 1] as thread_pool_size
  from orders),
good as (
  select *, total_pruned / candidates_generated as pruning_ratio, total_pruned / candidates_generated * 100 as pruning_percentage,
    case when execution_time > 0 then database_size / (execution_time / 1000) end as transactions_per_second
  from runs where status = 'SUCCESS')
"""
