"""Mining a stream: each micro-batch joins a sliding set of transactions, which is mined again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyrift.plans.mine import Mined, mine
from tallyrift.sources.shared import remove


def remine(
    transactions: DataFrame, profits: DataFrame, store: str, k: int, min_pro: float, window: int, on_result: Callable[[int, Mined], None], **options
) -> StreamingQuery:
    """Start a query that appends each batch to ``store`` and mines the last ``window`` tids.

    Batches are written to a folder of their number, so that one that runs again replaces itself, and the
    largest tid of each is kept beside them. Only batches that reach into the window are read; others are removed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        own = spark.read.schema(rows.schema).parquet(f"{store}/batch={number}").agg(F.max("tid").alias("last"))
        own.where("last is not null").write.mode("overwrite").parquet(f"{store}-last/batch={number}")
        # A row for each batch that is still there.
        last = {r["batch"]: r["last"] for r in spark.read.schema("last long, batch long").parquet(f"{store}-last").collect()}
        if not last:
            return
        since = max(last.values()) - window
        live = [f"{store}/batch={b}" for b, top in last.items() if top > since]
        on_result(number, mine(spark.read.schema(rows.schema).parquet(*live).where(F.col("tid") > since), profits, k, min_pro, **options))
        for b, top in last.items():
            if top <= since:
                for path in (f"{store}-last/batch={b}", f"{store}/batch={b}"):
                    remove(spark, path)

    return transactions.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", f"{store}-state").start()


def running_bounds(transactions: DataFrame, profits: DataFrame) -> DataFrame:
    """item, support, eu of a stream of transactions: sums that go on from batch to batch."""
    from tallyrift.operators.encode import priced

    return priced(transactions, profits).groupBy("item").agg(F.sum("p").alias("support"), F.sum(F.col("u") * F.col("p")).alias("eu"))


def sliding_bounds(transactions: DataFrame, profits: DataFrame, width: int, slide: int, late: int = 0) -> DataFrame:
    """since, until, item, support, eu of a stream of transactions over each ``width`` tids, a new stretch beginning every ``slide``.

    Tids stand for event time, so Spark's windows and watermark do the work: a stretch is put out once tids beyond its end (and
    ``late`` more) have come, and its state goes then. What comes later than that is left out.
    """
    from tallyrift.operators.encode import priced

    timed = priced(transactions, profits).withColumn("_at", F.timestamp_seconds("tid")).withWatermark("_at", f"{late} seconds")
    sums = timed.groupBy(F.window("_at", f"{width} seconds", f"{slide} seconds").alias("_stretch"), "item").agg(F.sum("p").alias("support"), F.sum(F.col("u") * F.col("p")).alias("eu"))
    return sums.select(F.unix_seconds("_stretch.start").alias("since"), F.unix_seconds("_stretch.end").alias("until"), "item", "support", "eu")
