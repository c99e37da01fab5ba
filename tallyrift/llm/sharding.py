"""Sharding by extendible hashing: only buckets over the byte limit split on another hash bit.

Null texts have no bytes. Repeated rows have the same hash and stay together; a bucket whose rows
all share one hash can't split, and is marked ``oversized`` if it is over the limit, as is a row
that alone is over it. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stash


def shard_directory(sizes: DataFrame, limit: int, step: int = 10, bits: int = 60) -> DataFrame:
    """The directory's buckets: depth, prefix (the ``depth`` leading bits), bytes, rows, oversized.

    ``sizes``: hash (long, ``bits`` bits used), bytes, rows. Each pass sums the bytes of the rows
    still undecided by ``step`` further bits, a partial sum before the shuffle; all depths between
    follow from that table. Only buckets over the limit go on to the next pass, so there are about
    log2(total / limit) / step passes, and each splits only what is too large.
    """
    found, depth, left = [], 0, sizes
    while True:
        deep = min(depth + step, bits)
        at = lambda d, c="hash": F.shiftrightunsigned(F.col(c), bits - d) if d else F.lit(0).cast("long")
        fine = stash(
            left.groupBy(at(deep).alias("fine")).agg(
                F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"),
                F.min("hash").alias("lo"), F.max("hash").alias("hi"),
            ),
            "shard-sums",
        )
        # The sums at every depth of this pass, from the finest table: at most step + 1 copies of its rows.
        depths = F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth")
        sums = (
            fine.select("*", depths)
            .withColumn("prefix", F.expr(f"shiftrightunsigned(fine, {deep} - depth)"))
            .groupBy("depth", "prefix")
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .withColumn("one", F.col("lo") == F.col("hi"))
            .withColumn("ends", (F.col("bytes") <= limit) | F.col("one") | (F.col("depth") == bits))
        )
        # A bucket ends at the first depth where it fits: it does, and its parent does not.
        parent = sums.where("not ends").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        inner = sums.where(F.col("ends") & (F.col("depth") > depth)).withColumn("up", F.shiftrightunsigned("prefix", 1))
        leaves = inner.join(parent, ["depth", "up"], "left_semi").drop("up").unionByName(
            sums.where(F.col("ends") & (F.col("depth") == depth))
        )
        leaves = stash(
            leaves.select("depth", "prefix", "bytes", "rows", (F.col("bytes") > limit).alias("oversized")), "shard-leaves"
        )
        found.append(leaves)
        open_ = stash(sums.where(~F.col("ends") & (F.col("depth") == deep)).select(F.col("prefix").alias("_open")), "shard-open")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)
        left = left.join(open_, at(deep) == F.col("_open"), "left_semi")
        # The buckets of the pass that stay open are the roots of the next one.
        depth = deep
        left = left.select("hash", "bytes", "rows")


def shard_rows(
    docs: DataFrame, limit: int, key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", bits: int = 60
) -> DataFrame:
    """``key_cols``, bytes, depth, prefix, shard_id (the prefix's bits), shard_bytes, oversized for each row."""
    rows = docs.select(
        *[F.col(f"`{c}`") for c in key_cols],
        F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in key_cols]), 64 - bits).alias("hash"),
        F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("rows"),
    )
    rows = stash(rows, "shard-rows")
    buckets = stash(shard_directory(rows.select("hash", "bytes", "rows"), limit, bits=bits), "shard-buckets")
    depths = sorted(r[0] for r in buckets.select("depth").distinct().limit(bits + 1).collect())
    # The directory: each row looks its prefix up at every depth that has buckets; just one of them is there.
    tried = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")))
    tried = tried.withColumn("prefix", F.expr(f"if(depth = 0, 0L, shiftrightunsigned(hash, {bits} - depth))"))
    return tried.drop("rows").join(buckets.withColumnRenamed("bytes", "shard_bytes").drop("rows"), ["depth", "prefix"]).select(
        *[F.col(f"`{c}`") for c in key_cols], "bytes", "depth", "prefix",
        F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))").alias("shard_id"), "shard_bytes", "oversized",
    )


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, key: str = "doc_id") -> None:
    """The rows of ``docs`` by shard, a folder each; every shard fits the limit, so it is one task's work.

    A shard is looked up by the hash of the key, each hash once: rows that repeat a key stay as many as they are,
    in the same shard, and rows without a key have a hash as well.
    """
    of = F.xxhash64(F.col(f"`{key}`")).alias("__hash")
    known = sharded.select(of, F.concat(F.lit("b"), "shard_id").alias("shard_id")).distinct()
    out = docs.withColumn("__hash", of).join(known, "__hash").drop("__hash")
    out.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
