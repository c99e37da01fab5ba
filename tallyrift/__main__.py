"""python -m tallyrift DATABASE PROFITS K LEAST_PROBABILITY [--out PATH]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyrift.plans.mine import mine
from tallyrift.sources import results, shared, tables, text


def main(args: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="tallyrift")
    parser.add_argument("database")
    parser.add_argument("profits")
    parser.add_argument("k", type=int)
    parser.add_argument("least_probability", type=float)
    parser.add_argument("--out")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tallyrift").getOrCreate()
    tx = tables.validate(text.parse_transactions(text.read_files(spark, given.database))).persist()
    profits = text.parse_profits(text.read_files(spark, given.profits))
    size = tx.agg(F.countDistinct("tid"), F.countDistinct("item")).first()
    mined = mine(tx, profits, given.k, given.least_probability)
    out = [results.configuration(size[0], size[1], given.k, given.least_probability, spark.sparkContext.defaultParallelism)]
    out += [results.progress(x) for x in mined.levels] + list(results.ranked(mined))
    print("\n".join(out))
    if given.out:
        results.save(mined.frame(spark), given.out)
    tx.unpersist()
    shared.clear(spark)
    return out


if __name__ == "__main__":
    main()
