import random

import pytest
from helpers import brute

from tallyrift.operators import reports
from tallyrift.plans import sweep as sweeps
from tallyrift.plans.metering import Meter
from tallyrift.sources import runs

TX = "tid long, item int, quantity int, prob double"


@pytest.fixture(scope="module")
def data():
    r = random.Random(4)
    rows = [(t, i, r.randint(1, 9), r.choice([0.2, 0.5, 0.9, 1.0])) for t in range(30) for i in r.sample(range(1, 8), r.randint(1, 4))]
    return rows, {i: float(r.choice([-6, -2, 1, 3, 7])) for i in range(1, 8)}


def of(data):
    rows, profits = data
    return lambda spark: (spark.createDataFrame(rows, TX), spark.createDataFrame(list(profits.items()), "item int, profit double"))


def missing(spark):
    return spark.read.schema(TX).parquet("/no/such/path"), None


def broken(spark):
    from pyspark.sql import functions as F

    tx = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 1, 0.5)], TX)
    return tx, tx.select("item", F.lit(1.0).alias("profit")).distinct()


def test_grid_is_recorded(spark, data, tmp_path):
    told = []
    args = ({"small": of(data), "none": missing}, (3, 8), (0.1, 0.7))
    found = sweeps.sweep(spark, *args, parallel=2, store=str(tmp_path / "runs"), on_record=told.append)
    rows = {(r.dataset, r.k, r.min_prob): r for r in found.collect()}
    assert len(rows) == len(told) == 8 and {r.status for (d, _, _), r in rows.items() if d == "none"} == {"SKIPPED"}
    for (d, k, p), r in rows.items():
        if d == "small":
            want = brute(*data, k, p)
            assert r.status == "SUCCESS" and r.topk_found == len(want) and r.database_size == 30 and r.execution_time_ms > 0 and r.peak_memory_mb > 0 and r.cpu_time_ms > 0
            assert r.final_threshold == pytest.approx(want[-1][1] if len(want) == k else 0.0) and r.total_pruned == r.rtwu_pruned + r.branches_pruned + r.eu_remaining_pruned + r.ep_pruned
    # Reports stand on the records as they are.
    assert reports.status_counts(found).first().success == 4
    assert reports.averages(runs.successful(found)).count() == 4
    assert reports.pivot_mean(runs.successful(found), "min_prob", "k", [3, 8], "execution_time_ms", "k").count() == 2
    assert "successful 4" in reports.markdown_report(found)
    # Started again, the sweep has nothing left to do; a longer one does what is new.
    again = []
    assert sweeps.sweep(spark, *args, store=str(tmp_path / "runs"), on_record=again.append).count() == 8 and again == []
    sweeps.sweep(spark, {**args[0], "more": of(data)}, (3, 8), (0.1, 0.7), store=str(tmp_path / "runs"), on_record=again.append)
    assert {r["dataset"] for r in again} == {"more"} and len(again) == 4


def test_runs_of_a_dataset_share_its_sizes_and_profits(spark, data, tmp_path):
    made, read = [], of(data)

    def counted(s):
        made.append(1)
        return read(s)

    found = sweeps.sweep(spark, {"small": counted}, (3, 8), (0.1, 0.7), parallel=2, store=str(tmp_path / "runs")).collect()
    assert len(made) == 1
    assert [(r.status, r.database_size, r.num_items) for r in found] == [("SUCCESS", 30, 7)] * 4


def test_failures_and_timeouts(spark, data, tmp_path):
    found = sweeps.sweep(spark, {"broken": broken}, (3,), (0.0,), store=str(tmp_path / "a")).first()
    assert found.status == "FAILED" and found.error
    late = sweeps.sweep(spark, {"small": of(data)}, (3,), (0.0,), timeout_s=0.05, store=str(tmp_path / "b")).first()
    assert late.status == "TIMEOUT" and late.topk_found is None
    assert sweeps.sweep(spark, {"small": of(data)}, (3,), (0.0,), store=str(tmp_path / "c")).first().status == "SUCCESS"  # nothing stays cancelled


def test_meter_sees_its_own_jobs(spark):
    spark.range(10).count()
    with Meter(spark, "x") as m:
        spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count().collect()
    spark.range(10).count()
    assert 1 <= m.jobs <= 3 and m.shuffled_bytes > 0 and m.cpu_ms >= 0 and m.peak_memory_mb > 0
    with Meter(spark, "y") as none:
        pass
    assert none.jobs == 0 and none.peak_memory_mb == 0
