"""Sweeps of real runs: datasets by k by least probability by repetition, each run timed, measured and recorded.

Runs are submitted by ``parallel`` threads, each in a scheduler pool of its own, so that with
``spark.scheduler.mode=FAIR`` a long run doesn't hold up short ones. All jobs of a run have a tag, by which
they are cancelled when its time is up. A run's record is written when it ends, in a folder of its number: a
record that is written twice replaces itself, and a sweep that is started again on the same store leaves out
what is recorded already.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.plans.metering import Meter
from tallyrift.plans.mine import Mined, mine
from tallyrift.sources import runs
from tallyrift.sources.shared import remove, shared_dir, stash

#: The settings that a sweep has if none are given.
KS, LEAST_PROBABILITIES, TIMEOUT_S = (5, 50, 100, 500, 1000, 10000), (0.00001, 0.005, 0.01, 0.1, 0.5), 6000.0
RECORD = (
    "run long, status string, dataset string, k int, min_prob double, repetition int, execution_time_ms double, execution_time long, database_size long, num_items long, "
    "items_after_filter long, candidates_generated long, utility_lists_created long, rtwu_pruned long, branches_pruned long, bulk_branches_pruned long, eu_remaining_pruned long, "
    "ep_pruned long, total_pruned long, peak_memory_mb double, topk_found long, final_threshold double, cas_efficiency double, thread_pool_size long, cpu_time_ms long, "
    "shuffled_bytes long, spilled_bytes long, error string"
)
NAMES = [c.split(" ")[0] for c in RECORD.split(", ")]
#: Transactions and profits of a dataset; an error that a path isn't there leaves its runs out as SKIPPED.
Dataset = Callable[[SparkSession], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Run:
    number: int
    dataset: str
    k: int
    min_prob: float
    repetition: int


def grid(datasets: list[str], ks: tuple[int, ...], min_probs: tuple[float, ...], repetitions: int) -> Iterator[Run]:
    number = 0
    for name in datasets:
        for k in ks:
            for p in min_probs:
                for r in range(1, repetitions + 1):
                    number += 1
                    yield Run(number, name, k, p, r)


class _Watch:
    """Cancels the jobs of a tag again and again once the time is up: a search starts further ones between those that were cancelled."""

    def __init__(self, spark: SparkSession, tag: str, seconds: float):
        self.spark, self.tag, self.over = spark, tag, False
        self.ends, self.done = time.monotonic() + seconds, threading.Event()
        self.thread = threading.Thread(target=self._wait, daemon=True)

    def _wait(self) -> None:
        while not self.done.wait(max(0.1, min(1.0, self.ends - time.monotonic()))):
            if time.monotonic() >= self.ends:
                self.over = True
                self.spark.interruptTag(self.tag)

    def check(self, *_: object) -> None:
        if time.monotonic() >= self.ends:
            self.over = True
            raise TimeoutError

    def __enter__(self) -> _Watch:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.done.set()
        self.thread.join()


def counted(mined: Mined) -> dict:
    """A search's counts as those of a record: an item or pair that rules an extension out, an itemset that is not likely, one whose bound is too low."""
    total = lambda name: sum(x[name] for x in mined.levels)
    found = {
        "candidates_generated": total("candidates"), "utility_lists_created": total("candidates"), "rtwu_pruned": total("rtwu_pruned"), "branches_pruned": total("pair_pruned"),
        "bulk_branches_pruned": 0, "eu_remaining_pruned": total("ub_pruned"), "ep_pruned": total("ep_pruned"), "topk_found": len(mined.rows), "final_threshold": mined.threshold,
        "items_after_filter": mined.levels[0]["candidates"] if mined.levels else 0,
    }
    return found | {"total_pruned": sum(found[c] for c in ("rtwu_pruned", "branches_pruned", "eu_remaining_pruned", "ep_pruned"))}


class Known:
    """What is the same for all runs of a dataset, made by its first: its sizes are counted once, and its profits written."""

    def __init__(self, data: Dataset):
        self.data, self.lock, self.found = data, threading.Lock(), None

    def get(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
        with self.lock:
            if self.found is None:
                tx, profits = self.data(spark)
                size = tuple(tx.agg(F.count_distinct("tid"), F.count_distinct("item")).first())
                self.found = (tx, stash(profits, "profits"), size)
            return self.found


def run_one(spark: SparkSession, run: Run, data: Dataset | Known, timeout_s: float, **options) -> dict:
    """The record of one run: SUCCESS, TIMEOUT, FAILED with the error's first line, or SKIPPED if its data isn't there."""
    record = dict.fromkeys(NAMES) | {"run": run.number, "dataset": run.dataset, "k": run.k, "min_prob": run.min_prob, "repetition": run.repetition, "thread_pool_size": spark.sparkContext.defaultParallelism}
    try:
        tx, profits, size = (data if isinstance(data, Known) else Known(data)).get(spark)
    except Exception as e:
        if isinstance(e, AnalysisException) and "PATH_NOT_FOUND" in str(e):
            return record | {"status": "SKIPPED", "error": "no data"}
        return record | {"status": "FAILED", "error": str(e).split("\n")[0]}
    record |= {"database_size": size[0], "num_items": size[1]}
    meter = Meter(spark, f"run {run.number}")
    began = time.perf_counter()
    try:
        with _Watch(spark, meter.tag, timeout_s) as watch, meter:
            mined = mine(tx, profits, run.k, run.min_prob, on_level=watch.check, **options)
        record |= {"status": "SUCCESS", **counted(mined)}
    except Exception as e:
        record |= {"status": "TIMEOUT"} if watch.over else {"status": "FAILED", "error": f"{type(e).__name__}: {e}".split("\n")[0]}
        meter.read()
    spent = (time.perf_counter() - began) * 1000
    measured = {"peak_memory_mb": meter.peak_memory_mb, "cpu_time_ms": meter.cpu_ms, "shuffled_bytes": meter.shuffled_bytes, "spilled_bytes": meter.spilled_bytes}
    return record | {"execution_time_ms": spent, "execution_time": int(spent)} | measured


def sweep(
    spark: SparkSession, datasets: dict[str, Dataset], ks: tuple[int, ...] = KS, min_probs: tuple[float, ...] = LEAST_PROBABILITIES, repetitions: int = 1,
    timeout_s: float = TIMEOUT_S, parallel: int = 1, store: str | None = None, on_record: Callable[[dict], None] | None = None, **options,
) -> DataFrame:
    """The records of all runs of the grid. ``store``: where they are kept; ``options``: of ``mine``."""
    store = store or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/sweep-{time.time_ns()}"
    known = {r["run"] for r in records(spark, store).select("run").collect()}  # a row for each run
    shared = {name: Known(data) for name, data in datasets.items()}
    todo = [r for r in grid(list(datasets), tuple(ks), tuple(min_probs), repetitions) if r.number not in known]

    def go(run: Run) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run-{run.number}")
        record = run_one(spark, run, shared[run.dataset], timeout_s, **options)
        row = spark.createDataFrame([tuple(record[n] for n in NAMES)], RECORD)
        runs.append(row.coalesce(1), store, run.number)
        if on_record:
            on_record(record)

    try:
        with ThreadPoolExecutor(parallel) as pool:
            for done in [pool.submit(go, r) for r in todo]:
                done.result()
    finally:
        for known in shared.values():
            if known.found:
                remove(spark, known.found[1].stash_path)
    return records(spark, store)


def records(spark: SparkSession, store: str) -> DataFrame:
    """The records in a store, with what the reports derive from them; none, if there is no store yet."""
    return runs.derived(runs.appended(spark, store, RECORD).drop("batch"))
