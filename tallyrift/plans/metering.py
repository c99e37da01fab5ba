"""What the jobs of a part of the program took, from the status store that Spark keeps of them."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Meter:
    """Jobs started within ``with`` by this thread, told apart by a tag of their own.

    ``peak_memory_mb``: the largest heap of an executor that was polled during one of their stages, or the memory that the tasks
    of one of their stages had for execution, whichever is more. Polls come with heartbeats (``spark.executor.metrics.pollingInterval``
    makes them more frequent), so short stages have the latter alone.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.tag = spark, name, f"meter-{uuid.uuid4().hex}"
        self.peak_memory_mb = 0.0
        self.cpu_ms = self.shuffled_bytes = self.spilled_bytes = self.jobs = 0

    def _jobs(self) -> object:
        """All jobs that the store still has, newest first."""
        return self.spark.sparkContext._jsc.sc().statusStore().jobsList(self.spark.sparkContext._jvm.java.util.ArrayList())

    def __enter__(self) -> Meter:
        jobs = self._jobs()
        self.since = jobs.apply(0).jobId() if jobs.size() else -1
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *error: object) -> None:
        self.spark.removeTag(self.tag)
        if error[0] is None:
            self.read()

    def read(self) -> None:
        core = self.spark.sparkContext._jsc.sc()
        core.listenerBus().waitUntilEmpty()
        store, jobs = core.statusStore(), self._jobs()
        stages: set[int] = set()
        for i in range(jobs.size()):
            job = jobs.apply(i)
            if job.jobId() < self.since:
                break
            if self.tag in job.jobTags().mkString(","):
                self.jobs += 1
                stages |= {int(s) for s in job.stageIds().mkString(",").split(",") if s}
        peak = 0
        for s in stages:
            try:
                stage = store.lastStageAttempt(s)
            except Py4JJavaError:  # the store keeps only the last stages (spark.ui.retainedStages)
                continue
            self.cpu_ms += stage.executorCpuTime() // 1_000_000
            self.shuffled_bytes += stage.shuffleWriteBytes()
            self.spilled_bytes += stage.diskBytesSpilled()
            polled = stage.peakExecutorMetrics()
            heap = polled.get().getMetricValue("JVMHeapMemory") if polled.isDefined() else 0
            peak = max(peak, heap, stage.peakExecutionMemory())
        self.peak_memory_mb = peak / 2**20
