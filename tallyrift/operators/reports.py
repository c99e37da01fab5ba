"""Summaries of experiment runs, each one aggregation with partial sums before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.operators import quantiles as exact

#: The metrics that are averaged over repetitions.
AVERAGED = ("execution_time_ms", "candidates_generated", "total_pruned", "pruning_ratio", "peak_memory_mb", "transactions_per_second", "cas_efficiency", "database_size")
PRUNED = ("rtwu_pruned", "branches_pruned", "bulk_branches_pruned", "eu_remaining_pruned", "ep_pruned")
SUMMARY = ("execution_time_ms", "peak_memory_mb", "pruning_percentage", "transactions_per_second")


def spread(name: str) -> Column:
    """The sample's standard deviation; of a single row, zero."""
    return F.coalesce(F.stddev_samp(name), F.lit(0.0))


def averages(runs: DataFrame) -> DataFrame:
    """Mean and deviation of the metrics by dataset, k and min_prob, over repetitions."""
    return runs.groupBy("dataset", "k", "min_prob").agg(
        F.count("*").alias("runs"), *[F.avg(c).alias(f"avg_{c}") for c in AVERAGED], *[spread(c).alias(f"std_{c}") for c in AVERAGED]
    )


def status_counts(runs: DataFrame) -> DataFrame:
    """One row: all runs, those of each status, and the means of the successful."""
    ok = F.col("status") == "SUCCESS"
    return runs.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "TIMEOUT").alias("timeout"),
        F.avg(F.when(ok, F.col("execution_time_ms"))).alias("mean_time_ms"), F.avg(F.when(ok, F.col("peak_memory_mb"))).alias("mean_memory_mb"),
    )


def pivot_mean(runs: DataFrame, rows: str, across: str, values: list, metric: str, prefix: str) -> DataFrame:
    """A row for each value of ``rows``, a column for each of the given values of ``across``: no extra pass to find them."""
    out = runs.groupBy(rows).pivot(across, values).agg(F.avg(metric))
    return out.select(rows, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])


def mean_by(runs: DataFrame, key: str, *metrics: str, deviation: bool = False) -> DataFrame:
    more = [spread(m).alias(f"std_{m}") for m in metrics] if deviation else []
    return runs.groupBy(key).agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics], *more)


def throughput_pivot(runs: DataFrame, values: list) -> DataFrame:
    by = runs.groupBy("dataset", "k").agg(F.avg("transactions_per_second").alias("tps"))
    return pivot_mean(by, "k", "dataset", values, "tps", "")


def histogram(runs: DataFrame, metric: str, bins: int = 20) -> DataFrame:
    """bin (from 1), count, lo, hi: equal widths from the least to the largest value, which is in the last bin."""
    ends = runs.agg(F.min(metric).alias("lo_all"), F.max(metric).alias("hi_all"))
    width = (F.col("hi_all") - F.col("lo_all")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(metric) - F.col("lo_all")) / width) + 1, F.lit(bins))).otherwise(F.lit(1)).cast("int")
    return runs.where(F.col(metric).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin"), "lo_all", "hi_all").agg(F.count("*").alias("n")).select(
        "bin", "n", (F.col("lo_all") + (F.col("bin") - 1) * width).alias("lo"), (F.col("lo_all") + F.col("bin") * width).alias("hi")
    )


def center(runs: DataFrame, metric: str) -> DataFrame:
    """mean, median: one row."""
    middle = exact.quantiles(runs, [], metric, {"median": 0.5}).select("median")
    return runs.agg(F.avg(metric).alias("mean")).join(F.broadcast(middle), F.lit(True), "left")  # a row each


def summary(runs: DataFrame, metrics: tuple[str, ...] = SUMMARY) -> DataFrame:
    """metric, mean, std, min, max: one pass, then a row for each metric."""
    one = runs.agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", spread), ("min", F.min), ("max", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}_{n}").cast("double").alias(n) for n in ("mean", "std", "min", "max")]) for m in metrics]))
    return one.select(rows.alias("r")).select("r.*")


def pruning_shares(runs: DataFrame) -> DataFrame:
    """counter, total, share of the pruning counters."""
    one = runs.agg(*[F.sum(c).alias(c) for c in PRUNED])
    total = sum((F.col(c) for c in PRUNED[1:]), F.col(PRUNED[0]))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("total"), F.when(total > 0, F.col(c) / total).alias("share")) for c in PRUNED]))
    return one.select(rows.alias("r")).select("r.*")


def quantiles(runs: DataFrame, key: str, metric: str) -> DataFrame:
    """Exact quartiles, least and largest."""
    found = exact.quantiles(runs, [key], metric, exact.QUARTILES | {"least": 0.0, "largest": 1.0})
    return found.select(key, "q1", "q2", "q3", "least", "largest")


def line_fit(runs: DataFrame, x: Column, y: Column) -> DataFrame:
    return runs.select(x.cast("double").alias("x"), y.cast("double").alias("y")).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def curve_fit(runs: DataFrame, x: str, y: str) -> DataFrame:
    """a, b, c of y = a x^2 + b x + c by least squares, from power sums of x about its mean."""
    at = runs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    mean = at.agg(F.avg("x").alias("m"))
    d = F.col("x") - F.col("m")
    s = at.join(F.broadcast(mean)).agg(
        F.first("m").alias("m"), F.count("*").cast("double").alias("n"), F.sum(d * d).alias("s2"), F.sum(d**3).alias("s3"), F.sum(d**4).alias("s4"),
        F.sum("y").alias("t0"), F.sum(d * F.col("y")).alias("t1"), F.sum(d * d * F.col("y")).alias("t2"),
    )
    # Normal equations with the first moment zero: two unknowns remain.
    # Too few different x have no curve: a, b and c are null then.
    over = lambda a, b: F.try_divide(a, F.nullif(F.col(b), F.lit(0.0)))
    s = s.withColumn("q", F.col("s4") - over(F.col("s2") ** 2, "n") - over(F.col("s3") ** 2, "s2"))
    s = s.withColumn("a", over(F.col("t2") - over(F.col("s2") * F.col("t0"), "n") - over(F.col("s3") * F.col("t1"), "s2"), "q"))
    s = s.withColumn("b0", over(F.col("t1") - F.col("a") * F.col("s3"), "s2"))
    s = s.withColumn("c0", over(F.col("t0") - F.col("a") * F.col("s2"), "n"))
    return s.select("a", (F.col("b0") - 2 * F.col("a") * F.col("m")).alias("b"), (F.col("c0") - F.col("b0") * F.col("m") + F.col("a") * F.col("m") ** 2).alias("c"))


def group_means(runs: DataFrame) -> DataFrame:
    """grouping, value, mean time, mean memory, mean pruning, by dataset, by k and by min_prob."""
    keys = ("dataset", "k", "min_prob")
    metrics = [F.avg("execution_time_ms").alias("time_ms"), F.avg("peak_memory_mb").alias("memory_mb"), F.avg("pruning_percentage").alias("pruning")]
    sets = runs.groupingSets([[F.col(c)] for c in keys], *keys).agg(F.grouping_id().alias("g"), *metrics)
    name = F.when(F.col("g") == 3, "dataset").when(F.col("g") == 5, "k").otherwise("min_prob")
    value = F.coalesce("dataset", F.col("k").cast("string"), F.format_string("%.5f", "min_prob"))
    return sets.select(name.alias("grouping"), value.alias("value"), "time_ms", "memory_mb", "pruning")


def with_speedup(runs: DataFrame) -> DataFrame:
    """speedup: the dataset's least time over the run's own; null for a run of no time.

    The least times are a sum by dataset that Spark joins back, so a dataset with most of the runs is no task of its own.
    """
    least = runs.groupBy("dataset").agg(F.min("execution_time_ms").alias("_least"))
    speedup = F.when(F.col("execution_time_ms") > 0, F.col("_least") / F.col("execution_time_ms"))
    return runs.join(least, "dataset").withColumn("speedup", speedup).select(*runs.columns, "speedup")


def extremes(runs: DataFrame) -> DataFrame:
    """The fastest run and the one that pruned most, ties to the first."""
    return runs.agg(
        F.min_by("run", F.struct("execution_time_ms", "run")).alias("fastest"), F.min("execution_time_ms").alias("fastest_ms"),
        F.min_by("run", F.struct(-F.col("pruning_percentage"), "run")).alias("most_pruned"), F.max("pruning_percentage").alias("most_pruning"),
    )


def performance_table(runs: DataFrame) -> DataFrame:
    """dataset and its means: time, memory, pruning, throughput, speedup."""
    means = {"time_ms": "execution_time_ms", "memory_mb": "peak_memory_mb", "pruning": "pruning_percentage", "throughput": "transactions_per_second", "speedup": "speedup"}
    return with_speedup(runs).groupBy("dataset").agg(*[F.avg(m).alias(n) for n, m in means.items()])


def sensitivity_table(runs: DataFrame) -> DataFrame:
    """parameter (k or min_prob), setting, mean time by it."""
    sets = runs.groupingSets([["k"], ["min_prob"]], "k", "min_prob").agg(F.grouping("k").alias("g"), F.avg("execution_time_ms").alias("time_ms"))
    return sets.select(F.when(F.col("g") == 0, "k").otherwise("min_prob").alias("parameter"), F.coalesce(F.col("k").cast("double"), "min_prob").alias("setting"), "time_ms")


def best_runs(runs: DataFrame) -> DataFrame:
    """kind (fastest, most pruned), dataset, k, min_prob, reached of the best run of each kind, ties to the first run."""
    of = lambda metric, order: F.min_by(F.struct("dataset", "k", "min_prob", F.col(metric).cast("double").alias("reached")), F.struct(order, "run"))
    one = runs.agg(of("execution_time_ms", F.col("execution_time_ms")).alias("fastest"), of("pruning_percentage", -F.col("pruning_percentage")).alias("pruned"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.col(c).alias("x")) for c, name in (("fastest", "fastest"), ("pruned", "most pruned"))]))
    return one.select(rows.alias("r")).select("r.kind", "r.x.*")


#: From which mean on a percentage counts as good, and as excellent.
GRADES = {"pruning_percentage": (80, 90), "cas_efficiency": (90, 95)}


def grades(runs: DataFrame) -> DataFrame:
    """metric, mean, grade (excellent, good, improve) of the percentages that have limits."""
    one = runs.agg(*[F.avg(m).alias(m) for m in GRADES])
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"), F.when(F.col(m) > b, "excellent").when(F.col(m) > a, "good").otherwise("improve").alias("grade")) for m, (a, b) in GRADES.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def text_rows(table: DataFrame, formats: dict[str, str], between: str, end: str = "") -> DataFrame:
    """The rows as lines of text, column ``line``; ``formats``: how each column is printed."""
    cells = [F.format_string(f, F.col(c)) for c, f in formats.items()]
    return table.select(F.concat(F.concat_ws(between, *cells), F.lit(end)).alias("line"))


#: How the columns of the tables are printed.
PERFORMANCE = {"dataset": "%s", "time_ms": "%.1f", "memory_mb": "%.1f", "pruning": "%.1f", "throughput": "%.0f", "speedup": "%.2f"}
SENSITIVITY = {"parameter": "%s", "setting": "%.3f", "time_ms": "%.1f"}


def printed(table: DataFrame, formats: dict[str, str], between: str, end: str = "", most: int = 10_000) -> list[str]:
    """The lines of a summary in the order of its columns; of more rows than ``most`` none are printed but an error is raised."""
    rows = text_rows(table.orderBy(*formats), formats, between, end).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows is no summary")
    return [r[0] for r in rows]


def latex_table(table: DataFrame, formats: dict[str, str], caption: str, label: str) -> str:
    head = " & ".join(c.replace("_", r"\_") for c in formats) + r" \\"
    body = [line.replace("_", r"\_") for line in printed(table, formats, " & ", r" \\")]
    kinds = "".join("l" if f == "%s" else "r" for f in formats.values())
    return "\n".join([
        r"\begin{table}[h]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{tab:{label}}}", rf"\begin{{tabular}}{{{kinds}}}", r"\hline", head, r"\hline", *body,
        r"\hline", r"\end{tabular}", r"\end{table}", "",
    ])


def latex_tables(runs: DataFrame) -> str:
    """Both tables of a paper: performance by dataset, and mean time by k and by min_prob."""
    return latex_table(performance_table(runs), PERFORMANCE, "Performance by dataset", "performance") + "\n" + latex_table(sensitivity_table(runs), SENSITIVITY, "Time by parameter", "sensitivity")


def markdown_report(runs: DataFrame) -> str:
    """Status counts, means, means by dataset, the best runs with their settings, and grades, as Markdown; without a successful run, the counts alone."""
    from tallyrift.sources.runs import successful

    said, good = status_counts(runs).first(), successful(runs)
    lines = ["# Runs", "", f"Runs: {said.total}, successful {said.success}, failed {said.failed}, timed out {said.timeout}.", ""]
    if said.success:
        mean = good.agg(F.avg("execution_time_ms"), F.avg("peak_memory_mb"), F.coalesce(F.avg("pruning_percentage"), F.lit(0.0))).first()
        lines += [f"Means: {mean[0]:.2f} ms, {mean[1]:.2f} MB, {mean[2]:.1f} % pruned.", ""]
        lines += ["| " + " | ".join(PERFORMANCE) + " |", "|-" * len(PERFORMANCE) + "|", *["| " + x + " |" for x in printed(performance_table(good), PERFORMANCE, " | ")], ""]
        lines += [f"{r.kind.capitalize()}: {r.dataset}, k {r.k}, min_prob {r.min_prob}: {r.reached:.1f}." for r in best_runs(good).collect() if r.reached is not None]
        lines += ["", *[f"{r.metric}: {r['mean']:.1f}, {r.grade}." for r in grades(good).collect() if r["mean"] is not None], ""]
    return "\n".join(lines)
