"""Top-k high-utility itemsets of an uncertain database, exactly, level by level.

A level holds a row for each occurrence of each itemset that may still matter: what it is worth there,
how likely, and its last item's place among its transaction's items. A level's sums give expected
utility, existential probability and an upper bound for all itemsets that grow from it; those that
can't qualify go, and the rest grow by one later item of their own row. The k best so far set the
threshold, which then decides on items to grow by as well as on itemsets. Only the transactions and the
levels' sums are kept; a level's rows are made again from them when it grows.

Several settings (k, least probability) can share one search: an itemset stays as long as one of them
needs it, and each has its own k best and its own threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyrift.functions.measures import EPSILON, existential_probability, expected_utility, upper_bound
from tallyrift.operators import encode
from tallyrift.plans import dense
from tallyrift.plans.metering import Meter
from tallyrift.sources.shared import remove, stash

#: Levels between two that are written out, which ends their lineage.
CUT_EVERY = 4
#: Itemsets are ordered by utilities of six digits, so those within the last one are left to that order.
SLACK = 1e-6
#: From so many survivors on, a level grows in batches by falling upper bound; a batch is a job, so fewer don't pay for it.
BATCH_FROM, BATCH_SHARES = 2000, (0.9, 0.6)
#: Keys that an itemset's occurrences are spread over where survivors are too many to be broadcast, so that a frequent one is no task of its own.
SALTS = 16
RESULT = "rank int, items array<int>, eu double, ep double"
STATS = (
    "level int, candidates long, occurrences long, rtwu_pruned long, pair_pruned long, ep_pruned long, ub_pruned long, survivors long, threshold double, "
    "batches int, peak_memory_mb double"
)
Setting = tuple[int, float]
Found = list[tuple[list[int], float, float]]


@dataclass
class Mined:
    """The result, the threshold at the end, and a row for each level."""

    rows: Found
    threshold: float
    levels: list[dict] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(self.rows)], RESULT)

    def stats(self, spark: SparkSession) -> DataFrame:
        """A row for each level: itemsets generated, their occurrences, what was pruned and why, and the memory at the peak.

        rtwu_pruned and pair_pruned count ways to grow an occurrence that an item's or a pair's bound ruled out; ep_pruned
        and ub_pruned count itemsets. Levels by columns don't count the former. In a search shared by several settings all counts but the threshold are of the search.
        """
        names = [c.split(" ")[0] for c in STATS.split(", ")]
        return spark.createDataFrame([tuple(x[n] for n in names) for x in self.levels], STATS)


def measured(level: DataFrame) -> DataFrame:
    """items, eu, ep, ub, n of each itemset of a level, and pair: a bound on all itemsets that have its items. Partial sums before the shuffle."""
    return level.groupBy("items").agg(
        expected_utility().alias("eu"), existential_probability().alias("ep"), upper_bound().alias("ub"), F.count("*").alias("n"),
        F.sum(F.greatest("room", F.lit(0.0)) * F.col("p")).alias("pair"),
    )


LISTS = ("t_item", "t_u", "t_p", "t_rem", "t_bound", "t_rtu")
#: An occurrence alone. ``room``: what its transaction may be worth to any itemset that has these items.
NARROW = ("tid", "items", "u", "p", "rem", "room", "at")


def first_level(tails: DataFrame) -> DataFrame:
    """``NARROW`` and the transaction's lists: each item alone, ``at`` its place; ``next`` too, the places it may grow by, if pairs are known."""
    paired = "t_next" in tails.columns
    lists = [*LISTS, *(["t_next"] if paired else [])]
    rows = tails.select("tid", *lists, F.posexplode("t_item").alias("at", "item"))
    u = F.get("t_u", "at")
    return rows.select(
        "tid", F.array("item").alias("items"), u.alias("u"), F.get("t_p", "at").alias("p"), F.get("t_rem", "at").alias("rem"), (F.col("t_rtu") + F.least(u, F.lit(0.0))).alias("room"), "at",
        *lists, *([_places("at").alias("next")] if paired else []),
    )


def _places(at: str) -> Column:
    return F.coalesce(F.try_element_at("t_next", F.col(at)), F.array().cast("array<int>"))


def extended(level: DataFrame, keep: DataFrame) -> DataFrame:
    """Each occurrence of an itemset to keep, with each later item of its row: a level, ``bound`` (the new item's) and ``able`` (whether pairs allow it).

    ``keep`` should be small enough to be broadcast: the rows carry their transaction's lists, which no shuffle should see.
    """
    last = F.size("t_item") - 1
    paired = "next" in level.columns
    lists = [*LISTS, *(["t_next"] if paired else [])]
    rows = level.where(F.col("at") < last).join(keep, "items", "left_semi")
    rows = rows.select("tid", "items", "u", "p", "room", *lists, *(["next"] if paired else []), F.explode(F.sequence(F.col("at") + 1, last)).alias("at"))
    u, p = F.get("t_u", "at"), F.get("t_p", "at")
    return rows.select(
        "tid", F.concat("items", F.array(F.get("t_item", "at"))).alias("items"), (F.col("u") + u).alias("u"), (F.col("p") * p).alias("p"), F.get("t_rem", "at").alias("rem"),
        (F.col("room") + F.least(u, F.lit(0.0))).alias("room"), "at", *lists, *([F.array_intersect("next", _places("at")).alias("next")] if paired else []),
        F.get("t_bound", "at").alias("bound"), (F.array_contains("next", F.col("at")) if paired else F.lit(True)).alias("able"),
    )


def extended_by_join(level: DataFrame, keep: DataFrame, tails: DataFrame) -> DataFrame:
    """The same where ``keep`` is too large to be broadcast: occurrences alone meet it, spread over ``SALTS`` keys, and then the items of their transaction, a row each.

    No row that is shuffled carries a list of its transaction but the places it may grow by.
    """
    paired = "next" in level.columns
    salt = F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int").alias("_salt")
    spread = keep.select("items", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = ["tid", "items", "u", "p", "room", "at", *(["next"] if paired else [])]
    alive = level.select(*own, salt).join(spread, ["items", "_salt"], "left_semi").drop("_salt")
    bound = F.get("t_bound", "at").alias("bound")
    each = first_level(tails).select(
        "tid", F.col("at").alias("_at"), F.col("items")[0].alias("_item"), F.col("u").alias("_u"), F.col("p").alias("_p"), F.col("rem").alias("_rem"), bound,
        *([F.col("next").alias("_next")] if paired else []),
    )
    return alive.join(each, "tid").where(F.col("_at") > F.col("at")).select(
        "tid", F.concat("items", F.array("_item")).alias("items"), (F.col("u") + F.col("_u")).alias("u"), (F.col("p") * F.col("_p")).alias("p"), F.col("_rem").alias("rem"),
        (F.col("room") + F.least("_u", F.lit(0.0))).alias("room"), F.col("_at").alias("at"), *([F.array_intersect("next", "_next").alias("next")] if paired else []), "bound",
        (F.array_contains("next", F.col("_at")) if paired else F.lit(True)).alias("able"),
    )


def united(parts: list[DataFrame]) -> DataFrame:
    """The batches of a level as one, with lists if all have them."""
    common = [c for c in parts[0].columns if all(c in x.columns for x in parts)]
    return reduce(DataFrame.unionByName, [x.select(*common) for x in parts])


def with_lists(level: DataFrame, tails: DataFrame) -> DataFrame:
    """Occurrences alone with the lists of their transactions again."""
    return level if "t_item" in level.columns else level.join(tails, "tid")


def with_pairs(tails: DataFrame, able: DataFrame) -> DataFrame:
    """The transactions with t_next: for each place the later places whose items make a pair of ``able`` (items) with its own."""
    rows = tails.select("tid", "t_item", F.posexplode("t_item").alias("a", "i"))
    rows = rows.select("tid", "a", "i", F.posexplode(F.slice("t_item", F.col("a") + 2, F.size("t_item"))).alias("d", "j"))
    met = rows.withColumn("items", F.array("i", "j")).join(able.select("items"), "items", "left_semi")
    by_place = met.groupBy("tid", "a").agg(F.array_sort(F.collect_list(F.col("a") + F.col("d") + 1)).alias("bs"))
    maps = by_place.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("a", "bs"))).alias("t_next"))
    return tails.join(maps, "tid")  # a transaction without any such pair has no larger itemset that matters


def grown(level: DataFrame, keep: DataFrame, threshold: float | None = None) -> DataFrame:
    """The next level: each occurrence of an itemset to keep, with each later item whose own bound reaches the threshold."""
    rows = extended(level, keep).where("able")
    return (rows if threshold is None else rows.where(F.col("bound") >= threshold - SLACK)).drop("bound", "able")


def best_first(found: Found) -> Found:
    """By expected utility, then fewer items, then items: a total order."""
    return sorted(found, key=lambda r: (-round(r[1], 6), len(r[0]), r[0]))


class Counted:
    """Counts of rows that pass by, had with the job that reads them; ``rows`` are to be read instead of those given."""

    def __init__(self, rows: DataFrame, **counts: Column):
        self.given, self.counts, self.seen = rows, [c.alias(n) for n, c in counts.items()], Observation()
        self.rows = rows.observe(self.seen, *self.counts)

    def get(self) -> dict:
        try:
            found = self.seen.get
        except Py4JJavaError:  # rows that come to nothing are dropped from the plan, and the counts with them
            found = self.given.agg(*self.counts).first().asDict()
        return {n: v or 0 for n, v in found.items()}


def needed(least: dict[float, float], of: str) -> Column:
    """Whether ``of`` (eu or a bound) and ep are what one of the settings needs: ``least``, the lowest threshold of each least probability."""
    slack = lambda t: t - SLACK if of != "eu" or t > 0 else -EPSILON
    return reduce(or_, [(F.col("ep") >= mp - EPSILON) & (F.col(of) >= slack(t)) for mp, t in least.items()])


def leading(rows: DataFrame, least: dict[float, float], k: int) -> dict[float, list[Row]]:
    """For each least probability its k best rows, by eu and then items: k rows each are all that the driver sees."""
    some = rows.where(needed(least, "eu"))
    order = [F.desc(F.round("eu", 6)), F.array_sort("items")]
    if len(least) == 1:
        return {next(iter(least)): some.orderBy(*order).limit(k).collect()}
    of = F.filter(F.array(*[F.lit(mp) for mp in least]), lambda mp: F.col("ep") >= mp - EPSILON)
    placed = some.select("items", "eu", "ep", F.explode(of).alias("_for")).withColumn("_place", F.row_number().over(Window.partitionBy("_for").orderBy(*order)))
    found: dict[float, list[Row]] = {mp: [] for mp in least}
    for r in placed.where(F.col("_place") <= k).collect():
        found[r["_for"]].append(r)
    return found


def mine(
    transactions: DataFrame, profits: DataFrame, k: int, min_pro: float, max_len: int | None = None, unpriced: str = "exclude",
    min_support: float = 0.0, weighted: bool = True, pairs: bool = False, on_level: Callable[[dict], None] | None = None, columns: bool | None = None,
) -> Mined:
    """The k itemsets of the largest expected utility, at least zero, whose existential probability is at least ``min_pro``.

    ``weighted``: rank items by the tighter bound; ``pairs``: an itemset grows only by items that make a promising pair with
    each of its own; ``columns``: levels by columns (``dense``) as far as their itemsets can be sent to all tasks, None: where that costs
    less. None of these changes the result. ``min_support``: drop items of less expected support (this does).
    A transaction that has an item twice is an error. ``on_level`` is told of each level when it is done.
    """
    return mine_settings(transactions, profits, [(k, min_pro)], max_len, unpriced, min_support, weighted, pairs, on_level, columns)[0]


def mine_settings(
    transactions: DataFrame, profits: DataFrame, settings: list[Setting], max_len: int | None = None, unpriced: str = "exclude",
    min_support: float = 0.0, weighted: bool = True, pairs: bool = False, on_level: Callable[[dict], None] | None = None, columns: bool | None = None,
) -> list[Mined]:
    """What ``mine`` finds for each (k, min_pro) of ``settings``, by one search over the transactions."""
    if not settings or any(k < 1 for k, _ in settings):
        raise ValueError("k must be at least 1")
    spark = transactions.sparkSession
    by = "rtwu_weighted" if weighted else "rtwu"
    most = max(k for k, _ in settings)
    best: list[Found] = [[] for _ in settings]
    thresholds = [0.0] * len(settings)
    out = [Mined([], 0.0) for _ in settings]
    held: list[DataFrame] = []
    written: list[str] = []

    def hold(frame: DataFrame) -> DataFrame:
        held.append(frame.persist())
        return frame

    def least() -> dict[float, float]:
        lowest: dict[float, float] = {}
        for (_, mp), t in zip(settings, thresholds, strict=True):
            lowest[mp] = min(t, lowest.get(mp, t))
        return lowest

    def learn(sums: DataFrame) -> None:
        """The k best with those of ``sums``, and the thresholds that follow."""
        found = leading(sums, least(), most)
        for s, (k, mp) in enumerate(settings):
            best[s] = best_first(best[s] + [(sorted(r["items"]), r["eu"], r["ep"]) for r in found[mp]])[:k]
            if len(best[s]) == k:
                thresholds[s] = max(thresholds[s], best[s][-1][1], 0.0)

    try:
        # All that follows of transactions goes by tid, so the shuffle that brings them together is the only one; none, if they come dealt by tid.
        base = hold(encode.as_rows(encode.priced(transactions, profits, unpriced).select("tid", "item", "u", "p")))
        items = hold(encode.promising(encode.measured_items(encode.items_of(base)), by, 0.0, min_support))
        # Singles give the first threshold, so that items which can't matter are gone before lists are built.
        learn(items.withColumn("items", F.array("item")))
        usable = items.where(needed(least(), by))
        ranked = encode.items_of(base).join(usable.select("item", F.col(by).alias("bound")), "item")
        tails = hold(encode.as_tails(ranked, "bound", "item"))
        best = [[] for _ in settings]
        level, size, sums = first_level(tails), 1, None
        grew: list[DataFrame] = []  # the survivors of each level
        by_columns, shape, order = False, (0, 0, 0.0), []
        batches: list[tuple[DataFrame | None, float | None]] = [(None, None)]
        while True:
            parts, counts, ran = [], {"candidates": 0, "occurrences": 0, "rtwu_pruned": 0, "pair_pruned": 0, "ep_pruned": 0}, 0
            with Meter(spark, f"level {size}") as meter:
                wide = []
                for keep, reach in batches:
                    lowest = min(thresholds)
                    if reach is not None and reach < lowest - SLACK:
                        break  # no itemset of this batch or a later one grows into what is needed
                    rows, seen = level, None
                    if by_columns:
                        few = keep.where(needed(least(), "ub")).select("items").collect()  # itemsets that fit a broadcast
                        part = hold(dense.measured(tails, [r["items"] for r in few], order, lowest - SLACK))
                    elif keep is not None:
                        few = keep.where(needed(least(), "ub")).select("items")
                        in_row = _fits(spark, keep.expected, size)
                        rows = extended(with_lists(level, tails), F.broadcast(few)) if in_row else extended_by_join(level, few, tails)
                        able, fits = F.col("able"), F.col("bound") >= lowest - SLACK
                        seen = Counted(rows.select(*NARROW, "bound", "able"), rtwu_pruned=F.count_if(able & ~fits), pair_pruned=F.count_if(~able))
                        rows = rows.where(able & fits).drop("bound", "able")
                    if not by_columns:
                        wide.append(rows)
                        part = hold(measured(rows.select(*NARROW) if seen is None else seen.rows.where(able & fits)))
                    likely = F.col("ep") >= min(least()) - EPSILON
                    said = Counted(part, candidates=F.count("*"), ep_pruned=F.count_if(~likely), occurrences=F.sum("n"), widest=F.max("n"))
                    learn(said.rows)
                    parts.append(part)
                    for x in (said, *([seen] if seen else [])):
                        for name, n in x.get().items():
                            counts[name] = counts.get(name, 0) + n
                    ran += 1
                if not parts:
                    break
                sums = reduce(DataFrame.unionByName, parts)
                # Survivors are written, so the next level's plan begins with a table and not with all levels before.
                alive = sums.where(needed(least(), "ub")).select("items", "ep", "ub", "n")
                ends = F.percentile_approx("ub", F.array(*[F.lit(q) for q in BATCH_SHARES]))
                told = Counted(alive, left=F.count("*"), ends=ends, met=F.sum("n"))
                keep = stash(told.rows, f"alive-{size}")
                written.append(keep.stash_path)
                left, cuts, met = (told.get()[c] for c in ("left", "ends", "met"))
                widest = counts.pop("widest", 0)
            likely = counts["candidates"] - counts["ep_pruned"]
            row = {"level": size, **counts, "ub_pruned": likely - left, "survivors": left, "batches": ran, "peak_memory_mb": meter.peak_memory_mb}
            for m, t in zip(out, thresholds, strict=True):
                m.levels.append({**row, "threshold": t})
            if on_level:
                on_level({**row, "threshold": min(thresholds)})
            if not left or size == max_len:
                break
            grew.append(keep)
            if size == 1:
                # There are at least as many transactions as the most frequent item has; they are counted if that few would do.
                shape = (widest, counts["candidates"], counts["occurrences"] / max(widest, 1))
            was, fits = by_columns, _fits(spark, left, size)
            may = not pairs and fits and columns is not False and shape[1] <= dense.MOST_ITEMS
            if may and not was and columns is None and size == 1 and dense.pays(shape[0], left, met, shape[1], shape[2]):
                transactions = tails.count()
                shape = (transactions, shape[1], out[0].levels[0]["occurrences"] / max(transactions, 1))
            by_columns = may and (bool(columns) or was or dense.pays(shape[0], left, met, shape[1], shape[2]))
            if by_columns and not order:
                order = [tuple(r) for r in usable.select("item", by).orderBy(by, "item").collect()]  # MOST_ITEMS rows at most
            if by_columns:
                level = None
            elif was:
                level = reduce(grown, grew[:-1], first_level(tails))
            else:
                level = united(wide)
            if pairs and size == 2:
                # From triples on, both new pairs of an itemset must be able as well; itemsets are the same, so the level is made anew with its places.
                able = sums.where(needed(least(), "pair"))
                tails = hold(with_pairs(tails, able))
                level = grown(first_level(tails), items.select(F.array("item").alias("items")))
            size += 1
            batches = _batches(keep, left, cuts)
            if size % CUT_EVERY == 0 and level is not None:
                level = stash(level, f"level-{size - 1}")
                written.append(level.stash_path)
        for m, rows, t in zip(out, best, thresholds, strict=True):
            m.rows, m.threshold = rows, t
        return out
    finally:
        for x in held:
            x.unpersist()
        for path in written:
            remove(spark, path)


def _batches(keep: DataFrame, count: int, cuts: list[float] | None) -> list[tuple[DataFrame, float]]:
    """Survivors in batches of falling upper bound, each with its largest bound; few survivors are one batch."""
    ends = sorted(set(cuts or []), reverse=True) if count >= BATCH_FROM else []
    parts = []
    for hi, lo in zip([None, *ends], [*ends, None], strict=True):
        within = (F.lit(True) if hi is None else F.col("ub") < hi) & (F.lit(True) if lo is None else F.col("ub") >= lo)
        parts.append((keep.where(within), float("inf") if hi is None else hi))
    for frame, _ in parts:
        frame.expected = count
    return parts


def _fits(spark: SparkSession, count: int, size: int) -> bool:
    """Whether so many itemsets are below Spark's size for broadcasts."""
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return count * (64 + 8 * size) <= limit
