"""The engine's queries by name, each with SQL that says the same where SQL can."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.functions import measures
from tallyrift.operators import encode, pairs, quantiles, reports
from tallyrift.plans import mine as search
from tallyrift.plans import sweep as sweeps
from tallyrift.sources import results as printing
from tallyrift.sources import runs as records
from tallyrift.sources import tables, text
from tallyrift.sources.shared import shared_dir, stash

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DATASETS = ["chess", "mushroom", "retail", "kosarak"]
KS = [5, 50, 100, 500, 1000]

#: The uncertain database, its profits, and the priced base, as SQL.
BRANDS = """db as (
  select l_orderkey as tid, cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) as item, sum(l_quantity) as quantity, max(1 - l_discount * 5) as prob
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
PARTS = "db as (select l_orderkey as tid, l_partkey::int as item, sum(l_quantity) as quantity, max(1 - l_discount * 5) as prob from lineitem group by 1, 2)"
EVENTS = """db as (
  select user_id as tid, (length(event_type) * 100 + ascii(event_type))::int as item, count(*)::double as quantity,
    count(*) filter (value > 20) / count(*) as prob from events group by 1, 2)"""
PROFITS = "pr as (select item, case when item % 4 = 0 then -1.0::double * (item % 7 + 1) else item % 9 + 1.0::double end as profit from (select distinct item from db))"
BASE = "b as (select tid, item, quantity, profit, quantity * profit as u, prob as p from db join pr using (item) where prob > 0)"
ZERO = "b as (select tid, item, quantity, coalesce(profit, 0) as profit, quantity * coalesce(profit, 0) as u, prob as p from db left join (select * from pr where item % 5 <> 0) using (item) where prob > 0)"
RTU = "t as (select tid, sum(greatest(u, 0)) as rtu from b group by tid)"
BOUNDS = "w as (select item, sum(rtu) as rtwu, sum(rtu * p) as rtwu_weighted, sum(p) as support, count(*) as frequency from b join t using (tid) group by item)"
RANKS = "r as (select item, rtwu_weighted as bound, (row_number() over (order by rtwu_weighted, item) - 1)::int as rank from w)"
REM = """m as (select tid, item, rank, u, p, coalesce(sum(greatest(u, 0)) over (partition by tid order by rank rows between 1 following and unbounded following), 0) as rem
  from b join r using (item))"""


def lev(longest: int | None = None) -> str:
    stop = f" and len(l.x) < {longest}" if longest else ""
    return f"""lev as (
  select tid, [item] as x, item as mx, u, p from b
  union all
  select l.tid, list_append(l.x, b.item), b.item, l.u + b.u, l.p * b.p from lev l join b on l.tid = b.tid and b.item > l.mx{stop})"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def brands(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tables.from_lines(spark, d), tables.part_profits(spark, d)


def base(spark: SparkSession, d: str, unpriced: str = "exclude") -> DataFrame:
    tx, pr = brands(spark, d)
    return encode.priced(tx, pr.where("item % 5 <> 0") if unpriced == "zero" else pr, unpriced)


def shown_eu(eu: Column | None = None) -> Column:
    """Four digits; the millionth keeps values that end in half a digit on one side, whatever the order of the sum."""
    return F.round((F.col("eu") if eu is None else eu) + 1e-6, 4)


def shown_ep(ep: Column | None = None) -> Column:
    return F.round((F.col("ep") if ep is None else ep) + 1e-8, 6)


# Sources


@query("s1_profit_source", f"with {BRANDS}, {PROFITS} select item, round(profit, 6) as profit from pr")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Profit lines, with a stale line before each and broken ones between."""
    pr = tables.signed_profits(tables.from_lines(spark, d))
    row = pr.select(
        "item", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat_ws(" ", "item", F.lit("999")).alias("v")), F.struct(F.lit(1).alias("n"), F.concat(F.lit(" "), F.concat_ws("\t", "item", "profit")).alias("v")), F.struct(F.lit(2).alias("n"), F.concat_ws(" ", "item", F.lit("1 x")).alias("v")))).alias("l")
    )
    lines = row.select((F.col("item").cast("long") * 10 + F.col("l.n")).alias("line_no"), F.col("l.v").alias("value"))
    return text.parse_profits(lines).select("item", F.round("profit", 6).alias("profit"))


@query("s2_transaction_source", f"with {BRANDS} select tid, item, quantity::int as quantity, round(prob, 6) as prob from db")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Lines of tokens, each item first with a stale token, broken tokens between."""
    tx, _ = brands(spark, d)
    token = F.concat(F.concat_ws(":", "item", F.lit("1"), F.lit("0.1")), F.lit(" 7:7 "), F.concat_ws(":", "item", F.col("quantity").cast("int"), "prob"), F.lit(":"))
    lines = tx.groupBy(F.col("tid").alias("line_no")).agg(F.array_join(F.collect_list(token), "  ").alias("value"))
    return text.parse_transactions(lines).select("tid", "item", "quantity", F.round("prob", 6).alias("prob"))


@query("s2_dense_tids", f"with {BRANDS}, n as (select tid, row_number() over (order by tid)::bigint as dense from (select distinct tid from db)) select dense as tid, item, quantity from db join n using (tid)")
def s2_dense(spark: SparkSession, d: str) -> DataFrame:
    return text.dense_tids(tables.from_lines(spark, d).select("tid", "item", "quantity"))


#: What the metrics of a made output are, as SQL that both engines read alike.
SCANNED = {
    "execution_time": "execution_time", "database_size": "database_size", "num_items": "case when run % 2 = 0 then num_items end", "items_after_filter": "run % 50",
    "candidates_generated": "candidates_generated", "utility_lists_created": "run % 1000", "rtwu_pruned": "rtwu_pruned", "branches_pruned": "branches_pruned",
    "bulk_branches_pruned": "bulk_branches_pruned", "eu_remaining_pruned": "eu_remaining_pruned", "ep_pruned": "ep_pruned", "total_pruned": "total_pruned",
    "peak_memory_reported": "run % 4096", "topk_found": "cast(k as bigint)", "final_threshold": "cast(run % 1000 as double) / 4", "successful_updates": "run % 77", "cas_retries": "run % 13",
    "cas_efficiency": "cas_efficiency", "thread_pool_size": "cast(thread_pool_size as bigint)",
}


#: What a run prints, line by line, as format strings with the metric that each shows.
PRINTED = (
    ("Database size: %d", "database_size"), ("Number of items: %d", "num_items"), ("Thread pool size: %d", "thread_pool_size"), ("Items after filtering: %d", "items_after_filter"),
    ("Execution time: %d ms", "execution_time"), ("Candidates generated: %d", "candidates_generated"), ("Utility lists created: %d", "utility_lists_created"),
    ("Enhanced pruning statistics:", None), ("  - RTWU pruned: %d", "rtwu_pruned"), ("  - Branches pruned: %d", "branches_pruned"), ("  - Bulk branches pruned: %d", "bulk_branches_pruned"),
    ("  - EU+remaining pruned: %d", "eu_remaining_pruned"), ("  - Existential probability pruned: %d", "ep_pruned"), ("  - Total pruned: %d", "total_pruned"),
    ("Peak memory usage: %d MB", "peak_memory_reported"), ("Final threshold: %.4f", "final_threshold"), ("Top-K found: %d", "topk_found"), ("Lock-free TopK statistics:", None),
    ("  - Successful updates: %d", "successful_updates"), ("  - CAS retries: %d", "cas_retries"), ("  - CAS efficiency: %.2f%%", "cas_efficiency"),
)


S7_SQL = f"""with {records.RUNS_SQL} select run, {", ".join(f"{x} as {n}" for n, x in SCANNED.items())},
  round(total_pruned / candidates_generated, 6) as pruning_ratio,
  round(case when execution_time > 0 then database_size / (execution_time / 1000) end, 6) as transactions_per_second from runs"""


@query("s7_metric_scan", S7_SQL)
def s7(spark: SparkSession, d: str) -> DataFrame:
    """All metrics from outputs as a run prints them; every third is in capitals, and in every second the number of items isn't printed."""
    made = records.synthetic_runs(spark, d).selectExpr("run", *[f"{x} as {n}" for n, x in SCANNED.items()])
    lines = [F.format_string(line, F.col(n)) if n else F.lit(line) for line, n in PRINTED]
    shown = [F.when(F.col(n).isNotNull(), x) if n else x for x, (_, n) in zip(lines, PRINTED, strict=True)]
    text_of = F.concat_ws("\n", F.lit("=== start ==="), *shown)
    out = records.scan_metrics(made.select("run", F.when(F.col("run") % 3 == 0, F.upper(text_of)).otherwise(text_of).alias("output")))
    return out.select("run", *records.METRICS, F.round("pruning_ratio", 6).alias("pruning_ratio"), F.round("transactions_per_second", 6).alias("transactions_per_second"))


@query("s8_union_of_rows", f"""with {records.RUNS_SQL} select run, status, dataset, execution_time_ms, null::varchar as error from runs where status = 'SUCCESS'
  union all select run, status, dataset, null, 'exit 1' from runs where status = 'FAILED'""")
def s8(spark: SparkSession, d: str) -> DataFrame:
    r = records.synthetic_runs(spark, d)
    good = r.where("status = 'SUCCESS'").select("run", "status", "dataset", "execution_time_ms")
    return records.combined(good, r.where("status = 'FAILED'").select("run", "dataset", "status", F.lit("exit 1").alias("error")))


@query("s9_successful_runs", f"with {records.RUNS_SQL} select run, status, k from good")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV and JSON and loaded again, half from each."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/runs-{uuid.uuid4().hex}"
    records.save(records.synthetic_runs(spark, d).select("run", "status", "k", "dataset"), path)
    schema = "status string, k int, run long"
    parts = [records.load(spark, path, schema, kind).where(F.col("run") % 2 == n) for n, kind in enumerate(("csv", "json"))]
    return parts[0].unionByName(parts[1]).select("run", "status", "k")


@query("s10_newest", "select max_by(o_orderpriority || '-' || o_orderkey, o_orderkey) as path from orders where o_orderdate = (select max(o_orderdate) from orders)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    files = o.select(F.concat_ws("-", "o_orderpriority", "o_orderkey").alias("path"), F.struct("o_orderdate", "o_orderkey").alias("modified"))
    return records.newest(files)


# Projections, filters, aggregates and windows of the encoding


@query("p1_p5_priced", f"with {BRANDS}, {PROFITS}, {BASE} select tid, item, round(u, 6) as u, round(p, 6) as p from b")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("tid", "item", F.round("u", 6).alias("u"), F.round("p", 6).alias("p"))


@query("p5_unpriced_zero", f"with {BRANDS}, {PROFITS}, {ZERO} select tid, item, round(u, 6) as u, round(p, 6) as p from b")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d, "zero").select("tid", "item", F.round("u", 6).alias("u"), F.round("p", 6).alias("p"))


@query("p2_log_probability", f"with {BRANDS}, {PROFITS}, {BASE} select tid, item, round(ln(p), 6) as lp from b")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).select("tid", "item", F.round(F.ln("p"), 6).alias("lp"))


@query("a1_a9_transaction_utility", f"with {BRANDS}, {PROFITS}, {BASE} select tid, round(sum(greatest(u, 0)), 4) as rtu, round(sum(greatest(u, 0)), 4) as ptu, round(sum(least(u, 0)), 4) as ntu from b group by tid")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return encode.transaction_utility(base(spark, d)).select("tid", *[F.round(c, 4).alias(c) for c in ("rtu", "ptu", "ntu")])


def bounds_rounded(frame: DataFrame) -> DataFrame:
    return frame.select("item", *[F.round(c, 4).alias(c) for c in ("rtwu", "rtwu_weighted", "support")], "frequency")


ROUNDED = "item, round(rtwu, 4) as rtwu, round(rtwu_weighted, 4) as rtwu_weighted, round(support, 4) as support, frequency"


@query("a2_a7_a8_item_bounds", f"with {BRANDS}, {PROFITS}, {BASE}, {RTU}, {BOUNDS} select {ROUNDED} from w")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return bounds_rounded(encode.item_bounds(base(spark, d)))


@query("a2_part_bounds", f"with {PARTS}, {PROFITS}, {BASE}, {RTU}, {BOUNDS} select {ROUNDED} from w")
def a2_parts(spark: SparkSession, d: str) -> DataFrame:
    tx = tables.from_lines(spark, d, "part")
    n = tables.count_lines(spark, d)
    priced = encode.priced(tables.dealt(tx, n, "item"), tables.signed_profits(tx))
    return bounds_rounded(encode.item_bounds(tables.dealt(priced, n, "tid")))


@query("p8_p12_p13_promising", f"with {BRANDS}, {PROFITS}, {BASE}, {RTU}, {BOUNDS} select item from w where rtwu_weighted > 0 and rtwu_weighted >= (select avg(rtwu_weighted) from w) and support >= (select avg(support) from w) * 0.9")
def p8(spark: SparkSession, d: str) -> DataFrame:
    bounds = encode.item_bounds(base(spark, d))
    mean = bounds.agg(F.avg("rtwu_weighted").alias("_bound"), F.avg("support").alias("_support"))
    enough = encode.promising(bounds.join(F.broadcast(mean)), "rtwu_weighted")  # one row of means
    return enough.where((F.col("rtwu_weighted") >= F.col("_bound")) & (F.col("support") >= F.col("_support") * 0.9)).select("item")


@query("w1_item_ranks", f"with {BRANDS}, {PROFITS}, {BASE}, {RTU}, {BOUNDS}, {RANKS} select item, round(bound, 4) as bound, rank from r")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return encode.item_ranks(encode.item_bounds(base(spark, d))).select("item", F.round("bound", 4).alias("bound"), "rank")


@query("w2_suffix_sums", f"with {BRANDS}, {PROFITS}, {BASE}, {RTU}, {BOUNDS}, {RANKS}, {REM} select tid, item, rank, round(rem, 4) as rem from m")
def w2(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    return encode.ranked_base(b, encode.item_ranks(encode.item_bounds(b))).select("tid", "item", "rank", F.round("rem", 4).alias("rem"))


# Measures of itemsets


@query("a3_a4_a5_singles", f"""with {BRANDS}, {PROFITS}, {BASE}, {RTU}, {BOUNDS}, {RANKS}, {REM}
  select item, round(sum(u * p) + 1e-6, 4) as eu, round(1 - product(1 - p) + 1e-8, 6) as ep, round(sum(greatest(u + rem, 0) * p), 4) as ub from m group by item""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    tails = encode.as_tails(encode.ranked_base(b, encode.item_ranks(encode.item_bounds(b))))
    return search.measured(search.first_level(tails)).select(F.col("items")[0].alias("item"), shown_eu().alias("eu"), shown_ep().alias("ep"), F.round("ub", 4).alias("ub"))


@query("a5b_probability_by_logarithms", f"with {EVENTS}, {PROFITS}, {BASE} select item, round(1 - product(1 - p) + 1e-8, 6) as ep from b group by item")
def a5b(spark: SparkSession, d: str) -> DataFrame:
    tx = tables.from_events(spark, d)
    b = encode.priced(tx, tables.signed_profits(tx))
    return b.groupBy("item").agg(shown_ep(measures.existential_probability_log()).alias("ep"))


@query("a6_pair_bounds", f"with {BRANDS}, {PROFITS}, {BASE}, {RTU} select x.item as i1, y.item as i2, round(sum(rtu * x.p * y.p), 4) as bound from b x join b y on x.tid = y.tid and x.item < y.item join t on t.tid = x.tid group by 1, 2")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_bounds(base(spark, d)).select("i1", "i2", F.round("bound", 4).alias("bound"))


@query("j3_j4_pair_measures", f"with {BRANDS}, {PROFITS}, {BASE} select x.item as i1, y.item as i2, round(sum((x.u + y.u) * x.p * y.p) + 1e-6, 4) as eu, round(1 - product(1 - x.p * y.p) + 1e-8, 6) as ep, count(*) as n from b x join b y on x.tid = y.tid and x.item < y.item group by 1, 2")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_rows(base(spark, d)).groupBy("i1", "i2").agg(
        shown_eu(measures.expected_utility()).alias("eu"), shown_ep(measures.existential_probability()).alias("ep"), F.count("*").alias("n")
    )


@query("j5_pair_semijoin", f"""with {BRANDS}, {PROFITS}, {BASE}, {RTU}, e as (select x.item as i1, y.item as i2, sum(rtu * x.p * y.p) as bound from b x join b y on x.tid = y.tid and x.item < y.item join t on t.tid = x.tid group by 1, 2)
  select x.tid, x.item as i1, y.item as i2 from b x join b y on x.tid = y.tid and x.item < y.item where (x.item, y.item) in (select (i1, i2) from e where bound >= (select avg(bound) from e))""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    b = base(spark, d)
    bounds = stash(pairs.pair_bounds(b), "pair-bounds")
    able = pairs.promising_pairs(bounds, bounds.agg(F.avg("bound")).first()[0])
    return pairs.pair_rows(b).select("tid", "i1", "i2").join(able, ["i1", "i2"], "left_semi").select("tid", "i1", "i2")


@query("j6_third_level", f"with recursive {BRANDS}, {PROFITS}, {BASE}, {lev(3)} select array_to_string(list_sort(x), ' ') as items, round(sum(u * p) + 1e-6, 4) as eu, round(1 - product(1 - p) + 1e-8, 6) as ep, count(*) as n from lev where len(x) = 3 group by x having 1 - product(1 - p) >= 0.3 - 1e-10")
def j6(spark: SparkSession, d: str) -> DataFrame:
    """All triples that are likely enough: survivors by probability alone, level by level."""
    b = base(spark, d)
    level = search.first_level(encode.as_tails(encode.ranked_base(b, encode.item_ranks(encode.item_bounds(b)))))
    for _ in range(2):
        level = search.grown(level, search.measured(level).where(F.col("ep") >= 0.3 - 1e-10).select("items"))
    return search.measured(level).where(F.col("ep") >= 0.3 - 1e-10).select(F.array_join(F.array_sort("items"), " ").alias("items"), shown_eu().alias("eu"), shown_ep().alias("ep"), "n")


def top_sql(db: str, k: int, min_pro: float, longest: int | None = None, of: str = BASE, min_support: float = 0.0) -> str:
    kept = f", w as (select item from b group by item having sum(p) >= {min_support})" if min_support else ""
    use = lev(longest).replace("from b\n", "from b where item in (select item from w)\n").replace("join b on", "join (select * from b where item in (select item from w)) b on") if min_support else lev(longest)
    return f"""with recursive {db}, {PROFITS}, {of}{kept}, {use},
s as (select list_sort(x) as x, sum(u * p) as eu, 1 - product(1 - p) as ep from lev group by x having 1 - product(1 - p) >= {min_pro} - 1e-10 and sum(u * p) >= -1e-10)
select (row_number() over (order by round(eu, 6) desc, len(x), x))::int as rank, array_to_string(x, ' ') as items, round(eu + 1e-6, 4) as eu, round(ep + 1e-8, 6) as ep from s order by rank limit {k}"""


def shown(mined: search.Mined, spark: SparkSession) -> DataFrame:
    return mined.frame(spark).select("rank", F.array_join("items", " ").alias("items"), shown_eu().alias("eu"), shown_ep().alias("ep"))


#: Settings that one search finds all results of.
SHARED = ((20, 0.1), (100, 0.5), (50, 0.2), (10, 0.2))


def topk(name: str, k: int, min_pro: float, source: str = "brands", db: str = BRANDS, of: str = BASE, **options) -> None:
    @query(name, top_sql(db, k, min_pro, options.get("max_len"), of, options.get("min_support", 0.0)))
    def run(spark: SparkSession, d: str) -> DataFrame:
        tx = {"brands": tables.from_lines, "events": tables.from_events, "parts": lambda s, x: tables.from_lines(s, x, "part")}[source](spark, d)
        pr = tables.signed_profits(tx) if source == "events" else tables.part_profits(spark, d, "brand" if source == "brands" else "part")
        if options.get("unpriced") == "zero":
            pr = pr.where("item % 5 <> 0")
        return shown(search.mine(tables.validate(tx), pr, k, min_pro, **options), spark)


topk("t1_topk_20", 20, 0.1)
topk("t1_topk_100", 100, 0.5)
topk("t1_topk_500", 500, 0.2)
topk("t1_topk_unweighted", 50, 0.1, weighted=False)
topk("t1_topk_pair_pruning", 50, 0.1, pairs=True)
topk("t1_topk_max_two", 40, 0.05, max_len=2)
topk("t1_topk_unpriced_zero", 50, 0.1, of=ZERO, unpriced="zero")
topk("t1_topk_min_support", 50, 0.1, min_support=280.0)
topk("t1_topk_events", 31, 0.001, source="events", db=EVENTS)
topk("t1_topk_parts", 100, 0.5, source="parts", db=PARTS)


@query("a11_threshold", f"with t as ({top_sql(BRANDS, 25, 0.2)}) select round(min(eu), 2) as threshold from t")
def a11(spark: SparkSession, d: str) -> DataFrame:
    tx, pr = brands(spark, d)
    return spark.createDataFrame([(search.mine(tx, pr, 25, 0.2).threshold,)], "threshold double").select(F.round("threshold", 2).alias("threshold"))


@query("t1_shared_settings", " union all ".join(f"select {k} as k, {mp}::double as min_pro, rank, items, eu, ep from ({top_sql(BRANDS, k, mp)})" for k, mp in SHARED))
def t1_shared(spark: SparkSession, d: str) -> DataFrame:
    """Several settings by one search."""
    tx, pr = brands(spark, d)
    found = [shown(m, spark).select(F.lit(k).alias("k"), F.lit(mp).alias("min_pro"), "*") for (k, mp), m in zip(SHARED, search.mine_settings(tx, pr, list(SHARED)), strict=True)]
    return reduce(DataFrame.unionByName, found)


COUNTED_SQL = f"""with {BRANDS}, {PROFITS}, {BASE}, {RTU}, {BOUNDS}, {RANKS}, {REM},
  l1 as (select item as a, count(*) as n, 1 - product(1 - p) as ep from m group by 1),
  k1 as (select a from l1 where ep >= 0.99 - 1e-10),
  f as (select * from m where item in (select a from k1)),
  l2 as (select x.item as a, y.item as b, count(*) as n, 1 - product(1 - x.p * y.p) as ep from f x join f y on x.tid = y.tid and x.rank < y.rank group by 1, 2),
  l3 as (select x.item as a, y.item as b, z.item as c, count(*) as n, 1 - product(1 - x.p * y.p * z.p) as ep from f x join f y on x.tid = y.tid and x.rank < y.rank
    join f z on z.tid = y.tid and y.rank < z.rank where (x.item, y.item) in (select (a, b) from l2 where ep >= 0.99 - 1e-10) group by 1, 2, 3),
  l as (select 1 as level, n, ep from l1 where a in (select a from k1) union all select 2, n, ep from l2 union all select 3, n, ep from l3)
select level::int as level, count(*) as candidates, sum(n)::bigint as occurrences, 0::bigint as rtwu_pruned, 0::bigint as pair_pruned,
  count(*) filter (ep < 0.99 - 1e-10) as ep_pruned, 0::bigint as ub_pruned, count(*) filter (ep >= 0.99 - 1e-10) as survivors, 0::double as threshold from l group by 1"""


@query("a12_level_statistics", COUNTED_SQL)
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Counts by level of a search that finds all likely itemsets of three items at most: with a k that large the threshold stays zero."""
    tx, pr = brands(spark, d)
    return search.mine(tx, pr, 10**6, 0.99, max_len=3).stats(spark).drop("peak_memory_mb", "batches")


@query("a12_search_statistics")
def a12_search(spark: SparkSession, d: str) -> DataFrame:
    """Counts and peak memory by level; what is pruned depends on the thresholds of the search, so there is no SQL."""
    tx, pr = brands(spark, d)
    return search.mine(tx, pr, 20, 0.1, pairs=True).stats(spark)


SWEPT = {"brands": (BRANDS, tables.from_lines), "events": (EVENTS, tables.from_events)}
SWEPT_KS, SWEPT_PROBS = (5, 50), (0.1, 0.5)


def swept(spark: SparkSession, d: str) -> DataFrame:
    """The records of a sweep over the driver's tables."""

    def of(make: Callable[[SparkSession, str], DataFrame]) -> sweeps.Dataset:
        def read(s: SparkSession) -> tuple[DataFrame, DataFrame]:
            tx = make(s, d)
            return tx, tables.signed_profits(tx)

        return read

    return sweeps.sweep(spark, {n: of(make) for n, (_, make) in SWEPT.items()}, SWEPT_KS, SWEPT_PROBS, parallel=2)


def swept_sql() -> str:
    one = "select '{n}' as dataset, {k} as k, {p}::double as min_prob, 'SUCCESS' as status, count(*) as topk_found, round(case when count(*) = {k} then min(eu) else 0 end, 2) as final_threshold from ({q})"
    found = [one.format(n=n, k=k, p=p, q=top_sql(db, k, p)) for n, (db, _) in SWEPT.items() for k in SWEPT_KS for p in SWEPT_PROBS]
    sizes = [f"select '{n}' as dataset, count(distinct tid) as database_size, count(distinct item) as num_items from (with {db} select * from db)" for n, (db, _) in SWEPT.items()]
    return f"select * from ({' union all '.join(found)}) join ({' union all '.join(sizes)}) using (dataset)"


@query("sweep_runs", swept_sql())
def sweep_runs(spark: SparkSession, d: str) -> DataFrame:
    """What real runs of a grid found."""
    return swept(spark, d).select("dataset", "k", "min_prob", "status", "topk_found", F.round(F.col("final_threshold") + 1e-6, 2).alias("final_threshold"), "database_size", "num_items")


@query("sweep_averages")
def sweep_averages(spark: SparkSession, d: str) -> DataFrame:
    """Times, memory and counts of real runs by setting; they differ from run to run, so there is no SQL."""
    return reports.averages(records.successful(swept(spark, d)))


@query("s4_configuration", f"""with {BRANDS} select printf('transactions %d, items %d, k 20, least probability 0.1, cores 8', count(distinct tid), count(distinct item)) as line from db""")
def s4(spark: SparkSession, d: str) -> DataFrame:
    size = tables.from_lines(spark, d).agg(F.count_distinct("tid"), F.count_distinct("item")).first()
    return spark.createDataFrame([(printing.configuration(size[0], size[1], 20, 0.1, 8),)], "line string")


@query("s5_ranked_lines", f"with t as ({top_sql(BRANDS, 20, 0.1)}) select printf('%d. {{%s}}: utility %.2f, probability %.4f', rank, replace(items, ' ', ', '), eu, ep) as line from t")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """The result as it is printed, from utilities of four digits."""
    tx, pr = brands(spark, d)
    found = shown(search.mine(tx, pr, 20, 0.1), spark).collect()
    rows = [([int(i) for i in r["items"].split()], r["eu"], r["ep"]) for r in found]
    return spark.createDataFrame([(x,) for x in printing.ranked(search.Mined(rows, 0.0))], "line string")


# Reports


def report(name: str, select: str, f: Callable[[DataFrame], DataFrame], good: bool = True) -> None:
    # The nudge keeps values that end in half a digit on one side, whatever the order of a sum.
    select = re.sub(r"round\((.*?), (\d)\) as", lambda m: f"round({m[1]} + 1e-{int(m[2]) + 3}, {m[2]}) as", select)

    @query(name, f"with {records.RUNS_SQL} {select}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = records.derived(records.synthetic_runs(spark, d))
        return f(records.successful(r) if good else r)


def near(name: str, digits: int) -> Column:
    return F.round(F.col(f"`{name}`") + 10.0 ** -(digits + 3), digits).alias(name)


def rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    return frame.select(*[near(c, digits) if t == "double" and c != "min_prob" else F.col(f"`{c}`") for c, t in frame.dtypes])


def sql_mean(*metrics: str, deviation: bool = False) -> str:
    return ", ".join([f"round(avg({m}), 4) as avg_{m}" for m in metrics] + [f"round(coalesce(stddev_samp({m}), 0), 4) as std_{m}" for m in metrics if deviation])


def sql_pivot(rows: str, across: str, values: list, metric: str, prefix: str) -> str:
    of = lambda v: f"'{v}'" if isinstance(v, str) else v
    return f"select {rows}, " + ", ".join(f"round(avg({metric}) filter ({across} = {of(v)}), 4) as {prefix}{v}" for v in values) + f" from good group by {rows}"


report("a14_averages", f"select dataset, k, min_prob, count(*) as runs, {sql_mean(*reports.AVERAGED, deviation=True)} from good group by all", lambda r: rounded(reports.averages(r)))
report("a15_derived", "select run, round(pruning_ratio, 6) as pruning_ratio, round(pruning_percentage, 6) as pruning_percentage, round(transactions_per_second, 6) as transactions_per_second from good", lambda r: rounded(r.select("run", "pruning_ratio", "pruning_percentage", "transactions_per_second"), 6))
report("a16_status", "select count(*) as total, count(*) filter (status = 'SUCCESS') as success, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'TIMEOUT') as timeout, round(avg(execution_time_ms) filter (status = 'SUCCESS'), 4) as mean_time_ms, round(avg(peak_memory_mb) filter (status = 'SUCCESS'), 4) as mean_memory_mb from runs", lambda r: rounded(reports.status_counts(r)), good=False)
report("a17_time_pivot", sql_pivot("k", "dataset", DATASETS, "execution_time_ms", ""), lambda r: rounded(reports.pivot_mean(r, "k", "dataset", DATASETS, "execution_time_ms", "")))
report("a18_pruning_by_dataset", f"select dataset, {sql_mean('pruning_percentage')} from good group by 1", lambda r: rounded(reports.mean_by(r, "dataset", "pruning_percentage")))
report("a19_by_size", f"select database_size, {sql_mean('execution_time_ms', 'peak_memory_mb')} from good group by 1", lambda r: rounded(reports.mean_by(r, "database_size", "execution_time_ms", "peak_memory_mb")))
report("a20_by_k", f"select k, {sql_mean('execution_time_ms', deviation=True)} from good group by 1", lambda r: rounded(reports.mean_by(r, "k", "execution_time_ms", deviation=True)))
report("a20_by_min_prob", f"select min_prob, {sql_mean('execution_time_ms', deviation=True)} from good group by 1", lambda r: rounded(reports.mean_by(r, "min_prob", "execution_time_ms", deviation=True)))
report("a21_throughput", sql_pivot("k", "dataset", DATASETS, "transactions_per_second", ""), lambda r: rounded(reports.throughput_pivot(r, DATASETS)))
report("a22_histogram", "select bin, n, round(lo_all + (bin - 1) * w, 4) as lo, round(lo_all + bin * w, 4) as hi from (select least(floor((cas_efficiency - lo_all) / w) + 1, 20)::int as bin, lo_all, w, count(*) as n from good, (select min(cas_efficiency) as lo_all, (max(cas_efficiency) - min(cas_efficiency)) / 20 as w from good) group by all)", lambda r: rounded(reports.histogram(r, "cas_efficiency")))
report("a22_center", "select round(avg(cas_efficiency), 4) as mean, median(cas_efficiency) as median from good", lambda r: rounded(reports.center(r, "cas_efficiency")))
report("a23_summary", " union all ".join(f"select '{m}' as metric, round(avg({m}), 4) as mean, round(coalesce(stddev_samp({m}), 0), 4) as std, round(min({m}), 4) as min, round(max({m}), 4) as max from good" for m in reports.SUMMARY), lambda r: rounded(reports.summary(r)))
report("a24_pruning_shares", " union all ".join(f"select '{c}' as counter, sum({c})::bigint as total, round(sum({c}) / sum({' + '.join(reports.PRUNED)}), 6) as share from good" for c in reports.PRUNED), lambda r: rounded(reports.pruning_shares(r), 6))
report("a25_by_threads", "select thread_pool_size, round(avg(execution_time_ms), 4) as avg_execution_time_ms, round(avg(speedup), 6) as avg_speedup from (select *, min(execution_time_ms) over (partition by dataset) / execution_time_ms as speedup from good) group by 1", lambda r: reports.mean_by(reports.with_speedup(r), "thread_pool_size", "execution_time_ms", "speedup").select("thread_pool_size", near("avg_execution_time_ms", 4), near("avg_speedup", 6)))
for metric in ("execution_time_ms", "peak_memory_mb", "pruning_percentage"):
    report(f"a26_heatmap_{metric}", sql_pivot("min_prob", "k", KS, metric, "k"), lambda r, m=metric: rounded(reports.pivot_mean(r, "min_prob", "k", KS, m, "k")))
BOXES = """, b as (select dataset, quantile_cont(peak_memory_mb, 0.25) as q1, quantile_cont(peak_memory_mb, 0.5) as q2, quantile_cont(peak_memory_mb, 0.75) as q3 from good group by 1),
  f as (select good.*, q1, q2, q3, peak_memory_mb < q1 - 1.5 * (q3 - q1) or peak_memory_mb > q3 + 1.5 * (q3 - q1) as beyond from good join b using (dataset))"""
report(
    "a27_box_plot",
    f"""{BOXES} select dataset, round(any_value(q1), 4) as q1, round(any_value(q2), 4) as q2, round(any_value(q3), 4) as q3,
    round(min(peak_memory_mb) filter (not beyond), 4) as whisker_low, round(max(peak_memory_mb) filter (not beyond), 4) as whisker_high,
    count(*) filter (beyond) as outliers, round(min(peak_memory_mb), 4) as least, round(max(peak_memory_mb), 4) as largest from f group by 1""",
    lambda r: rounded(quantiles.box_plot(r, "dataset", "peak_memory_mb")),
)
report("a27_outliers", f"{BOXES} select run, dataset, round(peak_memory_mb, 4) as peak_memory_mb from f where beyond", lambda r: rounded(quantiles.outliers(r, "dataset", "peak_memory_mb").select("run", "dataset", "peak_memory_mb")))
report("a27_quantiles", "select dataset, round(quantile_cont(peak_memory_mb, 0.25), 4) as q1, round(quantile_cont(peak_memory_mb, 0.5), 4) as q2, round(quantile_cont(peak_memory_mb, 0.75), 4) as q3, round(min(peak_memory_mb), 4) as least, round(max(peak_memory_mb), 4) as largest from good group by 1", lambda r: rounded(reports.quantiles(r, "dataset", "peak_memory_mb")))
report("a28_line_fit", "select round(regr_slope(peak_memory_mb, database_size), 8) as slope, round(regr_intercept(peak_memory_mb, database_size), 4) as intercept from good", lambda r: reports.line_fit(r, F.col("database_size"), F.col("peak_memory_mb")).select(near("slope", 8), near("intercept", 4)))
report("a28_log_fit", "select round(regr_slope(ln(execution_time_ms), ln(database_size * num_items)), 6) as slope, round(regr_intercept(ln(execution_time_ms), ln(database_size * num_items)), 6) as intercept from good", lambda r: rounded(reports.line_fit(r, F.ln(F.col("database_size") * F.col("num_items")), F.ln("execution_time_ms")), 6))
report("a28_curve_fit", """, z as (select k::double - (select avg(k) from good) as d, execution_time_ms as y from good),
  s as (select (select avg(k) from good) as m, count(*)::double as n, sum(d*d) as s2, sum(d*d*d) as s3, sum(d*d*d*d) as s4, sum(y) as t0, sum(d*y) as t1, sum(d*d*y) as t2 from z),
  c as (select *, (t2 - s2*t0/n - s3*t1/s2) / (s4 - s2*s2/n - s3*s3/s2) as a from s),
  e as (select *, (t1 - a*s3)/s2 as b0, (t0 - a*s2)/n as c0 from c)
  select round(a, 7) as a, round(b0 - 2*a*m, 4) as b, round(c0 - b0*m + a*m*m, 2) as c from e""", lambda r: reports.curve_fit(r, "k", "execution_time_ms").select(near("a", 7), near("b", 4), near("c", 2)))
report("a29_group_means", " union all ".join(f"select '{g}' as \"grouping\", {v} as value, round(avg(execution_time_ms), 4) as time_ms, round(avg(peak_memory_mb), 4) as memory_mb, round(avg(pruning_percentage), 4) as pruning from good group by {g}" for g, v in (("dataset", "dataset"), ("k", "k::varchar"), ("min_prob", "printf('%.5f', min_prob)"))), lambda r: rounded(reports.group_means(r)))
report("w4_speedup", "select run, round(min(execution_time_ms) over (partition by dataset) / execution_time_ms, 6) as speedup from good", lambda r: reports.with_speedup(r).select("run", near("speedup", 6)))
report("t5_extremes", "select (select run from good order by execution_time_ms, run limit 1) as fastest, round(min(execution_time_ms), 4) as fastest_ms, (select run from good order by pruning_percentage desc, run limit 1) as most_pruned, round(max(pruning_percentage), 4) as most_pruning from good", lambda r: rounded(reports.extremes(r)))
report("s11_performance_table", "select dataset, round(avg(execution_time_ms), 4) as time_ms, round(avg(peak_memory_mb), 4) as memory_mb, round(avg(pruning_percentage), 4) as pruning, round(avg(transactions_per_second), 4) as throughput, round(avg(speedup), 4) as speedup from (select *, min(execution_time_ms) over (partition by dataset) / execution_time_ms as speedup from good) group by 1", lambda r: rounded(reports.performance_table(r)))
report("s11_sensitivity_table", "select 'k' as parameter, k::double as setting, round(avg(execution_time_ms), 4) as time_ms from good group by k union all select 'min_prob', min_prob, round(avg(execution_time_ms), 4) as time_ms from good group by min_prob", lambda r: reports.sensitivity_table(r).select("parameter", "setting", near("time_ms", 4)))
report("s11_latex_rows", r"select printf('%s & %.1f & %.1f & %.1f & %.0f & %.2f \\', dataset, avg(execution_time_ms), avg(peak_memory_mb), avg(pruning_percentage), avg(transactions_per_second), avg(speedup)) as line from (select *, min(execution_time_ms) over (partition by dataset) / execution_time_ms as speedup from good) group by dataset union all select printf('k & %.3f & %.1f \\', k::double, avg(execution_time_ms)) from good group by k union all select printf('min\_prob & %.3f & %.1f \\', min_prob, avg(execution_time_ms)) from good group by min_prob", lambda r: latex_rows(r))
report("s12_best_runs", "(select 'fastest' as kind, dataset, k, min_prob, round(execution_time_ms, 4) as reached from good order by execution_time_ms, run limit 1) union all (select 'most pruned', dataset, k, min_prob, round(pruning_percentage, 4) as reached from good order by pruning_percentage desc, run limit 1)", lambda r: rounded(reports.best_runs(r)))
report("s12_grades", "select 'pruning_percentage' as metric, round(avg(pruning_percentage), 4) as mean, case when avg(pruning_percentage) > 90 then 'excellent' when avg(pruning_percentage) > 80 then 'good' else 'improve' end as grade from good union all select 'cas_efficiency', round(avg(cas_efficiency), 4) as mean, case when avg(cas_efficiency) > 95 then 'excellent' when avg(cas_efficiency) > 90 then 'good' else 'improve' end from good", lambda r: rounded(reports.grades(r)))


def latex_rows(runs: DataFrame) -> DataFrame:
    """The body lines of both tables of a paper, as ``latex_tables`` writes them."""
    lines = [x for x in reports.latex_tables(runs).split("\n") if " & " in x and not x.startswith(("dataset &", "parameter &"))]
    return runs.sparkSession.createDataFrame([(x,) for x in lines], "line string")
