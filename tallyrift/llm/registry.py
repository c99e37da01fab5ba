"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccardjoin, lmscore, mixing, packing, piecefst, pii, resample, sharding, topk, toxicity, urlfilter, vectordup, whitening

#: The rules of op1.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SHARD_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"), rules)


OP1_SQL = """
with p as (
  select page_id,
    case when contains(coalesce(url,''), '://') then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages),
u as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(rhost, rpath, v) as (values ('net','/','block'), ('example.net','/en/','allow'), ('example.com','/de/','block'), ('org','/fr/','allow')),
best as (
  select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(v, length(rhost || rpath)) as v
  from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from u left join best using (page_id)
"""


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP2_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    of = lambda *names: F.filter("entities", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.span_list(of(*pii.BASE)), 256).alias("base_sha256"),
        pii.span_list(F.col("entities")).alias("spans"),
        F.coalesce(F.array_max(F.transform("entities", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


TOXIC_FROM = 0.7


def fold(parts: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def toxic_trains() -> Column:
    """Which labels may be learned from."""
    return fold(3) != 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxic_trains())
    return found.select("doc_id", (~toxic_trains()).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "evidence")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


OP6_SQL = """
with recursive e as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select vec_id, v, sqrt(list_inner_product(v, v)) as len from e where list_inner_product(v, v) > 0),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id
      where list_inner_product(a.v, b.v) / (a.len * b.len) >= 0.9),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join l on r.b = l.a)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links,
  (select min(b) from reach r where r.a = vec_id) as component_id,
  vec_id = (select min(b) from reach r where r.a = vec_id) as kept from embeddings
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecefst.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_text=True)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmscore.lm_scores(table(spark, sf_dir, "documents"), fold(10) != 0)
    return found.withColumn("held_out", ~F.col("trains")).drop("trains")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.jaccard_links(table(spark, sf_dir, "documents")).drop("text_key")


OP10_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where c >= 0.8 * (a.n + b.n - c) - 1e-9),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.y from reach r join l on r.b = l.x)
select doc_id, (select count(*) from l where x = doc_id) as n_links, (select min(b) from reach where a = doc_id) as class_id,
  doc_id = (select min(b) from reach where a = doc_id) as kept from documents
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=32)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(mixing.fair_queue(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0), most=3))


OP13_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    ('0x' || substr(sha256('13:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
s as (
  select source, sum(size)::bigint as source_size, ((row_number() over (order by source is null, source) - 1) % 3 + 1)::double as weight
  from d group by source),
b as (select sum(source_size)::bigint as budget, sum(weight) as total from s),
f as (
  select *, 3 * source_size as full_at, sum(3 * source_size) over o - 3 * source_size as before, total - (sum(weight) over o - weight) as left_over
  from s, b window o as (order by 3 * source_size / weight, source is null, source)),
share as (select max((budget - before) / left_over) as share from f where (budget - before) / left_over * weight <= full_at),
t as (select source, source_size, coalesce(least((3 * source_size)::double, share * weight), (3 * source_size)::double) as target from s, share),
q as (
  select doc_id, d.source, size, source_size, target,
    sum(size) over (partition by d.source order by h, doc_id nulls last, size rows unbounded preceding)::bigint as so_far
  from d join t on d.source is not distinct from t.source),
c as (
  select source, so_far, n, size, (n * source_size + so_far)::double / target as finish from q, (values (0), (1), (2)) x(n)
  where size > 0 and target > 0),
r as (select *, sum(size) over (order by finish, source is null, coalesce(source, ''), n, so_far) as taken_by_then from c),
m as (select source, so_far, count(*) as times from r, b where taken_by_then <= budget group by 1, 2)
select doc_id, size, source_size, target, (case when size > 0 then size * coalesce(times, 0) else 0 end)::bigint as taken
from q left join m on q.source is not distinct from m.source and q.so_far = m.so_far
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filters, op2_exact_topk, op3_sharding, op4_pii, op5_toxicity, op6_embedding_near_dedup, op7_packing, op8_sentencepiece, op9_lm_scoring,
        op10_ngram_jaccard_join, op11_importance_resampling, op12_embedding_whitening, op13_source_mixing,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL, "op2_exact_topk": OP2_SQL, "op6_embedding_near_dedup": OP6_SQL, "op10_ngram_jaccard_join": OP10_SQL,
        "op13_source_mixing": OP13_SQL,
    }
