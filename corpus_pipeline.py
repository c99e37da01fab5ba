"""A corpus pipeline: toxic documents go, one of each group of near copies stays, personal data is
masked, and what is left is packed into sequences of token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each result as Parquet and reads it again for the next stage, and then
removes what the stage before wrote. In all stages a null text counts as empty, repeated rows are rows of
their own unless the stage says otherwise, an empty table gives no rows, and further columns are carried
along; names of columns that stages add begin with ``__pipeline_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm import jaccardjoin, packing, pii, toxicity
from tallyrift.llm.base import release, stash
from tallyrift.llm.registry import TOXIC_FROM, table, tokenizer_path, toxic_trains

#: No SQL: the nearest-neighbour scores, the shingle join and the token ids are beyond it.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[Column]:
    """All columns, also those with a dot in their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below ``TOXIC_FROM``; texts without words have the score of such examples and stay."""
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), toxic_trains(), keep=tuple(docs.columns), names=("__pipeline_score", "__pipeline_evidence"))
    return scored.where(F.col("__pipeline_score") < TOXIC_FROM).select(*_columns(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the smallest id; texts without words all stay, of rows with the same id and text one."""
    return jaccardjoin.one_of_each(docs).select(*_columns(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by its kind, n_chars counted anew; a null text stays null, of 0 characters."""
    found = pii.find_pii(docs, id_cols=tuple(docs.columns), name="__pipeline_entities")
    text = pii.masked(F.col("text"), F.col("__pipeline_entities"))
    return found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each), ("personal_data", mask_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
