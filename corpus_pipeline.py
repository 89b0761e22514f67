"""A corpus pipeline of five stages over the table ``documents``.

Quality classifier, line dedup, near-duplicate removal, benchmark
decontamination, packing.  Each stage takes (spark, docs, sf_dir) and works on
all rows the one before kept; its decisions take effect.  All but the last
return the columns of ``docs`` (further columns and their names don't matter);
the last returns pieces of training sequences.

Defined results: null texts count as empty; empty documents have no features
for the classifier and fall to its prior, have no duplicates and no benchmark
passages, and stay; a document whose lines all go stays as an empty text.
``doc_id`` is expected to be unique; where it isn't, the near-duplicate stage
goes by rows: another text of the same id has its own fate, and of rows that
repeat an id and its text one stays (empty ones all stay).  Empty tables of
documents, labels or benchmark items are no special case: no rows, no rejected
and no contaminated documents.  Columns of any name pass, dots included.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import common, decontamination, line_dedup, near_dedup, packing, quality

KEEP_SCORE, LINE_DOCUMENTS, SIMILAR_PERCENT, SEQUENCE, END_ID = 0.3, 10, 75, 2048, 1
#: Up to so many dropped ids are broadcast; more go through a shuffle join.
BROADCAST_IDS = 1_000_000


def _bundled(docs: DataFrame) -> DataFrame:
    """Key and text beside everything else in one column, so that no name can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("__none")).alias("__others"))


def _unbundled(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select([F.col(c) if c in ("doc_id", "text") else F.col("__others").getField(c).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return _unbundled(quality.score(_bundled(docs), model).where(F.col("score") >= KEEP_SCORE), docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least LINE_DOCUMENTS of them share; n_chars follows the text."""
    out = line_dedup.drop_frequent_lines(_bundled(docs), LINE_DOCUMENTS).withColumn("text", F.col("kept_text"))
    out = _unbundled(out, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, the one with the smallest id."""
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Ids repeat: rows get numbers in the order of their ids, and those numbers stand in for the ids.
        order = ["doc_id", F.xxhash64("text")]
        rows = docs.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("n"))
        rows = common.stored(rows, "pipeline-rows")
        kept = drop_near_duplicates(spark, rows.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text"), "row"), sf_dir)
        return kept.select("row.*")
    gone = common.stored(near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=SIMILAR_PERCENT).where("not kept").select(F.col("doc_id").alias("__gone")), "pipeline-duplicates")
    if common.small_enough(gone, BROADCAST_IDS):
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    out = decontamination.find_contamination(_bundled(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unbundled(out.where("n_hit = 0"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained classifier or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again by the next, what a stage needed itself removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scratch(spark):
            docs = common.keep(common.stored(stage(spark, before, sf_dir), f"pipeline-{name}"))
        common.release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
