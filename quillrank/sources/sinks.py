"""Writers: answers, score reports, feature rows, labels, JSON reports."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_answers(answers: DataFrame, path: str) -> None:
    """query_id and answer as CSV with a header; one file (a row per query)."""
    answers.select("query_id", "answer").coalesce(1).write.csv(path, header=True, mode="errorifexists")


def write_scores(ranked: DataFrame, path: str) -> DataFrame:
    """A row per query and rank as CSV; returns count, mean, least and greatest score."""
    ranked.select("qid", "rank", "item_id", "score").write.csv(path, header=True, mode="errorifexists")
    return ranked.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("greatest"))


def write_features(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Feature rows as zstd Parquet; an existing path is never overwritten."""
    writer = rows.write.option("compression", "zstd").mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_cache(rows: DataFrame, path: str, about: dict) -> None:
    """An immutable cache: rows as zstd Parquet in ``rows``, a description in ``about``, written last; without it the cache is incomplete."""
    write_features(rows, f"{path}/rows")
    text = json.dumps(about | {"columns": rows.columns}, sort_keys=True, ensure_ascii=False)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/about")


def read_cache(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """A complete cache that belongs to the same description; anything else is an error."""
    try:
        saved = json.loads(spark.read.text(f"{path}/about").first()[0])
    except AnalysisException as e:
        raise ValueError("this cache is incomplete") from e
    if {k: v for k, v in saved.items() if k != "columns"} != json.loads(json.dumps(about)):
        raise ValueError("this cache belongs to another run")
    return spark.read.parquet(f"{path}/rows").select(*saved["columns"])


def write_labels(labels: DataFrame, key: str, path: str) -> None:
    """Label rows as JSON lines in the order of the key's hash."""
    labels.orderBy(F.sha2(F.col(key).cast("string"), 256), key).write.mode("errorifexists").json(path)


def write_report(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one JSON document; larger ones are refused, not cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    text = json.dumps(rows, ensure_ascii=False, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
