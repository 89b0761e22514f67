"""Readers: tables as text, CSV and JSON reports, streams of new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str, columns: list[str], where: str | Column | None = None) -> DataFrame:
    """The given columns of a Parquet table as strings, null as empty; ``where``, over the stored columns, reaches the scan."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, n_rows, n_columns, columns) of each table."""
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path)
        one = df.agg(
            F.lit(name).alias("name"), F.count("*").alias("n_rows"),
        ).withColumn("n_columns", F.lit(len(df.columns)).cast("long")).withColumn("columns", F.lit(" ".join(df.columns)))
        out = one if out is None else out.unionByName(one)
    return out


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """An answer file: exactly the columns query_id and answer."""
    df = spark.read.csv(path, header=True)
    if df.columns != ["query_id", "answer"]:
        raise ValueError(f"an answer file has the columns query_id and answer, not {df.columns}")
    return df


def read_ranked(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of ranked scores (qid, rank, item_id, score); ranks must run from 1 without gaps."""
    df = spark.read.csv(path, header=True, schema="qid string, rank long, item_id string, score double")
    broken = df.groupBy("qid").agg(F.max("rank").alias("m"), F.count("*").alias("n"), F.count_distinct("rank").alias("d")).where("m <> n or d <> n")
    if not broken.isEmpty():
        raise ValueError("ranks aren't contiguous")
    return df


def read_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzip."""
    return spark.read.schema(schema).json(path)


def read_labels(spark: SparkSession, path: str, required: dict[str, str], key: list[str]) -> DataFrame:
    """A JSON document of labels, checked: ``required`` fields with their types, and no null or repeated ``key``."""
    df = spark.read.option("multiLine", True).json(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    found = dict(df.dtypes)
    if wrong := [f"{c} is {found[c]}, not {t}" for c, t in required.items() if found[c] != t]:
        raise ValueError("; ".join(wrong))
    bad = df.where(" OR ".join(f"{c} IS NULL" for c in key)).limit(1).unionByName(
        df.groupBy(*key).count().where("count > 1").join(df, key).select(*df.columns).limit(1)
    )
    if not bad.isEmpty():
        raise ValueError(f"{', '.join(key)} is empty or repeats")
    return df
