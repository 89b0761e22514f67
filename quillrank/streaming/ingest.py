"""Incremental posting lists: new item files are indexed as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def term_counts(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, tf, dl) of a batch of items."""
    cut = items.select(F.col(key).alias("item_id"), X.tokens(X.normalize(F.col(text))).alias("t"))
    return cut.select("item_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def index_stream(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, key: str = "item_id", text: str = "text", files: int = 64) -> StreamingQuery:
    """Append the term counts of arriving Parquet files to an index; a restart goes on where it stopped.

    A batch is written into a folder of its own number, so a batch that is run
    again after a failure replaces its rows instead of doubling them.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        term_counts(batch, key, text).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(index).drop("batch")
