"""TF-IDF vectors over word or character n-grams, as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage

#: Up to so many grams with their document counts are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000


def counts(rows: DataFrame, key: str, grams: str) -> DataFrame:
    """(key, g, tf), stored; where rows are dealt by key before their grams are made, grams are counted where they are, without a shuffle."""
    each = rows.select(key, F.explode(grams).alias("g"))
    return storage.stored(each.groupBy(key, "g").agg(F.count("*").alias("tf")), "gram-counts")


def frequencies(tf: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """(g, df) of grams in at least ``least`` documents; with ``most``, the most frequent of them, ties by gram."""
    df = tf.groupBy("g").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df if most is None else df.orderBy(F.desc("df"), "g").limit(most)


def weights(tf: DataFrame, df: DataFrame, documents: Column) -> DataFrame:
    """Raw weights (1 + ln tf) (ln((1 + n) / (1 + df)) + 1) of the grams that ``df`` has."""
    df = storage.stored(df, "gram-frequencies")
    if storage.small_enough(df, BROADCAST_GRAMS):
        df = F.broadcast(df)
    idf = F.ln((1 + documents) / (1 + F.col("df"))) + 1
    return tf.join(df, "g").withColumn("w", (1 + F.ln("tf")) * idf).drop("df")


def vectors(rows: DataFrame, key: str, grams: str, least: int = 1, most: int | None = None, unit: bool = False) -> DataFrame:
    """(key, g, tf, w) of the grams (an array column, all occurrences) of each row.

    ``least`` documents must have a gram, at most ``most`` grams are kept; with
    ``unit``, each row's vector has length 1.
    """
    tf = counts(rows, key, grams)
    out = weights(tf, frequencies(tf, least, most), F.lit(rows.count()))
    if unit:
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
        out = out.withColumn("w", F.col("w") / norm)
    return out
