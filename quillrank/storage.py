"""Tables that plans read more than once, written to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_own: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only on one machine, where none is set, one of this session's own, gone when the process ends."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: executors and driver need a shared folder for stored tables")
    path = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if path not in _own:
        _own.add(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def stored(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write a table and read it back: later plans scan it instead of working it out again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def splits(spark: SparkSession, size: int) -> Iterator[None]:
    """What runs inside reads files in splits of at most ``size`` bytes; a smaller setting stays."""
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    if not was.rstrip("b").isdigit() or int(was.rstrip("b")) > size:
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table that is about to be broadcast has at most so many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows
