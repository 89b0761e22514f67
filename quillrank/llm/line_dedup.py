"""Removal of lines that many documents share, by levelled sorted runs of line hashes (operator 10).

Documents come in batches.  A batch's run is its line hashes, each with the
number of documents that have it, dealt into buckets by hash and sorted within
them.  The new run is merge-anti-joined with the runs' hashes that are already
known to be in enough documents (they need no more counting), and added to
level 0; when a level has two runs they are merged into one of the next level.
Runs lie in files bucketed and sorted by key, so merges and anti-joins read
them side by side, without a shuffle or a sort.  Runs, their levels and what
replaced them are logged in a folder: a later session opens it and adds its
batches to what is there.  At the end the runs are merged into one, and every
document drops the lines whose hash has enough documents.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z
lower-cased; empty keys are never dropped.  A key is held as a 64-bit hash, so
counts of two keys meet by chance with a probability of about 2**-60 a pair.

Null and empty texts are one empty line.  A document all of whose lines go
becomes the empty text.  Repeated rows with one id count as documents of their
own; a line that a document repeats counts once.  An empty table gives no rows.
Columns called n_lines, n_dropped or kept_text (in any case) are replaced, all
others stay, whatever their names.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel

#: Batches that a table given at once is dealt into.
BATCHES = 6
#: Up to so many frequent hashes (8 bytes each) are broadcast; more are joined.
BROADCAST_KEYS = 4_000_000


def line_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, row counts and hashes of the lines, and which have a key that isn't empty."""
    starts, ends, counts = kernel.lines(raw, offsets)
    a, b = kernel.stripped(raw, starts, ends)
    return starts, ends, counts, kernel.span_hashes(raw, a, b, kernel.LOWER_CODES), b > a


def batch_counts(df: DataFrame, text: str) -> DataFrame:
    """(key, docs) of the lines of each Arrow batch; the same key comes once for every batch at most."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("docs", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(0))
            found = []
            for a, b in common.chunks(offsets):
                _, _, counts, keys, full = line_keys(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                owner = np.repeat(np.arange(b - a), counts)
                order = np.lexsort((keys, owner))
                keys, owner, full = keys[order], owner[order], full[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                found.append(keys[new & full])
            keys, docs = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs.astype(np.int64))], names=schema.names)

    return common.map_arrow(df.select(common.text_bytes(text)), run, schema)


#: Bucketed files are read in their order only under this setting; it is held while a merge runs.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextlib.contextmanager
def _merging(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_ORDERED, None)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before) if before is not None else spark.conf.unset(_ORDERED)


class LineRuns:
    """Levels of sorted runs (key, docs) in a folder; opening the folder again goes on where it was left.

    A run holds a key once.  Batches must be added one after another.
    """

    LOG = "at long, run string, level int, live boolean, buckets int, least long"

    def __init__(self, spark: SparkSession, folder: str, least: int):
        self.spark, self.folder, self.least = spark, folder.rstrip("/"), least
        self.levels: dict[str, int] = {}
        self.at, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            log = spark.read.schema(self.LOG).json(f"{self.folder}/log").orderBy("at").collect()  # a row for each run made or replaced
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log = []
        for r in log:
            if r["least"] != least:
                raise ValueError(f"these runs count lines of {r['least']} documents, not {least}")
            self.at, self.buckets = r["at"], r["buckets"]
            if r["live"]:
                self.levels[r["run"]] = r["level"]
            else:
                self.levels.pop(r["run"], None)

    def read(self, run: str) -> DataFrame:
        table = f"line_run_{run}"
        if not self.spark.catalog.tableExists(table):  # made by another session
            self.spark.sql(
                f"CREATE TABLE {table} (key BIGINT, docs BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/run-{run}'"
            )
        return self.spark.table(table)

    def _write(self, rows: DataFrame, level: int, replaced: tuple[str, ...] = ()) -> str:
        """Write a run whose rows lie by bucket, then log it together with the runs that it replaces."""
        run = uuid.uuid4().hex
        with _merging(self.spark):
            rows.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", f"{self.folder}/run-{run}").saveAsTable(f"line_run_{run}")
        self.at += 1
        lines = [(self.at, run, level, True, self.buckets, self.least)] + [
            (self.at, old, self.levels[old], False, self.buckets, self.least) for old in replaced
        ]
        self.spark.createDataFrame(lines, self.LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")
        self.levels[run] = level
        for old in replaced:
            del self.levels[old]
            self.spark.sql(f"DROP TABLE line_run_{old}")
            common.remove(self.spark, f"{self.folder}/run-{old}")
        return run

    def add(self, counts: DataFrame) -> None:
        """A batch's (key, docs); a key may come more than once."""
        run = counts.repartition(self.buckets, "key").groupBy("key").agg(F.sum("docs").alias("docs"))
        for old in self.levels:  # a number of runs that grows with the logarithm of the batches
            run = run.join(self.read(old).where(F.col("docs") >= self.least).hint("merge"), "key", "left_anti")
        self._write(run, 0)
        while pair := self._twins():
            self._merge(*pair)

    def _twins(self) -> list[str] | None:
        for level in sorted(set(self.levels.values())):
            own = [r for r, l in self.levels.items() if l == level]
            if len(own) > 1:
                return own[:2]
        return None

    def _merge(self, a: str, b: str) -> str:
        left, right = self.read(a).withColumnRenamed("docs", "a"), self.read(b).withColumnRenamed("docs", "b")
        both = left.join(right.hint("merge"), "key", "full_outer")
        docs = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
        return self._write(both.select("key", docs.alias("docs")), max(self.levels[a], self.levels[b]) + 1, (a, b))

    def frequent(self) -> DataFrame:
        """The keys with enough documents, to be read before the next batch is added; all runs become one."""
        while len(self.levels) > 1:
            self._merge(*sorted(self.levels, key=lambda r: (self.levels[r], r))[:2])
        if not self.levels:
            return self.spark.createDataFrame([], "key long")
        return self.read(next(iter(self.levels))).where(F.col("docs") >= self.least).select("key")


def frequent_lines(df: DataFrame, least: int, text: str = "text", batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """The hashes of the lines that at least ``least`` documents have: those of ``df``, and of what ``runs`` held before."""
    spark = df.sparkSession
    own = runs or LineRuns(spark, f"{common.shared_dir(spark)}/line-runs-{uuid.uuid4().hex}", least)
    path = f"{common.shared_dir(spark)}/line-batches-{uuid.uuid4().hex}"
    batch_counts(df, text).withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(batches))).write.partitionBy("batch").parquet(path)  # a task's lines are of one batch
    table = spark.read.schema("key long, docs long, batch int").parquet(path)
    for b in range(batches):
        own.add(table.where(F.col("batch") == b).select("key", "docs"))
    keys = common.stored(own.frequent(), "frequent-lines")
    common.remove(spark, path)
    if runs is None:
        for run in own.levels:
            spark.sql(f"DROP TABLE line_run_{run}")
        common.remove(spark, own.folder)
    return keys


_NEW = (T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType()))


def _applied(rows: DataFrame, frequent: object | None) -> DataFrame:
    """Lines of (rest, body) dropped by a broadcast set of hashes, or of (rest, body, drop) by each row's own."""
    schema = T.StructType([rows.schema["rest"], *_NEW])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_keys = frequent.value if frequent is not None else None
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(1))
            n_lines, n_dropped, texts = [], [], []
            for a, b in common.chunks(offsets):
                own, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, counts, keys, full = line_keys(own, at)
                first = np.concatenate([[0], np.cumsum(counts)])
                if common_keys is not None:
                    where = np.searchsorted(common_keys, keys)
                    drop = full & (np.append(common_keys, 0)[where] == keys) & (where < len(common_keys))
                else:
                    drop = np.zeros(len(keys), bool)
                    for i in range(a, b):
                        if own_keys := batch.column(2)[i].as_py():
                            s = slice(first[i - a], first[i - a + 1])
                            drop[s] = full[s] & np.isin(keys[s], np.array(own_keys, np.int64).view(np.uint64))
                dropped = np.diff(np.concatenate([[0], np.cumsum(drop)])[first])
                data = own.tobytes()
                for i in range(b - a):
                    if not dropped[i]:
                        texts.append(data[at[i] : at[i + 1]])
                    else:
                        texts.append(b"\n".join(data[starts[j] : ends[j]] for j in range(first[i], first[i + 1]) if not drop[j]))
                n_lines.append(counts)
                n_dropped.append(dropped)
            flat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), flat(n_lines), flat(n_dropped), pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names,
            )

    return common.map_arrow(rows, run, schema)


def drop_frequent_lines(
    df: DataFrame, least: int, text: str = "text", broadcast_keys: int = BROADCAST_KEYS, batches: int = BATCHES,
    runs: LineRuns | None = None,
) -> DataFrame:
    """``df`` with n_lines, n_dropped and kept_text; with ``runs``, lines of earlier batches count too, and these are added."""
    gone = [f.name for f in _NEW]
    rows = df.select(common.bundled(df, gone), common.text_bytes(text).alias("body"))
    keys = frequent_lines(df, least, text, batches, runs)
    if common.small_enough(keys, broadcast_keys):
        found = np.sort(keys.toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64))  # 8 bytes a key
        common.release(keys)
        out = _applied(rows, df.sparkSession.sparkContext.broadcast(found))
    else:
        tagged = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "line-documents")
        hits = _row_keys(tagged).join(keys, "key", "left_semi").groupBy("row").agg(F.collect_list("key").alias("drop"))
        out = _applied(tagged.join(hits, "row", "left").select("rest", "body", "drop"), None)
    return out.select(*common.unbundled(df, gone), *gone)


def _row_keys(tagged: DataFrame) -> DataFrame:
    """(row, key) of the distinct lines of each row."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(1))
            rows = batch.column(0).to_numpy()
            for a, b in common.chunks(offsets):
                _, _, counts, keys, full = line_keys(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                pairs = np.unique(np.stack([np.repeat(rows[a:b], counts)[full], keys[full].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=schema.names)

    return common.map_arrow(tagged.select("row", "body"), run, schema)
