"""What the training-data operators share: reading, storing intermediate tables, Arrow plumbing.

Every operator takes a DataFrame and returns a DataFrame.  Intermediate
results that are needed twice are written as Parquet under the folder that
``spark.checkpoint.dir`` names (never a machine-local folder on a cluster), so
that a lost executor costs a re-read, not a wrong or missing row.  What an
operator no longer needs it removes at once; what its (lazy) result still reads
goes with ``clear`` or at the end of a ``scratch`` block, when the caller has
written the result.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..storage import shared_folder

#: Rows an Arrow batch may hold; with documents of some kilobytes a batch stays at a few MB.
ROWS_PER_BATCH = 1000
#: Bytes of an Arrow batch at which it is closed, however few its rows (one row may be longer).
BYTES_PER_BATCH = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints; a folder of the session's own only on one machine, where none is set (tests)."""
    return shared_folder(spark)


#: Folders that the operators wrote and nobody has removed yet, innermost scratch block last.
_written: list[list[str]] = [[]]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    for paths in _written:
        if path in paths:
            paths.remove(path)


def release(*tables: DataFrame | None) -> None:
    """Remove stored tables that no plan reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "stored_at", None)):
            remove(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all that operators have stored (in the innermost scratch block); results not yet written are lost."""
    for path in list(_written[-1]):
        remove(spark, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored inside goes at the end of the block."""
    _written.append([])
    try:
        yield
    finally:
        clear(spark)
        _written.pop()


def keep(df: DataFrame) -> DataFrame:
    """Let a stored table outlive the scratch block that made it."""
    path = df.stored_at
    if len(_written) > 1 and path in _written[-1]:
        _written[-1].remove(path)
        _written[-2].append(path)
    return df


def bounded_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH, size: int = BYTES_PER_BATCH) -> None:
    """Arrow batches of a bounded number of rows and bytes: the session's limits are lowered, never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = (spark.conf.get(key, None) or "").lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def quoted(name: str) -> F.Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def bundled(df: DataFrame, without: Iterable[str] = (), name: str = "rest") -> F.Column:
    """All columns but those named (in any case) as one struct, so that no name can clash with an operator's."""
    gone = {c.lower() for c in without}
    return F.struct(*(quoted(c) for c in df.columns if c.lower() not in gone), F.lit(0).alias("__none")).alias(name)


def unbundled(df: DataFrame, without: Iterable[str] = (), name: str = "rest") -> list[F.Column]:
    """The columns of ``bundled`` again; ``df`` is the frame that had them."""
    gone = {c.lower() for c in without}
    return [F.col(name).getField(c).alias(c) for c in df.columns if c.lower() not in gone]


def with_columns(df: DataFrame, body: F.Column, new: list[T.StructField], f: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with new columns, made batch by batch from one expression over it; columns that clash by name (in any case) are replaced."""
    names = [x.name for x in new]
    rows = df.select(bundled(df, names), body.alias("body"))
    schema = T.StructType([rows.schema["rest"], *new])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *f(batch.column(1))], names=schema.names)

    return map_arrow(rows, run, schema).select(*unbundled(df, names), *names)


def text_bytes(column: str = "text") -> F.Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(quoted(column).cast("binary"), F.lit(b""))


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string array without copies; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``target`` bytes: working arrays stay small whatever the batch holds."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + target, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def list_array(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a table that is about to be broadcast has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def sampled_texts(df: DataFrame, key: str, text: str, n: int) -> list[bytes]:
    """Whole texts of at most ``n`` rows, the first by a hash of the key.

    Keys are chosen before any text is read, so tasks send the driver ``n``
    small rows each, and of texts only the chosen ones.
    """
    own = df.select(quoted(key).alias("k"), text_bytes(text).alias("t"))
    chosen = df.select(quoted(key).alias("c")).orderBy(F.xxhash64("c"), "c").limit(n).distinct()
    rows = own.join(F.broadcast(chosen), F.col("k").eqNullSafe(F.col("c")), "left_semi")
    return [bytes(r[0]) for r in rows.orderBy(F.xxhash64("k"), "k", F.xxhash64("t")).select("t").limit(n).collect()]
