"""Exact deduplication by content sort (operator 5).

Texts are normalised (white space deleted), sampled splitters deal them into
ranges of the normalised bytes, each range is sorted externally, and equal
texts, now adjacent, are found by comparing neighbours in full.  The range
splitters go on to a hash and the document id, so copies of one text, however
many, spread over ranges: a range then holds a run of the group, and only its
first and last run can go on elsewhere.  Those runs, at most two a range, are
merged by digest.

Only the key's short front (``FRONT`` bytes, a hash, the id) is sampled by the
driver; comparisons and digests are over whole texts.

Of equal texts the row with the most code points in its original text stays,
then the smallest id (null last); exactly one row stays even among repeated
rows.  Null text counts as empty; empty and white-space texts are one group.
Very long texts are compared whole.  An empty table gives no rows.  Columns
other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes [\x20\x09-\x0D], deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
FRONT = 24


def normalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: the key, the normalised bytes, their front, digest and hash, and the original's code points."""
    schema = T.StructType(
        [
            df.schema[key], T.StructField("body", T.BinaryType()), T.StructField("front", T.BinaryType()),
            T.StructField("hash", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("points", T.LongType()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(1))
            lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            points = lead[offsets[1:]] - lead[offsets[:-1]]
            bodies = [(v or b"").translate(None, WHITE) for v in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(b).digest() for b in bodies]
            hashes = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(bodies, pa.binary()), pa.array([b[:FRONT] for b in bodies], pa.binary()), pa.array(hashes),
                    pa.array(digests, pa.binary()), pa.array(points, pa.int64()),
                ],
                names=schema.names,
            )

    return common.map_arrow(df.select(key, common.text_bytes(text)), run, schema)


def runs(ordered: DataFrame, key: str) -> DataFrame:
    """Runs of equal neighbours within each sorted range; the first row of a run is its best."""
    field = ordered.schema[key]
    schema = T.StructType(
        [
            field, T.StructField("digest", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("first", T.BooleanType()),
            T.StructField("edge", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("points", T.LongType()),
            T.StructField("best", field.dataType),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        arrow: pa.DataType | None = None
        ids: list = []
        ready: list[tuple] = []
        body: bytes | None = None
        hash_, digest, points, began = 0, b"", 0, True

        def close(last: bool) -> None:
            nonlocal began
            if body is not None:
                edge = began or last
                ready.extend((i, digest, part, x == 0, edge, len(ids), points, ids[0]) for x, i in enumerate(ids))
                began = False

        def flush() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) if ready else [[] for _ in schema]
            types = [arrow, pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), arrow]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        for batch in batches:
            arrow = batch.column(0).type
            for i, b, h, d, p in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(),
                strict=True,
            ):
                if body is None or h != hash_ or b.as_py() != body:
                    close(False)
                    ids, body, hash_, digest, points = [], b.as_py(), h, d.as_py(), p
                ids.append(i)
            if len(ready) > 4096:
                yield flush()
        if arrow is not None:
            close(True)
            yield flush()

    return common.map_arrow(ordered, run, schema)


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, keep_id, group_size, kept, text_sha256."""
    keyed = normalised(df, key, text)
    dealt = keyed.repartitionByRange(F.col("front"), F.col("hash"), F.col(key))
    ordered = dealt.sortWithinPartitions("front", "hash", "body", F.desc("points"), F.asc_nulls_last(key)).select(key, "body", "hash", "digest", "points")
    table = common.stored(runs(ordered, key), "exact-runs")
    better = F.struct((-F.col("points")).alias("p"), F.col("best").isNull().alias("z"), F.col("best").alias("best"), F.col("part").alias("part"))
    across = table.where("edge and first").groupBy(F.col("digest").alias("of")).agg(F.sum("n").alias("all"), F.min(better).alias("top"))
    # At most two runs of each range: bounded by the number of partitions.
    joined = table.join(F.broadcast(across), (F.col("digest") == F.col("of")) & F.col("edge"), "left")
    return joined.select(
        F.col(key),
        F.when(F.col("top").isNotNull(), F.col("top.best")).otherwise(F.col("best")).alias("keep_id"),
        F.coalesce("all", "n").alias("group_size"),
        (F.col("first") & (F.col("top").isNull() | (F.col("top.part") == F.col("part")))).alias("kept"),
        F.lower(F.hex(F.col("digest"))).alias("text_sha256"),
    )
