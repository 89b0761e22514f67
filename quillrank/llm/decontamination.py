"""Benchmark decontamination by winnowing (operator 9).

A window of ``WINDOW`` words has WINDOW - K + 1 runs of K words; the least of
their hashes is the window's fingerprint.  A window of a document and one of a
benchmark item that are equal have the same fingerprint, so joining the
fingerprints misses no shared span of WINDOW words or more.  Where they meet,
the hit is extended: the whole windows are compared (as hashes of all their
words), and every word inside a shared window is hit.  Items of fewer words
are one window of their own length and are looked up whole.

A benchmark of at most ``BLOCK_BYTES`` of text, counted first, is broadcast and
its fingerprints are joined in the workers, so documents never shuffle.  A
larger one is joined by shuffles: fingerprints of documents, distinct in each,
meet the benchmark's; documents then list the whole windows behind those that
met, and these join the benchmark's windows.  Nothing of it comes to the driver.

Null texts and texts without words have no windows.  Repeated rows get equal
results.  Items with equal text are told apart by id; an item without id
counts as one with the empty id.  Very long texts are read whole, in parts.  An
empty benchmark hits nothing; an empty table gives no rows.  Columns called
n_words, n_hit, hit_words or item_ids (in any case) are replaced, all others
stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel

WINDOW, K = 10, 5
BLOCK_BYTES = 64 << 20


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Of each window, the least hash of its K-word runs."""
    runs = kernel.rolled(words, K)
    size = max(0, len(words) - WINDOW + 1)
    out = runs[:size].copy()
    for j in range(1, WINDOW - K + 1):
        np.minimum(out, runs[j : j + size], out=out)
    return out


class Index:
    """Fingerprints and windows of one block of items, ready for lookups."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names = sorted({name for name, _ in items})
        at = {n: i for i, n in enumerate(self.names)}
        prints, self.windows = [], {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, body in items:
            raw = np.frombuffer(body, np.uint8)
            starts, ends, _ = kernel.words(raw, np.array([0, len(raw)]), kernel.ALNUM)
            if not len(starts):
                continue
            own = kernel.span_hashes(raw, starts, ends, kernel.LOWER_CODES)
            n = min(WINDOW, len(own))
            if n == WINDOW:
                prints.append(fingerprints(own))
            found.setdefault(n, []).append((np.unique(kernel.rolled(own, n)), at[name]))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        for n, parts in found.items():
            keys = np.concatenate([p for p, _ in parts])
            owners = np.concatenate([np.full(len(p), i) for p, i in parts])
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            distinct, first = np.unique(keys, return_index=True)
            self.windows[n] = (distinct, np.append(first, len(keys)), owners)
        self.sieves = {n: self._sieve(w[0] if n < WINDOW else self.prints) for n, w in self.windows.items()}

    @staticmethod
    def _sieve(keys: np.ndarray) -> np.ndarray:
        bits = max(16, min(24, int(len(keys) * 16).bit_length()))
        out = np.zeros(1 << bits, bool)
        out[keys >> np.uint64(64 - bits)] = True
        return out

    def hits(self, words: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, window numbers) of the windows that the words hold; ``ends``: where each word's row ends."""
        for n, (keys, _, _) in sorted(self.windows.items()):
            if len(words) < n:
                continue
            marks = fingerprints(words) if n == WINDOW else kernel.rolled(words, n)
            sieve = self.sieves[n]
            at = np.flatnonzero(sieve[marks >> np.uint64(65 - len(sieve).bit_length())])
            at = at[at + n <= ends[at]]
            if n == WINDOW and len(at):  # joined fingerprints; then the whole windows
                at = at[_within(self.prints, marks[at])[1]]
                whole = np.zeros(len(at), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(n):
                        whole = whole * kernel.ROLL + words[at + j]
                marks = kernel.mix(whole)
            else:
                marks = marks[at]
            where, same = _within(keys, marks)
            yield n, at[same], where[same]


def _within(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    where = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return where, keys[where] == values


_RESULT = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


def _looked_up(rows: DataFrame, index: object) -> DataFrame:
    """(rest, body) with the words, hit spans (starts and ends in words) and items of each row."""
    schema = T.StructType([rows.schema["rest"], *_RESULT])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Index = index.value
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(1))
            n_words: list[np.ndarray] = []
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for a, b in common.chunks(offsets):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, counts = kernel.words(part, at, kernel.ALNUM)
                n_words.append(counts)
                words = kernel.span_hashes(part, starts, ends, kernel.LOWER_CODES)
                first = np.concatenate([[0], np.cumsum(counts)])
                mark = np.zeros(len(words) + 1, np.int64)
                touched: list[np.ndarray] = []
                for n, where, window in own.hits(words, np.repeat(first[1:], counts)):
                    np.add.at(mark, where, 1)
                    np.add.at(mark, where + n, -1)
                    row = np.searchsorted(first, where, side="right") - 1
                    row, window = np.unique(np.stack([row, window]), axis=1)
                    _, begin, owners = own.windows[n]
                    for r, w in zip(row.tolist(), window.tolist(), strict=True):
                        items[a + r].update(own.names[o] for o in owners[begin[w] : begin[w + 1]])
                    touched.append(row)
                if any(map(len, touched)):
                    inside = np.cumsum(mark)[:-1] > 0
                    for r in np.unique(np.concatenate(touched)).tolist():
                        h = np.concatenate([[False], inside[first[r] : first[r + 1]], [False]])
                        spans[a + r] = np.flatnonzero(h[1:] != h[:-1]).tolist()
            flat = np.concatenate(n_words).astype(np.int64) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(flat), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(i) for i in items], pa.list_(pa.string()))],
                names=schema.names,
            )

    return common.map_arrow(rows, run, schema)


def _windows(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks (fingerprints; of short items whole windows) and whole hashes of all windows of ``n`` words."""
    whole = kernel.rolled(words, n)
    return (fingerprints(words) if n == WINDOW else whole), whole


def _marks(texts: DataFrame, lengths: list[int] | None, listed: bool) -> DataFrame:
    """Windows of (id, body): of each row the distinct (n, mark), or with ``listed`` (id, body, marks) the words and (n, at, whole) of the windows whose mark is listed.

    ``lengths``: window lengths to look for; None: each text's own, as of an item.
    """
    kind = texts.schema["id"]
    if listed:
        schema = T.StructType([kind, T.StructField("n", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("whole", T.LongType())])
    else:
        schema = T.StructType(
            [
                kind, T.StructField("n", T.IntegerType()), T.StructField("mark", T.LongType()), T.StructField("whole", T.LongType()),
                T.StructField("n_words", T.LongType()),
            ]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(1))
            for i in range(batch.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                starts, ends, _ = kernel.words(own, np.array([0, len(own)]), kernel.ALNUM)
                words = kernel.span_hashes(own, starts, ends, kernel.LOWER_CODES)
                wanted = np.sort(np.array(batch.column(2)[i].as_py() or [], np.int64)).view(np.uint64) if listed else None
                if listed:
                    wanted = np.sort(wanted)
                for n in lengths if lengths is not None else [min(WINDOW, len(words))]:
                    if not n or len(words) < n:
                        continue
                    mark, whole = _windows(words, n)
                    if listed:
                        at = np.flatnonzero(_within(wanted, mark)[1])
                        columns = [pa.array(at), pa.array(whole[at].view(np.int64))]
                    else:
                        both = np.unique(np.stack([mark, whole]), axis=1) if lengths is None else np.stack([np.unique(mark)] * 2)
                        at = both[0]
                        columns = [pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), pa.array(np.full(len(at), len(words)))]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(batch.column(0)[i], len(at)), pa.array(np.full(len(at), n, np.int32)), *columns], names=schema.names,
                        )

    return common.map_arrow(texts, run, schema)


def _joined(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """As ``_looked_up``, by shuffle joins of fingerprints and then of windows."""
    tagged = common.stored(rows.withColumn("id", F.monotonically_increasing_id()), "winnow-documents")
    windows = common.stored(
        _marks(bench.select(F.col("name").alias("id"), "body"), None, False).select("n", "mark", "whole", F.col("id").alias("name")).distinct(),
        "winnow-windows",
    )
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW rows
    marks = windows.select("n", "mark").distinct()
    met = _marks(
        tagged.select("id", "body"), lengths, False,
    ).select("id", "n", "mark").join(marks, ["n", "mark"], "left_semi").groupBy("id").agg(F.collect_set("mark").alias("marks"))
    listed = _marks(tagged.select("id", "body").join(met, "id").select("id", "body", "marks"), lengths, True)
    hits = common.stored(listed.join(windows.select("n", "whole").distinct(), ["n", "whole"], "left_semi"), "winnow-hits")
    spans = hits.groupBy("id").agg(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("end"))).alias("found"))
    items = hits.select("id", "n", "whole").distinct().join(
        windows.select("n", "whole", "name"), ["n", "whole"],
    ).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("items"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(1))
            counts = [kernel.words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kernel.ALNUM)[2] for a, b in common.chunks(offsets)]
            flat = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
            merged = [_merged([x for s in f or [] for x in (s["at"], s["end"])]) for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(flat), pa.array(merged, pa.list_(pa.int64())),
                    pa.array([i or [] for i in batch.column(3).to_pylist()], pa.list_(pa.string())),
                ],
                names=schema.names,
            )

    schema = T.StructType([tagged.schema["rest"], *_RESULT])
    return common.map_arrow(tagged.join(spans, "id", "left").join(items, "id", "left").select("rest", "body", "found", "items"), run, schema)


def _merged(flat: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def find_contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with n_words, n_hit, hit_words (starts and ends, exclusive, in turn) and item_ids (sorted as strings)."""
    bench = benchmark.select(F.coalesce(common.quoted(item).cast("string"), F.lit("")).alias("name"), common.text_bytes(item_text).alias("body"))
    total = bench.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    gone = ["n_words", "n_hit", "hit_words", "item_ids"]
    rows = df.select(common.bundled(df, gone), common.text_bytes(text).alias("body"))
    if total <= block_bytes:
        own = Index([(r["name"], bytes(r["body"])) for r in bench.collect()])
        out = _looked_up(rows, df.sparkSession.sparkContext.broadcast(own))
    else:
        out = _joined(rows, bench)
    lengths = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(*common.unbundled(df, gone), "n_words", hit.alias("n_hit"), F.col("spans").alias("hit_words"), F.col("items").alias("item_ids"))
