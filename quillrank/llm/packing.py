"""Packing documents into training sequences by cutting stock (operator 8).

A document's tokens are cut into whole sequences and one rest.  The rests'
length histogram (bounded by the sequence length, whatever the corpus) is all
the driver sees: column generation over its classes of ``grain`` tokens gives
patterns of rests that share a sequence (see ``cutting_stock``).  Patterns that
would leave much room aren't used: their documents form a stream that is cut
to fill the room of the others, and the stream's end is cut at powers of two,
which need no padding.  Room is what the real lengths leave, not the classes'.

Documents get their places without meeting each other: a document's rank
among rests of its length is its rank within its input partition plus the
counts of earlier partitions, and rank, histogram and patterns together give
sequence, offset, and the lengths of what stands before it.

Nulls count as empty texts; every document ends with the end id, so an empty
one is a piece of one token.  Very long texts are cut, never dropped.  Repeated
rows are packed each; of rests of equal length the one that comes first in its
partition goes first.  sequence_id is unique, not gapless.  An empty table gives
no rows.  Columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .cutting_stock import whole_patterns

#: The pattern by which byte-level BPE of this family cuts a text into words.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Room of fewer tokens is left as padding, not filled with a cut piece.
LEAST_FILL = 32
#: Sequence ids from here on are of pieces that fill a sequence alone.
_ALONE = 1 << 40
#: Up to so many documents of the stream are looked up by a broadcast; more by a shuffle join.
BROADCAST_ROWS = 500_000
#: Rows to a file of ranks, however many partitions a shuffle has: for each file an executor starts short processes, which for a moment show its whole memory as theirs.
ROWS_PER_FILE = 20_000


class Encoder:
    """Ids of a byte-level BPE kept in a tokenizers file, with its special strings recognised.

    The merges are done by tiktoken over the ranks in the file (the ids are
    the same, in a fifth of the time); texts with characters outside the
    blocks where both libraries' character classes were compared go through
    tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        vocabulary, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens=special)
        self.exact = Tokenizer.from_file(path)
        self.special = set(special)
        self.unusual = re.compile(
            "[^\\x00-\\x1b\\x20-\\x7e\\xa0-\\u024f\\u0391-\\u03c9\\u0410-\\u044f\\u2010-\\u2027\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3]"
        ).search
        self.size = self.exact.get_vocab_size()

    def __call__(self, text: str) -> list[int]:
        if self.unusual(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special=self.special, disallowed_special=())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(df: DataFrame, key: str, text: str, model: str, end_id: int, capacity: int) -> DataFrame:
    """Per document: where it was read, its length, the checksums of its uncut pieces, and its ids."""
    schema = T.StructType(
        [df.schema[key]]
        + [T.StructField(n, T.LongType()) for n in ("part", "row", "tokens", "rest", "rank", "alone")]
        + [T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(model), TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(capacity, np.int64)
        row = alone = 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for t in batch.column(1):
                ids = encode(t.as_py() or "")
                ids.append(end_id)
                own = np.array(ids, "<u4")
                n, data = len(ids), own.tobytes()
                rest = n % capacity
                for o, v in zip(
                    out,
                    (part, row, n, rest, int(seen[rest]), alone, [zlib.crc32(data[4 * s : 4 * (s + capacity)]) for s in range(0, n, capacity)], data),
                    strict=True,
                ):
                    o.append(v)
                seen[rest] += 1
                row += 1
                alone += n // capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(o, t) for o, t in zip(out, [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.binary()], strict=True)],
                names=schema.names,
            )

    return common.map_arrow(df.select(key, common.quoted(text).alias("__text")), run, schema)


@dataclass
class Plan:
    """Where rests go, by class and rank: arrays over classes, lengths and patterns only."""

    capacity: int
    grain: int
    first: np.ndarray  # of each length: its first rank within its class
    before: np.ndarray  # of each length: tokens of the class's shorter rests
    streamed: np.ndarray  # of each class: so many of its first ranks are in the stream
    stream_at: np.ndarray  # of each class: where its part of the stream begins
    stream: int  # tokens in the stream
    patterns: list[list[tuple[int, int]]]  # classes and counts
    first_sequence: np.ndarray
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # of each class: patterns, their counts of it, and the ranks where each begins
    rooms: list[tuple[int, int, int, int]]  # pattern, its first sequence with this room, tokens of room, times
    room_at: np.ndarray

    def lengths(self, kind: int, rank: np.ndarray) -> np.ndarray:
        """Lengths of the rests with these ranks of a class."""
        lo = max(1, (kind - 1) * self.grain + 1)
        own = self.first[lo : min(kind * self.grain, self.capacity - 1) + 1]
        return lo + np.searchsorted(own, rank, side="right") - 1

    def contents(self, pattern: int, sequence: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """What a pattern's sequences hold: (class, place) of each column, and the lengths."""
        columns, sizes = [], []
        for kind, times in self.patterns[pattern]:
            at, _, begins = self.slots[kind]
            start = self.streamed[kind] + begins[int(np.searchsorted(at, pattern))]
            for t in range(times):
                columns.append((kind, t))
                sizes.append(self.lengths(kind, start + sequence * times + t))
        return columns, np.stack(sizes, 1)


    def runs(self, pattern: int, n: int) -> list[tuple[int, int, int, int]]:
        """Room of a pattern's ``n`` sequences: runs of those whose columns keep their lengths."""
        cuts = [np.zeros(1, np.int64)]
        for kind, times in self.patterns[pattern]:
            at, _, begins = self.slots[kind]
            start = self.streamed[kind] + begins[int(np.searchsorted(at, pattern))]
            longer = self.first[(kind - 1) * self.grain + 2 : min(kind * self.grain, self.capacity - 1) + 1]
            cuts.append((-((start + np.arange(times)[:, None] - longer) // times)).ravel())
        begin = np.unique(np.concatenate(cuts))
        begin = begin[(begin >= 0) & (begin < n)]
        room = self.capacity - self.contents(pattern, begin)[1].sum(1)
        return [(pattern, int(j), int(r), int(t)) for j, r, t in zip(begin, room, np.diff(np.append(begin, n)), strict=True)]


def plan(histogram: np.ndarray, capacity: int, grain: int) -> Plan:
    """``histogram[r]``: documents whose rest has r tokens, r below the capacity."""
    kinds = -(-(capacity - 1) // grain)
    kind_of = -(-np.arange(capacity) // grain)
    counts = np.zeros(kinds + 1, np.int64)
    np.add.at(counts, kind_of[1:], histogram[1:])
    first, before = np.zeros(capacity, np.int64), np.zeros(capacity, np.int64)
    for r in range(1, capacity):
        if kind_of[r] == kind_of[r - 1] and r > 1:
            first[r], before[r] = first[r - 1] + histogram[r - 1], before[r - 1] + histogram[r - 1] * (r - 1)
    used = np.flatnonzero(counts)
    sizes = np.minimum(used * grain, capacity)
    units = -(-sizes // grain)
    made = whole_patterns(units, counts[used], capacity // grain)
    means = np.bincount(kind_of, histogram * np.arange(capacity), kinds + 1)[used] / counts[used]
    room = [capacity - float(p @ means) for p, _ in made]
    # Patterns with most room are taken apart until the stream of their documents fills the room of the others.
    keep = [n for _, n in made]
    streamed = np.zeros(kinds + 1, np.int64)
    open_room = sum(r * n for r, n in zip(room, keep, strict=True) if r >= LEAST_FILL)
    stream = 0
    for i in sorted(range(len(made)), key=lambda i: -room[i]):
        if room[i] < LEAST_FILL or stream >= open_room:
            break
        tokens = capacity - room[i]  # on average; exact sums follow
        n = min(keep[i], int(-(-(open_room - stream) // capacity)))
        keep[i] -= n
        stream += n * tokens
        open_room -= n * room[i]
        streamed[used] += made[i][0] * n
    stream_at, exact = np.zeros(kinds + 1, np.int64), 0
    for k in np.flatnonzero(streamed):
        stream_at[k] = exact
        lo, hi = max(1, (k - 1) * grain + 1), min(k * grain, capacity - 1)
        r = lo + int(np.searchsorted(first[lo : hi + 1], streamed[k] - 1, side="right")) - 1
        exact += int(before[r] + (streamed[k] - first[r]) * r)
    kept = [(made[i][0], keep[i], room[i]) for i in range(len(made)) if keep[i]]
    patterns = [[(int(used[j]), int(p[j])) for j in np.flatnonzero(p)] for p, _, _ in kept]
    first_sequence = np.concatenate([[0], np.cumsum([n for _, n, _ in kept])]).astype(np.int64)
    slots = {}
    for k in used:
        own = [(i, dict(p)[k], kept[i][1]) for i, p in enumerate(patterns) if k in dict(p)]
        slots[int(k)] = (
            np.array([o[0] for o in own], np.int64), np.array([o[1] for o in own], np.int64),
            np.concatenate([[0], np.cumsum([a * n for _, a, n in own])]).astype(np.int64),
        )
    p = Plan(capacity, grain, first, before, streamed, stream_at, exact, patterns, first_sequence, slots, [], np.zeros(1, np.int64))
    p.rooms = [run for i, (_, n, _) in enumerate(kept) for run in p.runs(i, n) if run[2] >= LEAST_FILL]
    p.room_at = np.concatenate([[0], np.cumsum([r * n for _, _, r, n in p.rooms])]).astype(np.int64)
    return p


def stream_pieces(p: Plan, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(start within the document, length, sequence, offset) of a document that lies at ``at`` of the stream."""
    total, done, base = int(p.room_at[-1]), 0, int(p.first_sequence[-1])
    whole = max(0, p.stream - total) // p.capacity
    while done < length:
        here = at + done
        if here < total:
            i = int(np.searchsorted(p.room_at, here, side="right")) - 1
            pattern, first, room, _ = p.rooms[i]
            j, inside = divmod(here - int(p.room_at[i]), room)
            j += first
            size = min(length - done, room - inside)
            offset = int(p.contents(pattern, np.array([j]))[1].sum()) + inside
            yield done, size, int(p.first_sequence[pattern]) + j, offset
        else:
            j, inside = divmod(here - total, p.capacity)
            if j < whole:
                size, sequence = min(length - done, p.capacity - inside), base + j
            else:  # the end: one sequence for each binary digit, the largest first
                end, start = p.stream - total - whole * p.capacity, 0
                for n, bit in enumerate(b for b in range(end.bit_length() - 1, -1, -1) if end >> b & 1):
                    if inside < start + (1 << bit):
                        break
                    start += 1 << bit
                inside -= start
                size, sequence = min(length - done, (1 << bit) - inside), base + whole + n
            yield done, size, sequence, inside
        done += size


def placed(ranked: DataFrame, key: str, p: Plan) -> DataFrame:
    """Pieces of all documents; ``ranked`` has ids only for documents in the stream."""
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType([ranked.schema[key]] + [T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, tokens, rest, alone, rank = (batch.column(n).to_numpy() for n in ("part", "tokens", "rest", "alone", "rank"))
            sums, ids = batch.column("sums").to_pylist(), batch.column("ids")
            kind = -(-rest // p.grain)
            in_class = rank + p.first[rest]
            owner: list[int] = []
            out: list[list[int]] = [[] for _ in names]

            def add(i: int, *values: int) -> None:
                owner.append(i)
                for o, v in zip(out, values, strict=True):
                    o.append(v)

            groups: dict[int, list[tuple[int, int, int]]] = {}
            for i in range(len(tokens)):
                n, whole = int(tokens[i]), int(tokens[i] // p.capacity)
                for j in range(whole):
                    add(i, j * p.capacity, p.capacity, sums[i][j], n, _ALONE * (int(part[i]) + 1) + int(alone[i]) + j, 0)
                if not rest[i]:
                    continue
                k, r = int(kind[i]), int(in_class[i])
                if r < p.streamed[k]:
                    own, base = memoryview(ids[i].as_py()), whole * p.capacity
                    at = int(p.stream_at[k] + p.before[rest[i]] + (r - p.first[rest[i]]) * rest[i])
                    for start, size, sequence, offset in stream_pieces(p, at, int(rest[i])):
                        add(i, base + start, size, zlib.crc32(own[4 * (base + start) : 4 * (base + start + size)]), n, sequence, offset)
                else:
                    r -= int(p.streamed[k])
                    at, times, begins = p.slots[k]
                    s = int(np.searchsorted(begins, r, side="right")) - 1
                    j, place = divmod(r - int(begins[s]), int(times[s]))
                    groups.setdefault(int(at[s]), []).append((i, j, place))
            for pattern, members in groups.items():
                columns, sizes = p.contents(pattern, np.array([j for _, j, _ in members]))
                offsets = np.cumsum(sizes, 1) - sizes
                where = {c: x for x, c in enumerate(columns)}
                for x, (i, j, place) in enumerate(members):
                    n, r = int(tokens[i]), int(rest[i])
                    add(i, n - r, r, sums[i][-1], n, int(p.first_sequence[pattern]) + j, int(offsets[x, where[int(kind[i]), place]]))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner, pa.int64()))] + [pa.array(o, pa.int64()) for o in out], names=schema.names)

    return common.map_arrow(ranked, run, schema)


def pack(df: DataFrame, model: str, end_id: int, capacity: int = 2048, grain: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    table = common.stored(tokenized(df, key, text, model, end_id, capacity), "packing-tokens")
    counts = table.groupBy("rest", "part").agg(F.count("*").alias("n"))
    earlier = counts.withColumn(
        "earlier", F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("rest", "part", F.coalesce("earlier", F.lit(0)).alias("earlier"))
    histogram = np.zeros(capacity, np.int64)
    for r in table.groupBy("rest").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r["rest"]] = r["n"]
    p = plan(histogram, capacity, grain)
    ranked = table.drop("ids").join(earlier, ["rest", "part"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier")
    kinds = -(-np.arange(capacity) // grain)
    cut = [int(max(0, p.streamed[kinds[r]] - p.first[r])) if r else 0 for r in range(capacity)]  # of each length: so many first ranks are in the stream
    in_stream = F.col("rank") < F.element_at(F.from_json(F.lit(json.dumps(cut)), "array<bigint>"), F.col("rest").cast("int") + 1)
    files = max(1, -(-int(histogram.sum()) // ROWS_PER_FILE))
    ranked = common.stored(ranked.withColumn("in_stream", in_stream).coalesce(files), "packing-ranks")
    taken = ranked.where("in_stream")
    if common.small_enough(taken, BROADCAST_ROWS):
        taken = F.broadcast(taken)
    with_ids = taken.join(table.select("part", "row", "ids"), ["part", "row"])
    columns = [key, "part", "tokens", "rest", "alone", "rank", "sums", "ids"]
    rest = ranked.where("not in_stream").withColumn("ids", F.lit(None).cast("binary"))
    return placed(with_ids.select(columns).unionByName(rest.select(columns)), key, p)
