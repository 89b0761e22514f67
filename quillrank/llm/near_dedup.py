"""Near-duplicate groups by b-bit MinHash (operator 6).

A document's set is its distinct runs of ``WORDS`` words.  Documents with
equal sets are one class, so copies cost nothing further.  Of ``HASHES``
minima a class keeps ``BITS`` low bits each, packed; ``BANDS`` bands of
``ROWS`` whole minima bring candidates together.  The similarity of two
signatures is the share of equal low bits, counted on the packed words and
corrected for the 2**-BITS of them that are equal by chance.  Candidates
within ``MARGIN`` of the threshold (four standard errors) are compared on
their full sets; only confirmed links count.

Pairs within a bucket are never listed.  First each class is compared with one
leader, the smallest id among its buckets' leaders that the signatures
support.  Only buckets that then still hold several components go on: their
members are compared by signature in blocks of bounded size, those with a
likely partner in another component form families, and families are compared
on full sets, again in blocks, skipping what is already connected.  Blocks are
bounded by their rows and, where full sets are compared, by their bytes (but
for a set that is longer alone); each pair of blocks is dealt to a task by
itself, whatever the size of its bucket or family, and nothing is capped.

A link at similarity 0.75 is missed by all bands with a probability of
(1 - 0.75**ROWS)**BANDS = 5e-6.

Null texts, empty ones and those without words have the empty set: they are
linked with nothing and stay.  Fewer words than WORDS: the whole sequence is
the one element.  Rows with equal ids are nodes by their text; each gets its
own row.  Equal sets are one class whose smallest id stands for it.  An empty
table gives no rows.  Columns other than key and text are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel
from .graph import components

WORDS, HASHES, BITS, BANDS, ROWS = 5, 256, 4, 32, 4
MARGIN = 0.12
#: Rows of a block, and bytes of full sets in one.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Up to so many buckets or families of several blocks are broadcast; more are joined.
BROADCAST_GROUPS = 200_000
BROADCAST_ROWS = 500_000
_MULTIPLIERS = np.random.default_rng(17).integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_NIBBLES = np.uint64(0x1111111111111111)
_BAND = np.random.default_rng(19).integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct word runs of each row, as hashes."""
    for a, b in common.chunks(offsets):
        own, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, counts = kernel.words(own, at, kernel.NOT_SPACE)
        words = kernel.span_hashes(own, starts, ends, kernel.LOWER_CODES)
        runs = kernel.rolled(words, WORDS)
        first = np.concatenate([[0], np.cumsum(counts)])
        for i in range(b - a):
            n = int(counts[i])
            if n >= WORDS:
                yield np.unique(runs[first[i] : first[i + 1] - WORDS + 1])
            elif n:
                yield kernel.rolled(words[first[i] : first[i + 1]], n)
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 4096):
        np.minimum(least, (short[None, a : a + 4096] * _MULTIPLIERS[:, None]).min(1), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """The low bits of the minima, two to a byte."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        return kernel.mix((rows * _BAND[:, :ROWS]).sum(1, dtype=np.uint64) + _BAND[:, ROWS]).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (last axis: 64-bit words), corrected for chance."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    same = 1 - np.bitwise_count(x & _NIBBLES).sum(-1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def signatures_of(column: Iterable[bytes]) -> np.ndarray:
    data = b"".join(column)
    return np.frombuffer(data, np.uint64).reshape(-1, HASHES * BITS // 64)


def class_hash(shingles: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))


def signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, n_shingles, class (null for the empty set), band keys, packed signature."""
    schema = T.StructType(
        [
            df.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, keys, bits = [], [], [], []
            for s in shingle_sets(*common.buffer_of(batch.column(1))):
                sizes.append(len(s))
                if not len(s):
                    classes.append(None), bits.append(None)
                    continue
                least = minima(s)
                classes.append(class_hash(s)), keys.append(bands(least)), bits.append(packed(least))
            full = np.array([c is not None for c in classes], bool)
            lists = common.list_array(pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), full * BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists, pa.array(bits, pa.binary())],
                names=schema.names,
            )

    return common.map_arrow(df.select(key, common.text_bytes(text)), run, schema)


def sets_of(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(cls, shingles) of the classes in ``wanted`` (cls, rep), from the texts of their representatives."""
    reps = wanted.select(F.col("rep").alias("__rep"), F.col("cls").alias("__cls")).distinct()
    if common.small_enough(reps, BROADCAST_ROWS):
        reps = F.broadcast(reps)
    texts = df.join(reps, F.col(key) == F.col("__rep")).select(common.text_bytes(text).alias("t"), "__cls")
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(c, s.tobytes()) for c, s in zip(batch.column(1).to_pylist(), shingle_sets(*common.buffer_of(batch.column(0))), strict=True) if len(s) and class_hash(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=schema.names)

    return common.map_arrow(texts, run, schema).dropDuplicates(["cls"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets (sorted, distinct)."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose sets are similar enough."""
    own = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=schema.names).filter(pa.array(ok, pa.bool_()))

    return common.map_arrow(edges.join(own, "a").join(other, "b").select("a", "b", "sa", "sb"), run, schema)


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (…, bits_a, bits_b) whose signatures come within the margin of the threshold."""
    schema = T.StructType([f for f in pairs.schema.fields if f.name not in ("bits_a", "bits_b")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = similarity(signatures_of(batch.column("bits_a").to_pylist()), signatures_of(batch.column("bits_b").to_pylist())) >= percent / 100 - MARGIN
            yield batch.select(schema.names).filter(pa.array(near, pa.bool_()))

    return common.map_arrow(pairs, run, schema)


class Union:
    """Disjoint sets of local numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def likely_pairs(rows: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of the rows of different components that may be linked; rows of one block with each other, or of one with another's."""
    bits, size = signatures_of(rows["bits"]), rows["n"].to_numpy()
    _, comp = np.unique(rows["comp"].to_numpy(), return_inverse=True)
    one = rows["lo"].iloc[0] == rows["hi"].iloc[0]
    left = np.arange(len(rows)) if one else np.flatnonzero(rows["block"] == rows["lo"])
    right = left if one else np.flatnonzero(rows["block"] == rows["hi"])
    for at in range(0, len(left), 128):
        i = left[at : at + 128]
        able = (comp[i][:, None] != comp[right][None]) & (
            100 * np.minimum(size[i][:, None], size[right][None]) >= percent * np.maximum(size[i][:, None], size[right][None])
        )
        if one:
            able &= i[:, None] < right[None]
        x, y = np.nonzero(able)
        near = similarity(bits[i[x]], bits[right[y]])
        keep = near >= percent / 100 - MARGIN
        yield i[x[keep]], right[y[keep]], near[keep]


def in_blocks(rows: DataFrame, group: str, size: F.Column | None = None) -> DataFrame:
    """Rows dealt into pairs of blocks of about ``BLOCK`` members (``BLOCK_BYTES`` of ``size``) of their group: group, lo, hi, block.

    Only groups of several blocks are looked up; the pairs are dealt anew by
    (group, lo, hi), so a large group's pairs become tasks of their own.
    """
    spark = rows.sparkSession
    own = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size) / BLOCK_BYTES) if size is not None else F.lit(1)).cast("int")
    large = common.stored(rows.groupBy(group).agg(own.alias("blocks")).where("blocks > 1"), "near-blocks")
    if common.small_enough(large, BROADCAST_GROUPS):
        large = F.broadcast(large)
    dealt = rows.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"),
    )
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    out = dealt.withColumn("pair", F.explode(pairs)).select("*", "pair.lo", "pair.hi").drop("pair", "blocks")
    return out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), group, "lo", "hi")


_EDGES = "a long, b long"


def families(members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the members of each bucket that have a likely partner in another component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = Union(len(rows))
        touched = np.zeros(len(rows), bool)
        for i, j, _ in likely_pairs(rows, percent):
            touched[i] = touched[j] = True
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                own.join(x, y)
        at = np.flatnonzero(touched)
        cls = rows["cls"].to_numpy()
        return pd.DataFrame({"a": cls[at], "b": cls[[own.find(int(x)) for x in at]] if len(at) else cls[at]})

    return in_blocks(members, "key").groupBy("key", "lo", "hi").applyInPandas(run, _EDGES)


def confirmed_in_families(rows: DataFrame, percent: int) -> DataFrame:
    """Edges that connect, on full sets, the components within each family."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        cls, comp = rows["cls"].to_numpy(), np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
        own, out = Union(int(comp.max()) + 1), []
        for i, j, near in likely_pairs(rows, percent):
            for k in np.argsort(-near):
                x, y = int(i[k]), int(j[k])
                if own.find(int(comp[x])) != own.find(int(comp[y])) and linked(sets[x], sets[y], percent):
                    own.join(int(comp[x]), int(comp[y]))
                    out.append((cls[x], cls[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return in_blocks(rows, "family", 8 * F.col("n")).groupBy("family", "lo", "hi").applyInPandas(run, _EDGES)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id, kept."""
    spark = df.sparkSession
    table = common.stored(signatures(df, key, text), "near-signatures")
    full = table.where("cls is not null")
    classes = common.stored(
        full.groupBy("cls").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands")),
        "near-classes",
    )
    entries = classes.select("cls", "rep", F.explode("bands").alias("key"))
    leaders = entries.groupBy("key").agg(
        F.min(F.struct("rep", "cls")).alias("lead"), F.count("*").alias("m"),
    ).where("m > 1").select("key", F.col("lead.cls").alias("leader"))
    members = common.stored(entries.join(leaders, "key").select("key", "cls", "leader"), "near-members")
    slim = classes.select("cls", "rep", "n", "bits")
    lead = slim.select(F.col("cls").alias("b"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
    pairs = members.where("cls <> leader").select(F.col("cls").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = pairs.join(slim.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a").join(lead, "b")
    able = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    stars = likely(pairs.where(able).select("a", "b", "rep_b", "bits_a", "bits_b"), percent).groupBy("a").agg(F.min(F.struct("rep_b", "b")).alias("to"))
    stars = common.stored(stars.select("a", F.col("to.b").alias("b")), "near-stars")

    def sets(ids: DataFrame) -> DataFrame:
        return common.stored(sets_of(df, classes.join(ids, "cls", "left_semi").select("cls", "rep"), key, text), "near-sets")

    ends = stars.select(F.col("a").alias("cls")).unionByName(stars.select(F.col("b").alias("cls"))).distinct()
    compared = sets(ends)
    links = common.stored(confirmed(stars, compared, percent), "near-links")
    common.release(compared, stars)
    labels = components(links)
    comp = labels.select(F.col("node").alias("cls"), "comp")
    labelled = members.select("key", "cls").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_ = common.stored(labelled.join(mixed, "key", "left_semi").join(slim.select("cls", "n", "bits"), "cls"), "near-open")
    ties = common.stored(families(open_, percent).distinct(), "near-ties")
    common.release(open_, members)
    if not ties.isEmpty():
        alone = ties.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("comp"))
        joined = components(ties)
        family = common.stored(joined.unionByName(alone).groupBy("node").agg(F.min("comp").alias("family")).withColumnRenamed("node", "cls"), "near-families")
        compared = sets(family.select("cls"))
        rows = family.join(compared, "cls").join(slim.select("cls", "n", "bits"), "cls").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        more = common.stored(confirmed_in_families(rows, percent), "near-links")
        common.release(joined, family, compared)
        if not more.isEmpty():
            common.release(labels)
            labels = components(links.unionByName(more))
        common.release(more)
    common.release(ties, links)
    comp = labels.select(F.col("node").alias("cls"), "comp")
    reps = classes.select("cls", "rep").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = reps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = common.stored(reps.join(least, "comp").select("cls", "component_id"), "near-components")
    common.release(classes, labels)
    out = table.select(key, "n_shingles", "cls").join(of, "cls", "left").withColumn("component_id", F.coalesce("component_id", key))
    return out.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))
