"""Sharding by best fit decreasing (operator 2).

Equal texts are a group that stays in one shard.  Groups, largest first, enter
the shard with the least room that still holds them, found in a balanced tree
of rooms; the capacity is the least at which the given number of shards
suffices, so the shards' bytes come out near equal.

Every group is packed, none by proxy.  Groups of equal weight are
interchangeable, so the driver packs a histogram of weights: of equal ones, as
many as its room holds enter the tightest shard at once, which is what best fit
does with them one by one.  The driver holds a row for each distinct weight (at
most the square root of twice the bytes in all) and fewer than shards x
``HEAVY`` groups by name; which of equal groups goes where is settled by their
ranks, counted in strips, in the tables.

A group heavier than an even share of all bytes (a hot text) cannot stay whole
if sizes are to be near equal: with a third of all bytes it alone would make a
shard eight times the mean of 24.  Such groups, fewer than there are shards,
are divided by a hash of the id into ``SALTS`` parts.

Null text has size 0 and is equal to the empty text.  Repeated rows have slots
of their own; ties go by text hash, then id.  Very long texts count whole.  An
empty table gives no rows.  Columns other than key and text are not read,
whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

HEAVY, SALTS = 64, 64
#: Up to so many runs (weight, ranks, shard) are broadcast; more are joined.
BROADCAST_RUNS = 1_000_000


class Rooms:
    """A balanced (AVL) tree of (room, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    @staticmethod
    def _h(n: list | None) -> int:
        return n[3] if n else 0

    def _fix(self, n: list) -> list:
        def height(x: list) -> None:
            x[3] = 1 + max(self._h(x[1]), self._h(x[2]))

        def lift(x: list, down: int, up: int) -> list:
            y = x[up]
            x[up], y[down] = y[down], x
            height(x)
            height(y)
            return y

        height(n)
        lean = self._h(n[1]) - self._h(n[2])
        if lean > 1:
            if self._h(n[1][1]) < self._h(n[1][2]):
                n[1] = lift(n[1], 1, 2)
            return lift(n, 2, 1)
        if lean < -1:
            if self._h(n[2][2]) < self._h(n[2][1]):
                n[2] = lift(n[2], 2, 1)
            return lift(n, 1, 2)
        return n

    def add(self, key: tuple[int, int]) -> None:
        def go(n: list | None) -> list:
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = go(n[side])
            return self._fix(n)

        self.root = go(self.root)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the least (room, bin) whose room is at least ``size``."""
        n, found = self.root, None
        while n is not None:
            if n[0][0] >= size:
                found, n = n[0], n[1]
            else:
                n = n[2]
        if found is not None:
            self.root = self._without(self.root, found)
        return found

    def _without(self, n: list, key: tuple[int, int]) -> list | None:
        if key == n[0]:
            if n[1] is None or n[2] is None:
                return n[1] or n[2]
            after = n[2]
            while after[1] is not None:
                after = after[1]
            n[0] = after[0]
            n[2] = self._without(n[2], after[0])
        elif key < n[0]:
            n[1] = self._without(n[1], key)
        else:
            n[2] = self._without(n[2], key)
        return self._fix(n)


def best_fit_decreasing(items: list[tuple[int, int]], capacity: int, most: int) -> list[list[tuple[int, int]]] | None:
    """For each (weight, times), weights descending, the bins that take them with how many; None if more than ``most`` bins are needed.

    After one of equal weights the tightest bin is still the tightest that
    holds the next, so it takes as many as fit at once.
    """
    rooms, out, bins = Rooms(), [], 0
    for w, times in items:
        own = []
        while times:
            at = rooms.take(w)
            if at is None:
                if bins == most or w > capacity:
                    return None
                at, bins = (capacity, bins), bins + 1
            n = min(times, at[0] // w)
            rooms.add((at[0] - n * w, at[1]))
            own.append((at[1], n))
            times -= n
        out.append(own)
    return out


def smallest_capacity(items: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Bins at the least capacity (to a 4096th of the mean) with which best fit decreasing needs no more bins than ``shards``."""
    if not items:
        return []
    low = max(-(-sum(w * n for w, n in items) // shards), items[0][0])
    step = max(1, low // 4096)
    if (found := best_fit_decreasing(items, low, shards)) is not None:
        return found
    reach = step
    while (found := best_fit_decreasing(items, low + reach, shards)) is None:
        reach *= 2
    bad, good = reach // 2, reach
    while good - bad > step:
        middle = (good + bad) // 2
        if (now := best_fit_decreasing(items, low + middle, shards)) is None:
            bad = middle
        else:
            good, found = middle, now
    return found


def shard(df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    body = common.text_bytes(text)
    rows = common.stored(
        df.select(
            F.col(f"`{key}`").alias(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("grp"),
        ),
        "shard-rows",
    )
    groups = common.stored(rows.groupBy("grp").agg(F.sum("size").alias("weight")), "shard-groups")
    total = groups.agg(F.sum("weight")).first()[0] or 0
    is_heavy = F.col("weight") * (shards * HEAVY) > total
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    heavy = [(bytes(r["grp"]), r["weight"]) for r in groups.where(is_heavy).collect()]  # fewer than shards * HEAVY
    hot = [g for g, w in heavy if w * shards > total]  # fewer than ``shards``
    is_hot = F.col("grp").isin(hot) if hot else F.lit(False)
    named = [(w, g, -1) for g, w in heavy if g not in set(hot)]
    if hot:
        named += [(r["w"], bytes(r["grp"]), r["part"]) for r in rows.where(is_hot).groupBy("grp", salt.alias("part")).agg(F.sum("size").alias("w")).collect()]
    named.sort(key=lambda i: (-i[0], i[1], i[2]))
    light = groups.where(~is_heavy)
    histogram = light.groupBy("weight").agg(F.count("*").alias("n")).toArrow()  # a row for each distinct weight
    sizes = sorted(zip(histogram["weight"].to_pylist(), histogram["n"].to_pylist(), strict=True), reverse=True)
    # A part of a hot group may weigh less than a light group: all go in by weight.
    order = sorted([(-w, 0, i) for i, (w, _, _) in enumerate(named)] + [(-w, 1, i) for i, (w, _) in enumerate(sizes)])
    bins = smallest_capacity([(-w, 1 if kind == 0 else sizes[i][1]) for w, kind, i in order], shards)
    of_name, runs = [], []
    for (w, kind, i), own in zip(order, bins, strict=True):
        begin = 0
        for b, n in own:
            if kind == 0:
                of_name.append((named[i][1], named[i][2], b))
            else:
                runs.append((-w, begin, begin + n, b))
            begin += n
    # Heavy groups' rows find their shard by name, in a broadcast of bounded size; the others' by weight and rank of their group.
    known = spark.createDataFrame(of_name, "grp binary, part int, named int")
    part = F.when(is_hot, salt).otherwise(F.lit(-1))
    rows = rows.withColumn("part", part).join(F.broadcast(known), ["grp", "part"], "left")
    columns = [pa.array(c, t) for c, t in zip(list(zip(*runs, strict=True)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
    dealt = spark.createDataFrame(pa.table(columns, names=["weight", "begin", "end", "own"]))
    if len(runs) <= BROADCAST_RUNS:
        dealt = F.broadcast(dealt)
    placed = ranked(light).join(dealt, "weight").where("rank >= begin and rank < end").select("grp", "own")
    out = rows.where("named is not null").withColumn("shard", F.col("named")).drop("named")
    out = out.unionByName(rows.where("named is null").drop("named").join(placed, "grp").withColumnRenamed("own", "shard"))
    return slotted(out.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard"), key).withColumn("grown_shard", F.lit(None).cast("int"))


def _strips(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranked(groups: DataFrame) -> DataFrame:
    """(grp, weight, rank): ranks from 0 among groups of equal weight; a frequent weight's groups are counted in strips."""
    groups = groups.withColumn("strip", F.pmod(F.xxhash64("grp"), F.lit(_strips(groups))).cast("int"))
    counts = groups.groupBy("weight", "strip").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("weight").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1))
    begin = counts.select("weight", "strip", F.coalesce(before, F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("weight", "strip").orderBy("grp"))
    return groups.withColumn("place", place).join(begin, ["weight", "strip"]).select("grp", "weight", (F.col("earlier") + F.col("place") - 1).alias("rank"))


def slotted(placed: DataFrame, key: str) -> DataFrame:
    """Gapless slots from 0 within each shard: counts of earlier strips plus the rank within the strip."""
    strips = _strips(placed)
    placed = placed.withColumn("strip", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(strips)).cast("int"))
    counts = placed.groupBy("shard", "strip").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1))
    begin = counts.select("shard", "strip", F.coalesce(before, F.lit(0)).alias("begin"))  # at most shards x strips rows
    rank = F.row_number().over(Window.partitionBy("shard", "strip").orderBy(key, "text_crc32", "size"))
    ranked = placed.withColumn("rank", rank).join(F.broadcast(begin), ["shard", "strip"])
    return ranked.select(key, "size", "text_crc32", "law", "shard", (F.col("begin") + F.col("rank") - 1).alias("slot"))
