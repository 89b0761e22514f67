"""Variants of candidate pools, declared as plain values (or JSON), formed without looking at any label."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fusion
from .hybrid import CAPACITY


@dataclass(frozen=True)
class Variant:
    """A pool: ``fill`` adds to the base what weighted new channels have besides, ``replace`` takes the heads of named channels.

    ``channels``: for fill, name to weight; for replace, name to (source, quota),
    the source "base" or "new".  Fills of one ``family`` add equally many.
    """

    name: str
    mode: str
    channels: dict = field(default_factory=dict)
    quota: int | None = None
    family: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("fill", "replace") or not self.channels:
            raise ValueError(f"variant {self.name}: mode is fill or replace, with at least one channel")
        if self.mode == "replace" and any(source not in ("base", "new") or quota < 1 for source, quota in self.channels.values()):
            raise ValueError(f"variant {self.name}: a channel's source is base or new, its quota positive")


def declared(text: str) -> list[Variant]:
    """Variants of a JSON list; names must differ."""
    out = []
    for v in json.loads(text):
        channels = {k: (c["source"], c["quota"]) if isinstance(c, dict) else float(c) for k, c in v["channels"].items()}
        out.append(Variant(v["name"], v["mode"], channels, v.get("addition_quota"), v.get("matched_addition_family")))
    if len({v.name for v in out}) != len(out):
        raise ValueError("two variants have one name")
    return out


def _require(channels: DataFrame, names: set[str]) -> None:
    have = {r["channel"] for r in channels.select("channel").distinct().collect()}  # the channels' names
    if missing := names - have:
        raise ValueError(f"missing channels: {', '.join(sorted(missing))}")


def pools(base: DataFrame, new: DataFrame, variants: list[Variant], capacity: int = CAPACITY, constant: int = 60) -> DataFrame:
    """(variant, qid, item_id, pool_rank) of every variant, from the long tables of base and new channels."""
    fills, heads = [v for v in variants if v.mode == "fill"], [v for v in variants if v.mode == "replace"]
    _require(new, {c for v in fills for c in v.channels} | {c for v in heads for c, (s, _) in v.channels.items() if s == "new"})
    _require(base, {c for v in heads for c, (s, _) in v.channels.items() if s == "base"})
    held = fusion.pool(base, capacity)
    parts: list[DataFrame] = []
    if fills:
        parts.append(_filled(held, new, fills, capacity, constant))
    for v in heads:
        order = {c: i for i, c in enumerate(v.channels)}
        taken = None
        for c, (source, quota) in v.channels.items():
            one = (base if source == "base" else new).where((F.col("channel") == c) & (F.col("rank") <= quota)).select(
                "qid", F.lit(order[c]).alias("ch_ord"), "item_id", "rank",
            )
            taken = one if taken is None else taken.unionByName(one)
        parts.append(fusion.pool(taken, capacity).select(F.lit(v.name).alias("variant"), "qid", "item_id", "pool_rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _filled(held: DataFrame, new: DataFrame, fills: list[Variant], capacity: int, constant: int) -> DataFrame:
    weights = [F.struct(F.lit(v.name).alias("variant"), F.lit(c).alias("channel"), F.lit(float(w)).alias("w")) for v in fills for c, w in v.channels.items()]
    about = [
        F.struct(
            F.lit(v.name).alias("variant"), F.lit(v.family or f"\u0000{v.name}").alias("family"),
            F.lit(v.quota if v.quota is not None else capacity).alias("quota"),
        ) for v in fills
    ]
    spark = held.sparkSession
    wanted = spark.range(1).select(F.inline(F.array(*weights)))
    told = spark.range(1).select(F.inline(F.array(*about)))
    novel = new.join(held.select("qid", "item_id"), ["qid", "item_id"], "left_anti").join(F.broadcast(wanted), "channel")
    scored = novel.groupBy("variant", "qid", "item_id").agg(F.round(F.sum(F.col("w") / (constant + F.col("rank"))), 9).alias("score"))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("variant", "qid").orderBy(F.desc("score"), "item_id")))
    sizes = held.groupBy("qid").agg(F.count("*").alias("size"))
    asked = new.select("qid").distinct().join(sizes, "qid", "left").withColumn("size", F.coalesce("size", F.lit(0))).crossJoin(F.broadcast(told))  # a row for each query and variant
    found = ranked.groupBy("variant", "qid").agg(F.count("*").alias("n"))
    room = asked.join(found, ["variant", "qid"], "left").withColumn("want", F.least(capacity - F.col("size"), F.coalesce("n", F.lit(0)), F.col("quota")))
    room = room.withColumn("want", F.min("want").over(Window.partitionBy("qid", "family"))).select("variant", "qid", "size", "want")
    added = ranked.join(room, ["variant", "qid"]).where(F.col("place") <= F.col("want")).select(
        "variant", "qid", "item_id", (F.col("size") + F.col("place")).cast("long").alias("pool_rank"),
    )
    kept = held.crossJoin(F.broadcast(told.select("variant"))).select("variant", "qid", "item_id", "pool_rank")
    return kept.unionByName(added)
