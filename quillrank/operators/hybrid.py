"""Hybrid retrieval: lexical, geographic, category, supplemental and dense channels in one long table, fused.

A channel table has the columns qid, channel, ch_ord, weight, item_id, rank,
raw_score.  Channels that only add candidates have weight 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fusion

#: Fixed value: most candidates of a query.
CAPACITY = 998


@dataclass(frozen=True)
class Plan:
    """Weights of the fields in their order, and how lexical, geographic and dense channels are mixed."""

    fields: tuple[tuple[str, float], ...] = (("title", 2.0), ("params", 1.0), ("description", 0.5))
    depth: int = 50
    geo_depth: int = 0
    geo_weight: float = 0.25
    lexical: float = 1.0
    dense: float = 1.0
    constant: int = 60
    quota: int = 0
    bonus: float = 0.0

    @property
    def names(self) -> list[str]:
        """All channels in order: each field, then its geographic one, then dense."""
        return [n for f, _ in self.fields for n in (f, f"{f}_geo")] + ["dense"]


def _place(by: list[str], score: str = "raw_score") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "item_id")).cast("long")


def lexical_channels(scored: DataFrame, destinations: DataFrame, items: DataFrame, plan: Plan) -> DataFrame:
    """Channels of every field, over all items and over those in a query's destinations, from one table of scores.

    ``scored``: field, qid, doc, score; ``destinations``: qid, place (a few for
    a query).  An item's place is looked up once, and the mask comes before the
    cut.  All lexical channels of a query together weigh ``plan.lexical``; the
    geographic ones count for queries that have destinations.
    """
    order = {f: i for i, (f, _) in enumerate(plan.fields)}
    own = F.create_map(*(F.lit(x) for f, w in plan.fields for x in (f, w)))
    turn = F.create_map(*(F.lit(x) for f, i in order.items() for x in (f, 2 * i)))
    total = sum(w for _, w in plan.fields)
    rows = scored.where(F.col("field").isin(*order)).select("field", "qid", F.col("doc").alias("item_id"), F.col("score").alias("raw_score"))
    if not plan.geo_depth:
        top = rows.withColumn("rank", _place(["field", "qid"])).where(F.col("rank") <= plan.depth)
        return top.select(
            "qid", F.col("field").alias("channel"), F.element_at(turn, F.col("field")).alias("ch_ord"),
            (plan.lexical * F.element_at(own, F.col("field")) / total).alias("weight"), "item_id", "rank", "raw_score",
        )
    places = destinations.groupBy("qid").agg(F.collect_set("place").alias("places"))
    rows = rows.join(items.select("item_id", F.col("location").alias("at")), "item_id").join(places, "qid", "left")
    rows = rows.withColumn("inside", F.coalesce(F.array_contains("places", F.col("at")), F.lit(False))).withColumn("some", F.col("places").isNotNull())
    rows = rows.withColumn("rank", _place(["field", "qid"])).withColumn("near", _place(["field", "qid", "inside"]))
    rows = rows.where((F.col("rank") <= plan.depth) | (F.col("inside") & (F.col("near") <= plan.geo_depth)))
    share = plan.lexical * F.element_at(own, F.col("field")) / (total * F.when(F.col("some"), 1 + plan.geo_weight).otherwise(1.0))
    one = lambda keep, name, turn, weight, rank: F.when(keep, F.struct(name.alias("channel"), turn.alias("ch_ord"), weight.alias("weight"), rank.alias("rank")))
    at = F.element_at(turn, F.col("field"))
    both = F.array(
        one(F.col("rank") <= plan.depth, F.col("field"), at, share, F.col("rank")),
        one(F.col("inside") & (F.col("near") <= plan.geo_depth), F.concat("field", F.lit("_geo")), at + 1, share * plan.geo_weight, F.col("near")),
    )
    out = rows.select("qid", "item_id", "raw_score", F.explode(both).alias("c")).where("c IS NOT NULL")
    return out.select("qid", "c.channel", "c.ch_ord", "c.weight", "item_id", "c.rank", "raw_score")


def novel_channel(route: DataFrame, base: DataFrame, name: str, order: int, most: int, capacity: int = CAPACITY, weight: float = 0.0) -> DataFrame:
    """What a ranked route (qid, item_id, rank, raw_score) adds to a base, in its order, under a budget.

    The route keeps its own first ``capacity`` before the base's items leave,
    so they don't move others into it; then at most ``most`` enter, as far as
    the base leaves places.
    """
    held = base.select("qid", "item_id").distinct()
    size = held.groupBy("qid").agg(F.count("*").alias("held"))
    novel = route.where(F.col("rank") <= capacity).join(held, ["qid", "item_id"], "left_anti")
    again = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "item_id")).cast("long")
    free = F.least(F.lit(most), capacity - F.coalesce("held", F.lit(0)))
    kept = novel.withColumn("place", again).join(size, "qid", "left").where(F.col("place") <= free)
    return kept.select(
        "qid", F.lit(name).alias("channel"), F.lit(order).alias("ch_ord"), F.lit(weight).alias("weight"), "item_id",
        F.col("place").alias("rank"), "raw_score",
    )


def related_channels(
    scored: DataFrame, related: DataFrame, items: DataFrame, base: DataFrame, plan: Plan, order: int = 40, capacity: int = CAPACITY,
) -> DataFrame:
    """Channels of weight 0 over related places (qid, place), field by field, into the places that the base leaves.

    An item enters with the first field that has it.
    """
    turn = F.create_map(*(F.lit(x) for i, (f, _) in enumerate(plan.fields) for x in (f, order + i)))
    inside = scored.join(
        items.select(F.col("item_id").alias("doc"), F.col("location").alias("place")), "doc",
    ).join(related, ["qid", "place"], "left_semi")
    rows = inside.select("qid", "field", F.element_at(turn, F.col("field")).alias("ch_ord"), F.col("doc").alias("item_id"), F.col("score").alias("raw_score"))
    held = base.select("qid", "item_id").distinct()
    size = held.groupBy("qid").agg(F.count("*").alias("held"))
    free = capacity - F.coalesce("held", F.lit(0))
    ranked = rows.withColumn("rank", _place(["qid", "field"])).join(size, "qid", "left").where(F.col("rank") <= F.least(F.lit(plan.geo_depth), free))
    novel = ranked.join(held, ["qid", "item_id"], "left_anti")
    first = novel.withColumn("turn", F.row_number().over(Window.partitionBy("qid", "item_id").orderBy("ch_ord", "rank"))).where("turn = 1")
    fill = first.withColumn("fill", F.row_number().over(Window.partitionBy("qid").orderBy("ch_ord", "rank", "item_id"))).where(F.col("fill") <= free)
    again = F.row_number().over(Window.partitionBy("qid", "ch_ord").orderBy("rank", "item_id")).cast("long")
    return fill.select(
        "qid", F.concat("field", F.lit("_geo_related")).alias("channel"), "ch_ord", F.lit(0.0).alias("weight"), "item_id",
        again.alias("rank"), "raw_score",
    )


def supplemental_channels(routes: DataFrame, base: DataFrame, order: int = 20, capacity: int = CAPACITY, constant: int = 60) -> DataFrame:
    """The fill of several equal routes (qid, channel, item_id, rank, raw_score), and those routes cut to it; all of weight 0.

    Routes keep their own ranks; what isn't in the base enters by the sum of
    its reciprocal ranks, ties by id, as far as the base leaves places.
    """
    fill = fusion.novel_fill(base.select("qid", "item_id").distinct(), routes, capacity, constant)
    head = fill.select(
        "qid", F.lit("supplemental_fill").alias("channel"), F.lit(order).alias("ch_ord"), F.lit(0.0).alias("weight"), "item_id", "rank",
        F.col("score").alias("raw_score"),
    )
    again = F.row_number().over(Window.partitionBy("qid", "channel").orderBy("rank", "item_id")).cast("long")
    kept = routes.join(fill.select("qid", "item_id"), ["qid", "item_id"], "left_semi")
    turn = F.dense_rank().over(Window.partitionBy("qid").orderBy("channel"))
    tails = kept.select("qid", "channel", (order + turn).alias("ch_ord"), F.lit(0.0).alias("weight"), "item_id", again.alias("rank"), "raw_score")
    return head.unionByName(tails)


def fused(channels: DataFrame, queries: DataFrame, items: DataFrame, plan: Plan) -> DataFrame:
    """(qid, item_id, score, head): reciprocal-rank scores with the bonus of an item in the query's own place."""
    scores = fusion.fused_scores(channels, plan.constant)
    if not plan.bonus:
        return scores
    joined = scores.join(queries.select("qid", F.col("location").alias("here")), "qid").join(items.select("item_id", F.col("location").alias("at")), "item_id")
    same = (F.col("at") == F.col("here")) & (F.col("here") != "")
    return fusion.boosted(joined, F.when(same, plan.bonus).otherwise(0.0)).select("qid", "item_id", "score", "head")


def swapped(channels: DataFrame, name: str, other: DataFrame) -> DataFrame:
    """The same channels with one of them replaced by another ranking (qid, item_id, rank, raw_score); order and weight stay."""
    old = channels.where(F.col("channel") == name)
    place = old.select("ch_ord", "weight").distinct()  # one row
    new = other.crossJoin(F.broadcast(place)).select("qid", F.lit(name).alias("channel"), "ch_ord", "weight", "item_id", "rank", "raw_score")
    return channels.where(F.col("channel") != name).unionByName(new)
