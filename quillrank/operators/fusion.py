"""Rank fusion, quotas, boosts, pools and fills over the long channel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _best(by: list[str], score: str = "score") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc("item_id"))).cast("long")


def fused_scores(channels: DataFrame, constant: int = 60) -> DataFrame:
    """(qid, item_id, score, head): reciprocal-rank scores and each item's best rank in any channel."""
    return channels.groupBy("qid", "item_id").agg(F.round(F.sum(F.col("weight") / (constant + F.col("rank"))), 9).alias("score"), F.min("rank").alias("head"))


def boosted(scores: DataFrame, boost: Column) -> DataFrame:
    """Found items get their boost; the boost is for items, so items not found stay out."""
    return scores.withColumn("score", F.round(F.col("score") + boost, 9))


def fuse(scores: DataFrame, limit: int, quota: int = 0) -> DataFrame:
    """The best ``limit`` items of each query; with a quota, the first ``quota`` of every channel are among them.

    Guaranteed items that missed the cut replace the weakest that aren't
    guaranteed; scores don't change and the result is ranked by score.
    """
    ranked = scores.withColumn("fr", _best(["qid"]))
    if quota:
        ranked = ranked.withColumn("sel", F.col("fr") <= limit).withColumn("g", F.col("head") <= quota)
        q = Window.partitionBy("qid")
        miss, drop = ~F.col("sel") & F.col("g"), F.col("sel") & ~F.col("g")
        ranked = ranked.withColumn("m", F.least(F.count_if(miss).over(q), F.count_if(drop).over(q)))
        ranked = ranked.withColumn("mi", F.row_number().over(Window.partitionBy("qid", miss).orderBy("fr"))).withColumn(
            "di", F.row_number().over(Window.partitionBy("qid", drop).orderBy(F.desc("fr"))),
        )
        ranked = ranked.where((F.col("sel") & ~(drop & (F.col("di") <= F.col("m")))) | (miss & (F.col("mi") <= F.col("m"))))
    else:
        ranked = ranked.where(F.col("fr") <= limit)
    return ranked.withColumn("rank", _best(["qid"])).select("qid", "item_id", "score", "rank")


def bonus_grid(scores: DataFrame, bonuses: list[float], same_place: Column, limit: int) -> DataFrame:
    """Rankings for several location bonuses from one retrieval: (bonus, qid, item_id, score, rank)."""
    each = scores.withColumn("bonus", F.explode(F.array(*(F.lit(float(b)) for b in bonuses))))
    each = each.withColumn("score", F.round(F.col("score") + F.when(same_place, F.col("bonus")).otherwise(0.0), 9))
    return each.withColumn("rank", _best(["bonus", "qid"])).where(F.col("rank") <= limit).select("bonus", "qid", "item_id", "score", "rank")


def pool(channels: DataFrame, limit: int = 998) -> DataFrame:
    """Ordered union of channels without repeats: (qid, item_id, pool_rank)."""
    first = channels.groupBy("qid", "item_id").agg(F.min(F.struct("ch_ord", "rank")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("at.ch_ord", "at.rank", "item_id")).cast("long")
    return first.withColumn("pool_rank", rank).where(F.col("pool_rank") <= limit).select("qid", "item_id", "pool_rank")


def novel_fill(base: DataFrame, routes: DataFrame, capacity: int, constant: int = 60) -> DataFrame:
    """Items of the routes that aren't in the base, by equal reciprocal ranks, as far as the capacity lasts.

    Routes are ranked before the base's items leave, so those keep their
    places and don't move others up.
    """
    novel = routes.join(base.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
    scored = novel.groupBy("qid", "item_id").agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 9).alias("score"))
    size = base.groupBy("qid").agg(F.count("*").alias("n_base"))
    ranked = scored.withColumn("rank", _best(["qid"])).join(size, "qid", "left")
    return ranked.where(F.col("rank") <= capacity - F.coalesce("n_base", F.lit(0))).select("qid", "item_id", "score", "rank")


def ordered_fill(base: DataFrame, routes: DataFrame, capacity: int) -> DataFrame:
    """Items of the routes in channel order, then rank, after the base: (qid, item_id, rank)."""
    novel = routes.join(base.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
    first = novel.groupBy("qid", "item_id").agg(F.min(F.struct("ch_ord", "rank")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("at.ch_ord", "at.rank", "item_id")).cast("long")
    size = base.groupBy("qid").agg(F.count("*").alias("n_base"))
    return first.withColumn("rank", rank).join(size, "qid", "left").where(
        F.col("rank") <= capacity - F.coalesce("n_base", F.lit(0))
    ).select("qid", "item_id", "rank")


def replaced(channels: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """A pool of the first items of each named route: (qid, item_id, pool_rank)."""
    keep = F.lit(False)
    for name, n in quotas.items():
        keep = keep | ((F.col("channel") == name) & (F.col("rank") <= n))
    return pool(channels.where(keep))


def difference(base: DataFrame, variant: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: hits of both pools, and what the variant adds and loses."""
    flags = base.select("qid", "item_id", F.lit(True).alias("in_base")).join(
        variant.select("qid", "item_id", F.lit(True).alias("in_variant")), ["qid", "item_id"], "full_outer",
    )
    flags = flags.join(truth.select("qid", "item_id", F.lit(True).alias("hit")), ["qid", "item_id"], "left").na.fill(False, ["in_base", "in_variant", "hit"])
    b, v, h = F.col("in_base"), F.col("in_variant"), F.col("hit")
    return flags.groupBy("qid").agg(
        F.count_if(b & h).alias("base_hits"), F.count_if(v & h).alias("variant_hits"), F.count_if(v & ~b).alias("additions"),
        F.count_if(b & ~v).alias("losses"), F.count_if(v & ~b & h).alias("new_hits"), F.count_if(b & ~v & h).alias("lost_hits"),
    )


def normalized_weights(channels: DataFrame, total: float) -> DataFrame:
    """Channel weights scaled to sum to ``total`` within each query, every channel counted once."""
    each = channels.select("qid", "channel", "weight").distinct()
    share = each.withColumn("share", total * F.col("weight") / F.sum("weight").over(Window.partitionBy("qid")))
    return channels.join(share.select("qid", "channel", "share"), ["qid", "channel"]).withColumn("weight", F.col("share")).drop("share")
