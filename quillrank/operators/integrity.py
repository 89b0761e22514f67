"""Checks and reconstructions of stored rankings and training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S


def recovered_ranks(rows: DataFrame, inverse: str, constant: int, by: list[str]) -> DataFrame:
    """(by, n, max_rank, complete): ranks read back from 1 / (constant + rank); complete if they are 1 to n, once each.

    Rows whose feature is null or 0 (not in the list) stay out.
    """
    rank = F.round(1 / F.col(inverse) - constant).cast("long")
    found = rows.where(F.col(inverse) > 0).withColumn("__rank", rank)
    out = found.groupBy(*by).agg(
        F.count("*").alias("n"), F.max("__rank").alias("max_rank"), F.min("__rank").alias("__least"),
        F.count_distinct("__rank").alias("__ranks"),
    )
    return out.withColumn("complete", (F.col("n") == F.col("max_rank")) & (F.col("n") == F.col("__ranks")) & (F.col("__least") == 1)).drop("__least", "__ranks")


def recovered_norms(pairs: DataFrame, by: str, raw: str = "raw", cosine: str = "cos", least: float = 1e-3) -> DataFrame:
    """(by, norm, residual, n): a query's norm as the median of raw score over cosine, and how far raw scores are from it.

    Cosines nearer to 0 than ``least`` give no ratio, but count in the residual.
    """
    ratio = F.when(F.abs(cosine) >= least, F.col(raw) / F.col(cosine))
    norms = pairs.groupBy(by).agg(F.percentile(ratio, F.lit(0.5)).alias("norm"))
    rest = F.max(F.abs(F.col(raw) - F.col("norm") * F.col(cosine)))
    return pairs.join(norms, by).groupBy(by, "norm").agg(rest.alias("residual"), F.count("*").alias("n"))


def label_groups(rows: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Rows with ``grp``, counted from 1: a group begins at the first row and wherever a 1 follows a 0.

    Rows lie in the given order, which must be total.  The order is dealt into
    ranges; only a range's ends and count of beginnings (a row each) are
    brought together, so no task sees the whole table.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy("__part").orderBy(*order)
    before = F.lag(label).over(within)
    marked = ordered.withColumn("__new", F.when((before == 0) & (F.col(label) == 1), 1).otherwise(0))
    key = F.struct(*order)
    ends = marked.groupBy("__part").agg(F.min_by(label, key).alias("head"), F.max_by(label, key).alias("tail"), F.sum("__new").alias("news"))
    seam = F.when(
        F.lag("tail").over(Window.orderBy("__part")).isNull() | ((F.lag("tail").over(Window.orderBy("__part")) == 0) & (F.col("head") == 1)),
        1,
    ).otherwise(0)
    starts = ends.withColumn("__seam", seam)
    earlier = F.coalesce(F.sum(F.col("news") + F.col("__seam")).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("__part", (earlier + F.col("__seam")).alias("__base"))
    grp = F.sum("__new").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__base")
    return marked.join(F.broadcast(starts), "__part").withColumn("grp", grp.cast("long")).drop("__part", "__new", "__base")


def training_groups(rows: DataFrame, by: str = "qid", tolerance: float = 1e-6) -> DataFrame:
    """(by, n, positives, valid): whether a group has both classes, no repeated item, and weights that sum to 1 in each class."""
    weight = lambda y: F.sum(F.when(F.col("label") == y, F.col("weight")))
    near = lambda c: F.coalesce(F.abs(c - 1) <= tolerance, F.lit(False))
    out = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), F.count_distinct("item_id").alias("__items"), weight(1).alias("__p"),
        weight(0).alias("__q"),
    )
    return out.withColumn("valid", near(F.col("__p")) & near(F.col("__q")) & (F.col("__items") == F.col("n"))).select(by, "n", "positives", "valid")


def alignment(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: rows on one side only, rows on both, and those among them whose value differs."""
    a = left.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__l"))
    b = right.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__r"))
    l, r = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    return a.join(b, keys, "full_outer").agg(
        F.count_if(l & ~r).alias("left_only"), F.count_if(r & ~l).alias("right_only"), F.count_if(l & r).alias("both"),
        F.count_if(l & r & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("differing"),
    )


def pool_digest(rows: DataFrame, by: str, order: str, parts: list[Column]) -> DataFrame:
    """(by, digest): sha256 of each pool's rows in their order; a pool is bounded by its capacity."""
    line = F.concat_ws(":", *parts)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("x")))), lambda s: s["x"])
    return rows.groupBy(by).agg(F.sha2(F.array_join(lines, ",").cast("binary"), 256).alias("digest"))


def counts_fingerprint(counts: DataFrame, keys: list[str], n: str, buckets: int = 256) -> DataFrame:
    """One row: rows, their total, and a digest that doesn't depend on the table's order.

    Rows are dealt by a hash of their text; each bucket's sorted digests give
    one, and those of all buckets the last, so no task holds all rows.
    """
    row = F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in [*keys, n]))), 256)
    dealt = counts.select(row.alias("h"), F.col(n).alias("n")).withColumn("b", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets)
    each = dealt.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("d"), F.count("*").alias("c"), F.sum("n").alias("t"))
    return each.agg(
        F.sum("c").alias("n_rows"), F.sum("t").alias("total"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("b").cast("string"), "d"))), ","), 256).alias("digest"),
    )


def alpha_grid(rows: DataFrame, alphas: list[float], k: int) -> DataFrame:
    """(alpha, qid, item_id, mixed, rank): rankings by log odds of ``prob`` plus alpha times the log of ``share``, for several alphas."""
    each = rows.withColumn(
        "__mixed",
        F.array(*(F.struct(F.lit(a).alias("alpha"), F.round(S.logit_mix(F.col("prob"), F.col("share"), a), 6).alias("mixed")) for a in alphas)),
    )
    each = each.select("qid", "item_id", F.inline("__mixed"))
    rank = F.row_number().over(Window.partitionBy("alpha", "qid").orderBy(F.desc("mixed"), "item_id")).cast("long")
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("alpha", "qid", "item_id", "mixed", "rank")


def bonus_summary(ranked: DataFrame, truth: DataFrame, slices: Column, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Per bonus of a grid of rankings: recall of all queries, of both halves, of local and other positives, the share of local answers, and which is best.

    ``slices`` is a boolean of ``qid`` that tells the first half of the queries
    (for choosing) from the second (for confirming); best is the bonus of
    highest recall on the first, the smallest of equals.  A positive is local
    if it lies in its query's place; queries without a place have none, and
    count as 0 in the share of local answers.
    """
    place = queries.select("qid", F.coalesce("location", F.lit("")).alias("__here"))
    at = items.select("item_id", F.coalesce("location", F.lit("")).alias("__at"))
    known = truth.join(place, "qid").join(at, "item_id", "left").withColumn(
        "__local", (F.col("__here") != "") & F.coalesce(F.col("__at") == F.col("__here"), F.lit(False)),
    )
    placed = F.col("__here") != ""
    sizes = known.groupBy("qid").agg(F.count("*").alias("size"), F.count_if("__local").alias("locals"), F.count_if(~F.col("__local") & placed).alias("others"))
    bonuses = ranked.select("bonus").distinct()
    found = ranked.join(known, ["qid", "item_id"]).groupBy("bonus", "qid").agg(F.count("*").alias("hits"), F.count_if("__local").alias("local_hits"))
    shares = ranked.join(place, "qid").join(at, "item_id").groupBy("bonus", "qid").agg(
        F.avg(F.when(placed & (F.col("__at") == F.col("__here")), 1.0).otherwise(0.0)).alias("share")
    )
    each = sizes.crossJoin(F.broadcast(bonuses)).join(found, ["bonus", "qid"], "left").join(shares, ["bonus", "qid"], "left").na.fill(0, ["hits", "local_hits"]).na.fill(0.0, ["share"])
    each = each.withColumn("r", F.col("hits") / F.col("size")).withColumn("first", slices)
    avg = lambda c: F.round(F.avg(c), 6)
    out = each.groupBy("bonus").agg(
        avg(F.col("r")).alias("all_recall"), avg(F.when(F.col("first"), F.col("r"))).alias("first_recall"), avg(F.when(~F.col("first"), F.col("r"))).alias("second_recall"),
        avg(F.when(F.col("locals") > 0, F.col("local_hits") / F.col("locals"))).alias("local_recall"), avg(
            F.when(F.col("others") > 0, (F.col("hits") - F.col("local_hits")) / F.col("others"))
        ).alias("other_recall"), avg(F.col("share")).alias("local_share"),
    )
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("first_recall"), "bonus"))  # a row for each bonus
    return out.withColumn("best", rank == 1)
