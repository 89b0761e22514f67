"""Ranking evaluation: recall in its several averages, slices, re-weighting, paired comparison, bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def hits(predicted: DataFrame, truth: DataFrame, available: DataFrame, k: int) -> DataFrame:
    """(qid, n_hit, n_available, n_full): for each query of the truth, what its first k found."""
    top = predicted.where(F.col("rank") <= k).select("qid", "item_id", F.lit(1).alias("hit"))
    inside = available.select("item_id", F.lit(1).alias("inside"))
    joined = truth.join(inside, "item_id", "left").join(top, ["qid", "item_id"], "left")
    return joined.groupBy("qid").agg(F.count("hit").alias("n_hit"), F.count("inside").alias("n_available"), F.count("*").alias("n_full"))


def recall(groups: DataFrame, by: list[str] | None = None, denominator: str = "n_available", representative: str | None = None) -> DataFrame:
    """Recall in its averages: over queries, over texts of means over their queries, over hits; empty denominators stay out.

    With ``representative``, a boolean column true for one query of each text,
    also the mean over those queries alone.
    """
    by = by or []
    ok = groups.where(F.col(denominator) > 0).withColumn("r", F.col("n_hit") / F.col(denominator))
    chosen = F.when(F.col(representative), F.col("r")) if representative else F.lit(None).cast("double")
    text = ok.groupBy(*by, "text").agg(
        F.avg("r").alias("r"), F.sum("n_hit").alias("h"), F.sum(denominator).alias("d"), F.count("*").alias("c"), F.sum("r").alias("s"),
        F.sum(chosen).alias("rep"), F.count(chosen).alias("reps"),
    )
    values = [
        F.round(F.sum("s") / F.sum("c"), 6).alias("macro"), F.round(F.avg("r"), 6).alias("text_macro"),
        F.round(F.sum("h") / F.sum("d"), 6).alias("micro"), F.sum("c").alias("n_queries"),
    ]
    if representative:
        values.append(F.round(F.sum("rep") / F.nullif(F.sum("reps"), F.lit(0)), 6).alias("representative_macro"))
    return text.groupBy(*by).agg(*values)


def slices(groups: DataFrame, flags: list[str]) -> DataFrame:
    """Mean recall for each value of each flag alone: (flag, value, n, mean_recall)."""
    each = groups.select("r", F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("value")) for f in flags))).alias("s"))
    return each.groupBy("s.flag", "s.value").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_recall"))


def stratum(queries: DataFrame, places: DataFrame) -> DataFrame:
    """Queries with the three flags of their stratum: no item in their place, filters given, at most one word."""
    known = places.select(F.col("location").alias("__at")).distinct().withColumn("__known", F.lit(True))
    joined = queries.join(known, F.col("location") == F.col("__at"), "left")
    words = F.size(X.tokens(X.normalize(F.col("text"))))
    return joined.withColumn(
        "no_exact_location", F.col("__known").isNull() | (F.coalesce("location", F.lit("")) == ""),
    ).withColumn("has_filters", F.coalesce("filters", F.lit("")) != "").withColumn("one_word", words <= 1).drop("__at", "__known")


#: The route masks of ``route_masks``, over presence in the description, dense and geographic routes.
MASKS = {
    "description": "d", "dense": "e", "geo": "g", "description_or_dense": "d or e", "description_and_dense": "d and e", "description_only": "d and not e",
    "dense_only": "e and not d", "geo_unique_additions": "g and not (d or e)", "other_routes": "not (d or e or g)", "full_pool": "true",
}


def route_masks(channels: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: candidates and hits of each of the ten route masks, and how description and dense routes overlap."""
    has = lambda c: F.bool_or(c)
    f = channels.groupBy("qid", "item_id").agg(
        has(F.col("channel") == "description").alias("d"), has(F.col("channel") == "dense").alias("e"),
        has(F.col("channel").endswith("_geo")).alias("g"),
    )
    f = f.join(truth.select("qid", "item_id", F.lit(True).alias("hit")), ["qid", "item_id"], "left").na.fill(False, ["hit"])
    counts = [F.count_if(F.expr(m)).alias(f"{n}_count") for n, m in MASKS.items()] + [F.count_if(F.expr(f"({m}) and hit")).alias(f"{n}_hits") for n, m in MASKS.items()]
    out = f.groupBy("qid").agg(*counts)
    d, e, both, union = (F.col(f"{n}_count") for n in ("description", "dense", "description_and_dense", "description_or_dense"))
    ratio = lambda x, y: F.round(x / F.nullif(y, F.lit(0)), 6)
    return out.select(
        "*", ratio(both, union).alias("jaccard"), ratio(both, d).alias("description_overlap"), ratio(both, e).alias("dense_overlap"),
        ratio(both, F.least(d, e)).alias("overlap_coefficient"),
    )


def described(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, groups, undefined, texts, group_mean, text_macro_mean) of nullable statistics of queries (text, fields)."""
    each = rows.select(
        "text", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields))).alias("s"),
    ).select("text", "s.field", "s.v")
    text = each.groupBy("field", "text").agg(F.count("v").alias("n"), F.count("*").alias("all"), F.avg("v").alias("m"), F.sum("v").alias("t"))
    return text.groupBy("field").agg(
        F.sum("n").alias("groups"), F.sum(F.col("all") - F.col("n")).alias("undefined"), F.count("m").alias("texts"),
        F.round(F.sum("t") / F.nullif(F.sum("n"), F.lit(0)), 6).alias("group_mean"), F.round(F.avg("m"), 6).alias("text_macro_mean"),
    )


def contribution(channels: DataFrame, extra: DataFrame, truth: DataFrame, known: DataFrame) -> DataFrame:
    """One row: what an extra route adds to the channels: candidates, queries, recall of both pools and the gain, queries with a new hit.

    ``known`` (item_id): items that count as available.
    """
    base = channels.select("qid", "item_id").distinct().withColumn("b", F.lit(True))
    flags = base.join(extra.select("qid", "item_id").distinct().withColumn("x", F.lit(True)), ["qid", "item_id"], "full_outer")
    new = flags.where("b IS NULL")
    added = new.agg(F.count("*").alias("extra"), F.count_distinct("qid").alias("n_queries"))
    found = truth.select("qid", "item_id").distinct().join(known.select("item_id").distinct(), "item_id", "left_semi").join(flags, ["qid", "item_id"], "left")
    each = found.groupBy("qid").agg(
        F.avg(F.when(F.col("b"), 1.0).otherwise(0.0)).alias("before"),
        F.avg(F.when(F.col("b") | F.col("x"), 1.0).otherwise(0.0)).alias("after"),
        F.count_if(F.col("b").isNull() & F.col("x")).alias("new"),
    )
    gain = each.agg(
        F.round(F.avg("before"), 6).alias("recall_before"), F.round(F.avg("after"), 6).alias("recall_after"),
        F.round(F.avg(F.col("after") - F.col("before")), 6).alias("incremental_recall"),
        F.count_if(F.col("new") > 0).alias("queries_with_new_positive"),
    )
    return added.crossJoin(gain)  # one row each


def population(queries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares of searches with filters, with a place, with a category, for delivery, and words of their texts."""
    given = lambda c: F.avg(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1.0).otherwise(0.0))
    words = F.size(X.tokens(X.normalize(F.col("text"))))
    return queries.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.round(given("filters"), 6).alias("with_filters"), F.round(given("location"), 6).alias("with_place"),
        F.round(F.avg(F.when(F.coalesce("category", F.lit("")).isin("", "0"), 0.0).otherwise(1.0)), 6).alias("with_category"),
        F.round(F.avg(F.when(F.col("delivery") == "1", 1.0).otherwise(0.0)), 6).alias("with_delivery"),
        F.round(F.avg(words.cast("double")), 6).alias("mean_words"),
    )


def counter_report(counts: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """The most frequent keys, ties by key; a report of bounded length."""
    return counts.orderBy(F.desc(n), key).limit(most)


def mix_weighted(groups: DataFrame, mix: DataFrame, strata: list[str]) -> DataFrame:
    """Recall re-weighted to another population's strata; strata without groups are not covered, and the covered share is told."""
    own = groups.groupBy(*strata).agg(F.avg("r").alias("r"), F.count("*").alias("n"))
    shares = mix.groupBy(*strata).agg(F.count("*").alias("m"))
    joined = shares.join(own, strata, "left")
    covered = F.when(F.col("r").isNotNull(), F.col("m"))
    return joined.agg(
        F.round(F.sum(F.col("m") * F.col("r")) / F.sum(covered), 6).alias("mixed_recall"),
        F.round(F.coalesce(F.sum(covered), F.lit(0)) / F.sum("m"), 6).alias("covered"), F.count("*").alias("strata"),
    )


def effective_size(weights: DataFrame, by: str, w: str = "w") -> DataFrame:
    return weights.groupBy(by).agg(F.round(F.pow(F.sum(w), 2) / F.sum(F.col(w) * F.col(w)), 6).alias("ess"), F.count("*").alias("n"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Wins, losses and ties of b against a by query (qid, r)."""
    d = a.select("qid", F.col("r").alias("ra")).join(b.select("qid", F.col("r").alias("rb")), "qid")
    return d.agg(
        F.count_if(F.col("rb") > F.col("ra")).alias("wins"), F.count_if(F.col("rb") < F.col("ra")).alias("losses"),
        F.count_if(F.col("rb") == F.col("ra")).alias("ties"), F.round(F.avg(F.col("rb") - F.col("ra")), 6).alias("mean_delta"),
    )


def stage(curve: DataFrame, tolerance: float) -> DataFrame:
    """The smallest stage within ``tolerance`` of the best value."""
    best = curve.agg(F.max("value").alias("best"))
    return curve.crossJoin(F.broadcast(best)).where(F.col("best") - F.col("value") <= tolerance).agg(F.min("stage").alias("stage"), F.max("best").alias("best"))


def _drawn(clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Clusters repeated for each replicate ``b`` with a Poisson(1) weight ``w`` from the sha256 of seed, replicate and cluster."""
    hashed = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), F.col("cluster").cast("string")), 256)
    u = F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)
    draws = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    return clusters.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", u).withColumn("w", draws)


def _poisson(n: int = 10) -> list[float]:
    out, total, p = [], 0.0, math.exp(-1)
    for k in range(n):
        total += p
        out.append(total)
        p /= k + 1
    return out


#: The distribution function of Poisson(1): how often a cluster is drawn.
POISSON = _poisson()


def _interval(means: DataFrame, level: float = 0.95, ordered: bool = False) -> DataFrame:
    """Bounds of the replicates' means: interpolated quantiles, or (``ordered``) the order statistics at the level's tails."""
    tail = (1 - level) / 2
    ok = means.where("m IS NOT NULL")
    if ordered:
        values = F.array_sort(F.collect_list("m"))  # one number a replicate
        size = F.size(values)
        pick = lambda q: F.element_at(values, F.least(F.greatest(F.floor(size * q).cast("int") + 1, F.lit(1)), size))
        return ok.agg(pick(tail).alias("low"), pick(1 - tail).alias("high"), F.count("*").alias("replicates"))
    return ok.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.count("*").alias("replicates"))


def bootstrap(clusters: DataFrame, replicates: int = 200, seed: int = 42, weighting: str = "rows", ordered: bool = False) -> DataFrame:
    """Mean difference with a 95 % interval, clusters (cluster, delta, n) drawn with Poisson(1) weights from a hash.

    ``weighting`` "rows" is a ratio of sums, in which a cluster counts by its
    rows, "clusters" a mean in which all count alike.  Each replicate is a
    weighted sum, so replicates cost a shuffle of one row each per partition,
    whatever the number of clusters.
    """
    n = F.col("n") if weighting == "rows" else F.lit(1)
    means = _drawn(clusters, replicates, seed).groupBy("b").agg((F.sum(F.col("w") * F.col("delta") * n) / F.nullif(F.sum(F.col("w") * n), F.lit(0))).alias("m"))
    point = clusters.agg((F.sum(F.col("delta") * n) / F.sum(n)).alias("point"))
    return point.crossJoin(_interval(means, ordered=ordered))  # one row each


def stratified_bootstrap(clusters: DataFrame, mix: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """As ``bootstrap`` over (cluster, stratum, delta, n), strata re-weighted to a fixed mix (stratum, m).

    A cluster that lies in several strata is drawn once for all of them.  A
    replicate in which a stratum of both tables drew nothing is left out.
    """
    shares = mix.join(clusters.select("stratum").distinct(), "stratum")
    n, strata = F.col("n"), shares.agg(F.count("*").alias("strata"))
    each = _drawn(clusters, replicates, seed).groupBy("b", "stratum").agg(
        (F.sum(F.col("w") * F.col("delta") * n) / F.nullif(F.sum(F.col("w") * n), F.lit(0))).alias("m")
    )
    mixed = each.where("m is not null").withColumnRenamed("m", "value").join(F.broadcast(shares), "stratum")  # a row for each stratum
    weighted = F.sum(F.col("value") * F.col("m")) / F.sum("m")
    means = mixed.groupBy("b").agg(F.count("*").alias("c"), weighted.alias("m")).crossJoin(strata).where("c = strata")
    own = clusters.groupBy("stratum").agg((F.sum(F.col("delta") * n) / F.sum(n)).alias("value")).join(shares, "stratum")
    return own.agg(weighted.alias("point")).crossJoin(_interval(means))


def quantiles(values: DataFrame, c: str, by: list[str], at: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles."""
    q = F.percentile(c, F.array(*(F.lit(a) for a in at)))
    return values.groupBy(*by).agg(q.alias("q")).select(*by, *(F.round(F.element_at("q", i + 1), 6).alias(f"p{int(a * 100)}") for i, a in enumerate(at)))


def row_weights(rows: DataFrame) -> DataFrame:
    """Training weights: in every query with both classes, each class sums to 1; other queries stay out."""
    w = Window.partitionBy("qid")
    pos, neg = F.sum("label").over(w), F.sum(1 - F.col("label")).over(w)
    weighted = rows.withColumn("pos", pos).withColumn("neg", neg).where("pos > 0 and neg > 0")
    return weighted.withColumn("weight", F.when(F.col("label") == 1, 1.0 / F.col("pos")).otherwise(1.0 / F.col("neg"))).drop("pos", "neg")


def rerank(rows: DataFrame, k: int) -> DataFrame:
    """Ranker order: probability, then fusion score, then place in the pool."""
    order = Window.partitionBy("qid").orderBy(F.desc("prob"), F.desc("rrf_score"), F.asc("pool_rank"))
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
