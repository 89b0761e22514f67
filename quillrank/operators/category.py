"""Category priors from clicks, and category-guaranteed top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .blocks import Search


def text_shares(clicks: DataFrame) -> DataFrame:
    """(text, cat, n, share): each text's categories; shares of a text sum to 1.  Unknown categories stay out."""
    known = clicks.where("coalesce(cat, '') not in ('', '0')")
    counts = known.groupBy(X.normalize(F.col("text")).alias("text"), "cat").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("text")))


def token_prior(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, cat, mass) and (token, total): one unit of mass for each distinct text that has the token."""
    exploded = shares.withColumn("token", F.explode(F.array_distinct(X.long_tokens(F.col("text")))))
    return exploded.groupBy("token", "cat").agg(F.sum("share").alias("mass")), exploded.groupBy("token").agg(F.count_distinct("text").alias("total"))


def prior_scores(texts: DataFrame, shares: DataFrame, leave_out: bool, least: int = 5, ranked: int = 10) -> DataFrame:
    """(text, cat, p, rank_feature): mean category share of a text's tokens; with ``leave_out`` without its own mass.

    Tokens with a total below ``least`` don't count; ties in rank go by category.
    """
    mass, totals = token_prior(shares)
    words = texts.select("text", F.explode(F.array_distinct(X.long_tokens(X.normalize(F.col("text"))))).alias("token"))
    known = shares.select("text").distinct().withColumn("known", F.lit(1))
    words = words.join(totals, "token").join(known, "text", "left").withColumn("left", F.col("total") - (F.coalesce("known", F.lit(0)) if leave_out else 0))
    words = words.where(F.col("left") >= least).withColumn("kept", F.count("*").over(Window.partitionBy("text")))
    joined = words.join(mass, "token")
    if leave_out:
        joined = joined.join(shares.select("text", "cat", F.col("share").alias("own")), ["text", "cat"], "left")
        joined = joined.withColumn("mass", F.greatest(F.lit(0.0), F.col("mass") - F.coalesce("own", F.lit(0.0))))
    p = joined.groupBy("text", "cat").agg(F.round(F.sum(F.col("mass") / F.col("left") / F.col("kept")), 6).alias("p")).where("p > 0")
    rank = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("p"), "cat"))
    return p.withColumn("r", rank).select("text", "cat", "p", F.when(F.col("r") <= ranked, 1.0 / F.col("r")).otherwise(0.0).alias("rank_feature"))


def fit_weights(clicks: DataFrame) -> DataFrame:
    """(text, context, cat, weight): each text weighs 1, split evenly over its contexts and their categories."""
    each = clicks.select("text", "context", "cat").distinct()
    contexts = each.groupBy("text").agg(F.count_distinct("context").alias("contexts"))
    cats = F.count("*").over(Window.partitionBy("text", "context"))
    return each.withColumn("cats", cats).join(contexts, "text").select("text", "context", "cat", (1.0 / (F.col("contexts") * F.col("cats"))).alias("weight"))


def guaranteed_top_k(candidates: DataFrame, limit: int, least: int) -> DataFrame:
    """The best ``limit`` of each query with at least ``least`` of every predicted category, where there are that many.

    ``candidates``: qid, item_id, cat, cat_ord, score.  Guaranteed items enter
    by rank within category, then category order; the rest by score.
    """
    within = F.row_number().over(Window.partitionBy("qid", "cat").orderBy(F.desc("score"), "item_id"))
    c = candidates.withColumn("crk", within).withColumn("g", F.col("crk") <= least)
    order = [F.when(F.col("g"), 0).otherwise(1), F.when(F.col("g"), F.col("crk")), F.when(F.col("g"), F.col("cat_ord")), F.desc("score"), F.asc("item_id")]
    chosen = c.withColumn("s", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("s") <= limit)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item_id")).cast("long")
    return chosen.withColumn("rank", rank).select("qid", "item_id", "cat", "score", "rank")


def combined_fields(channels: DataFrame) -> DataFrame:
    """(qid, item_id, lexical): weighted sum of each field's score over the field's best of the query."""
    peak = F.max("raw_score").over(Window.partitionBy("qid", "channel"))
    return channels.withColumn("part", F.col("weight") * F.col("raw_score") / peak).groupBy("qid", "item_id").agg(F.round(F.sum("part"), 6).alias("lexical"))


def combined_scores(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The same from scores of all matching items (field, qid, doc, score), so that peaks are the whole corpus's."""
    w = F.create_map(*(F.lit(x) for f, v in weights.items() for x in (f, v)))
    own = scored.where(F.col("field").isin(*weights))
    peaks = own.groupBy("field", "qid").agg(F.max("score").alias("peak")).where("peak > 0")  # a row for each field and query
    parts = own.join(peaks, ["field", "qid"]).withColumn("part", F.element_at(w, F.col("field")) * F.col("score") / F.col("peak"))
    return parts.groupBy("qid", F.col("doc").alias("item_id")).agg(F.round(F.sum("part"), 6).alias("lexical"))


def soft_scores(lexical: DataFrame, predicted: DataFrame, power: float = 0.5, bonus: Column | float = 0.0) -> DataFrame:
    """Lexical score times the category's probability to a power, and a bonus; items outside the predicted categories stay out."""
    score = F.col("lexical") * F.pow("prob", F.lit(power)) + bonus
    return lexical.join(predicted, ["qid", "cat"]).where("lexical > 0").withColumn("score", F.round(score, 6))


def top_categories(predicted: DataFrame, k: int) -> DataFrame:
    """(qid, cat, cat_ord, prob): the likeliest categories of each query, ties by category."""
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("prob"), "cat")).cast("int")
    return predicted.withColumn("cat_ord", order).where(F.col("cat_ord") <= k).select("qid", "cat", "cat_ord", "prob")


#: The fields' weights in a category channel, its categories, their least shares and the power of probabilities.
WEIGHTS = {"title": 2.0, "params": 1.0, "description": 0.5}
TOP, LEAST, POWER = 3, 5, 0.5


def channel(
    scored: DataFrame | Search, predicted: DataFrame, items: DataFrame, queries: DataFrame, limit: int, weights: dict[str, float] | None = None,
    top: int = TOP, least: int = LEAST, power: float = POWER, bonus: float = 0.0,
) -> DataFrame:
    """(qid, item_id, rank, raw_score): items of a query's likeliest categories by lexical score and probability.

    Each of the categories has its ``least`` best items in the ranking before
    the rest is filled by score; ``bonus`` goes to items in the query's place.
    ``scored`` has a row for each query and document with one of its terms, or
    is a search whose items have ``place`` and ``cat``; that gives each block's
    candidates, and grows with the postings alone.
    """
    weights, likely = weights or WEIGHTS, top_categories(predicted, top)
    if isinstance(scored, Search):
        said = likely.select("qid", "cat", F.pow("prob", F.lit(power)).alias("factor"))
        place = F.col("location").cast("string")
        found = scored.combined(weights, said, queries.where(place != "").select("qid", place.alias("place")), bonus, limit)
    else:
        found = combined_scores(scored, weights)
    lexical = found.join(
        items.select("item_id", F.col("microcat").alias("cat"), F.col("location").alias("at")), "item_id",
    ).where("coalesce(cat, '') <> ''")
    extra: Column | float = 0.0
    if bonus:
        lexical = lexical.join(queries.select("qid", F.col("location").alias("here")), "qid")
        extra = F.when((F.col("at") == F.col("here")) & (F.col("here") != ""), bonus).otherwise(0.0)
    kept = guaranteed_top_k(soft_scores(lexical, likely, power, extra), limit, least)
    return kept.select("qid", "item_id", "rank", F.col("score").alias("raw_score"))


def exact_shares(shares: DataFrame, leave_out: bool) -> DataFrame:
    """(text, cat, share): a text's own category shares; nothing where own clicks are left out."""
    return shares.select("text", "cat", "share").where(F.lit(not leave_out))


def history_bonus(rows: DataFrame, history: DataFrame, size: float) -> DataFrame:
    """``rows`` (text, cat, prob) with prob raised by size * n / (N + 3) for the clicks n of the text in the category, N in all."""
    totals = history.groupBy("text").agg(F.sum("n").alias("__total"))
    joined = rows.join(history.select("text", "cat", F.col("n").alias("__n")), ["text", "cat"], "left").join(totals, "text", "left")
    more = F.coalesce(size * F.col("__n") / (F.col("__total") + 3), F.lit(0.0))
    return joined.withColumn("prob", F.col("prob") + more).drop("__n", "__total")


def without_sentinel(c: Column) -> Column:
    """A category with "0", which stands for none, as the empty string."""
    known = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(known == "0", "").otherwise(known)
