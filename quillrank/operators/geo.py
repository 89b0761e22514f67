"""Location history: associations, related destinations, distance priors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions import scalar as S
from ..functions import text as X

#: Up to so many pairs of places are broadcast; more are joined by a shuffle.
BROADCAST_COUNTS = 1_000_000


def associations(clicks: DataFrame, by_text: bool = False) -> DataFrame:
    """Counts of (search_loc, item_loc), with ``by_text`` of (text, search_loc, item_loc); rows without a place stay out."""
    keys = (["text"] if by_text else []) + ["search_loc", "item_loc"]
    placed = clicks.where("coalesce(cast(search_loc as string), '') <> '' and coalesce(cast(item_loc as string), '') <> ''")
    return placed.groupBy(*keys).agg(F.count("*").alias("n"))


def without_own(counts: DataFrame, own: DataFrame) -> DataFrame:
    """(text, search_loc, item_loc, n): what is left of the counts for each text without its own clicks."""
    texts = own.select("text", "search_loc").distinct()
    if storage.small_enough(counts, BROADCAST_COUNTS):  # places have few pairs and many texts each: no shuffle on a few hot places
        counts = F.broadcast(counts)
    joined = texts.join(counts, "search_loc").join(own.withColumnRenamed("n", "own"), ["text", "search_loc", "item_loc"], "left")
    return joined.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0").select("text", "search_loc", "item_loc", "n")


def related(counts: DataFrame, min_history: int = 20, most: int = 3, by: list[str] | None = None) -> DataFrame:
    """The most frequent destinations of places with enough history, the place itself left out."""
    by = by or ["search_loc"]
    total = F.sum("n").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "item_loc")).cast("long")
    return counts.withColumn("total", total).where(F.col("total") >= min_history).where("item_loc <> search_loc").withColumn("rank", rank).where(F.col("rank") <= most).select(*by, "item_loc", "n", "rank")


def destinations(queries: DataFrame, items: DataFrame, counts: DataFrame, min_history: int = 20, most: int = 3, with_related: bool = False) -> DataFrame:
    """(qid, place, exact): where a query's geographic channels look.

    The query's own place if an item is there; else, or with ``with_related``
    also, the places most clicked from it that have items, ``most`` in all,
    where its history has ``min_history`` clicks.  ``counts``: search_loc,
    item_loc, n, and qid if they differ by query (own clicks left out).
    """
    known = items.where("coalesce(location, '') <> ''").select(F.col("location").alias("place")).distinct()
    own = queries.where("coalesce(location, '') <> ''").select("qid", F.col("location").alias("search_loc"))
    exact = own.join(known, own["search_loc"] == known["place"], "left_semi").select("qid", F.col("search_loc").alias("place"), F.lit(True).alias("exact"))
    by = ["qid"] if "qid" in counts.columns else ["search_loc"]
    total = F.sum("n").over(Window.partitionBy(*by))
    history = counts.withColumn("total", total).where(F.col("total") >= min_history).where("item_loc <> search_loc")
    history = history.join(known, history["item_loc"] == known["place"], "left_semi")
    history = history.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "item_loc")))
    if "qid" not in counts.columns:
        history = history.where(F.col("r") <= most).join(own, "search_loc")
    near = history.join(exact.select("qid", "exact"), "qid", "left")
    room = most - F.when(F.col("exact"), 1).otherwise(0)
    near = near.where(F.col("r") <= room) if with_related else near.where(F.col("exact").isNull() & (F.col("r") <= most))
    return exact.unionByName(near.select("qid", F.col("item_loc").alias("place"), F.lit(False).alias("exact")))


def without_own_text(queries: DataFrame, counts: DataFrame, own: DataFrame) -> DataFrame:
    """(qid, search_loc, item_loc, n): each query's history without the clicks of its own text; ``own`` is by normalised text."""
    asked = queries.where("coalesce(location, '') <> ''").select("qid", X.normalize(F.col("text")).alias("text"), F.col("location").alias("search_loc"))
    mine = own.select("text", "search_loc", "item_loc", F.col("n").alias("own"))
    if storage.small_enough(counts, BROADCAST_COUNTS):
        counts = F.broadcast(counts)
    joined = asked.join(counts, "search_loc").join(mine, ["text", "search_loc", "item_loc"], "left")
    return joined.withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0").select("qid", "search_loc", "item_loc", "n")


def centres(items: DataFrame, place: str = "place") -> DataFrame:
    """Median latitude and longitude of each place; unusable coordinates stay out."""
    ok = items.where("lat is not null and lon is not null and abs(lat) <= 90 and abs(lon) <= 180")
    return ok.groupBy(place).agg(F.percentile("lat", F.lit(0.5)).alias("lat"), F.percentile("lon", F.lit(0.5)).alias("lon"))


def search_centres(counts: DataFrame, centre: DataFrame) -> DataFrame:
    """(search_loc, lat, lon): a place's own centre, else the mean of its destinations' centres weighted by clicks, else null."""
    own = centre.select(F.col("place").alias("search_loc"), F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon"))
    there = centre.select(F.col("place").alias("item_loc"), "lat", "lon")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))
    means = counts.join(there, "item_loc", "left").groupBy("search_loc").agg(mean("lat").alias("lat"), mean("lon").alias("lon"))
    return means.join(own, "search_loc", "left").select("search_loc", F.coalesce("own_lat", "lat").alias("lat"), F.coalesce("own_lon", "lon").alias("lon"))


#: Most pairs of a searched and an item's place in the grid of ``destination_prior``.
GRID = 400_000_000


def destination_prior(
    counts: DataFrame, centre: DataFrame, mass: float = 3.0, scale: float = 40.0, floor: float = 1e-7, places: DataFrame | None = None,
) -> DataFrame:
    """(search_loc, item_loc, p): smoothed shares (n + mass * w) / (N + mass) over all places, w by distance.

    ``places`` (place) are those of the items, with or without a centre; by
    default those with one.  A place without coordinates, and the empty one,
    has the floor of w; a search place without any centre weighs all alike, but
    for the empty one.  Places without history have no prior.

    The grid has a row for each pair of places, a dimension that doesn't grow
    with items or clicks; a grid of more than ``GRID`` rows is refused.
    """
    totals = counts.groupBy("search_loc").agg(F.sum("n").alias("total"))
    here = search_centres(counts, centre).select("search_loc", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    there = centre.select(F.col("place").alias("item_loc"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    if places is not None:
        there = places.select(F.col("place").alias("item_loc")).distinct().join(there, "item_loc", "left")
    if (n := there.count()) * (m := totals.count()) > GRID:
        raise ValueError(f"{m} searched places and {n} places of items make too large a grid")
    grid = totals.join(here, "search_loc").crossJoin(F.broadcast(there))
    kernel = S.distance_kernel(S.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), scale, floor)
    weight = F.col("kernel") / F.sum("kernel").over(Window.partitionBy("search_loc"))
    flat = F.when(F.col("item_loc").cast("string") == "", floor).otherwise(1.0)
    grid = grid.withColumn("kernel", F.when(F.col("lat1").isNull(), flat).otherwise(kernel)).withColumn("w", weight)
    filled = grid.join(counts, ["search_loc", "item_loc"], "left")
    return filled.select("search_loc", "item_loc", ((F.coalesce("n", F.lit(0)) + mass * F.col("w")) / (F.col("total") + mass)).alias("p"))


def adjusted_scores(scored: DataFrame, prior: DataFrame, weight: float = 0.05, floor: float = 1e-7) -> DataFrame:
    """Rows of (search_loc, item_loc, score) with ``adjusted``: score plus weight times the log of the prior; places without history add 0."""
    known = prior.select("search_loc").distinct().withColumn("known", F.lit(True))
    joined = scored.join(prior, ["search_loc", "item_loc"], "left").join(known, "search_loc", "left")
    log = F.when(F.col("known"), weight * F.ln(F.greatest(F.coalesce("p", F.lit(floor)), F.lit(floor)))).otherwise(0.0)
    return joined.withColumn("adjusted", F.round(F.col("score") + log, 6)).drop("known", "p")


def click_features(counts: DataFrame, corpus: DataFrame, min_history: int = 20, by: str = "search_loc") -> DataFrame:
    """(by, item_loc, probability, lift, rank): shares of clicks against shares of the corpus; all 0 where the history is short.

    ``by``: what has a history, a search place or (own clicks left out) a query.
    """
    total = F.sum("n").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "item_loc"))
    size = corpus.agg(F.count("*").alias("size"))
    share = corpus.groupBy("item_loc").agg(F.count("*").alias("m")).crossJoin(F.broadcast(size)).select("item_loc", (F.col("m") / F.col("size")).alias("share"))
    joined = counts.withColumn("total", total).withColumn("rank", 1.0 / rank).join(share, "item_loc", "left")
    enough = F.col("total") >= min_history
    p = F.when(enough, F.col("n") / F.col("total")).otherwise(0.0)
    return joined.select(
        by, "item_loc", p.alias("probability"), F.coalesce(F.log1p(p / F.nullif(F.col("share"), F.lit(0.0))), F.lit(0.0)).alias("lift"),
        F.when(enough, F.col("rank")).otherwise(0.0).alias("rank"),
    )
