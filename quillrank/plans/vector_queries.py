"""Exact cosine search, pool scores and the location-aware dense ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..operators import geo, vectors
from . import roles as R
from .registry import query
from .retrieval_queries import PRIOR

_PAIRS = "q AS (SELECT vec_id AS qid, embedding AS qv, vec_id % 25 AS qloc FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, vec_id AS item_id, label, qloc, vec_id % 25 AS iloc, round(list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE qid <> vec_id)"
_TOP = f"{_PAIRS}, r AS (SELECT qid, item_id, score, label, qloc, iloc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM s)"


def _queries(v: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query, against all vectors."""
    return v.where("vec_id % 50 = 0")


@query("cosine_topk", f"WITH {_TOP} SELECT qid, item_id, score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = R.table(spark, sf, "embeddings")
    return vectors.cosine_top_k(_queries(v), v, 10, skip_self=True)


POOL = 100


@query("pool_rescore", f"WITH {_TOP} SELECT qid, item_id, score FROM r WHERE rank <= {POOL}")
def pool_rescore(spark: SparkSession, sf: str) -> DataFrame:
    """Exact scores of a ranked pool of bounded size."""
    v = R.table(spark, sf, "embeddings")
    return vectors.score_pool(ranked_pool(spark, sf), _queries(v), v)


def ranked_pool(spark: SparkSession, sf: str) -> DataFrame:
    v = R.table(spark, sf, "embeddings")
    return R.once(
        spark, sf, "vector-pool",
        lambda: storage.stored(vectors.cosine_top_k(_queries(v), v, POOL, skip_self=True).select("qid", "item_id"), "vector-pool"),
    )


@query("geo_dense_topk", f"WITH {PRIOR}, {_PAIRS}, a2 AS (SELECT s.*, round(score + CASE WHEN qloc IN (SELECT search_loc FROM prior) THEN 0.05 * ln(greatest(coalesce(p, 1e-7), 1e-7)) ELSE 0 END, 6) AS adjusted FROM s LEFT JOIN prior ON prior.search_loc = qloc AND prior.item_loc = iloc), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY adjusted DESC, item_id) AS rank FROM a2) SELECT qid, item_id, score, adjusted, rank FROM r WHERE rank <= 10")
def geo_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = R.table(spark, sf, "embeddings")
    # the adjustment is one number for a query and an item's place, so the best of all are among each place's best by cosine
    scored = vectors.cosine_top_k(_queries(v), v, 10, skip_self=True, group=F.col("vec_id") % 25)
    prior = geo.destination_prior(geo.associations(R.clicks(spark, sf)), geo.centres(R.places(spark, sf)))
    placed = scored.drop("rank").withColumn("search_loc", (F.col("qid") % 25).cast("int")).withColumn("item_loc", (F.col("item_id") % 25).cast("int"))
    joined = geo.adjusted_scores(placed, prior)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("adjusted"), "item_id")).cast("long")
    return joined.withColumn("rank", rank).where("rank <= 10").select("qid", "item_id", "score", "adjusted", "rank")
