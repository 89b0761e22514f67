"""Learned operators; SQL cannot express them, so their results are checked by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..operators import evaluation as E
from ..operators import category, category_model, features, fusion, learning, stemming
from ..functions import text as X
from . import roles as R
from .evaluation_queries import _PAIR, _two
from .registry import query
from .retrieval_queries import _LABELLED, CONSTANT, channels, labelled, search

_NAMES = ["title", "params", "description"]
_FEATURES = ["rrf_score", "pool_rank", "baseline_top50", "channel_count", *(f"{k}_{n}" for n in _NAMES for k in ("rank", "present", "score"))]


def _rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows with labels and weights for training, and all rows for scoring; both stored, as fitting reads them many times."""
    ch = channels(spark, sf)
    rows = features.channel_features(ch, fusion.fused_scores(ch, CONSTANT), _NAMES, CONSTANT)
    own = labelled(spark, sf)
    every = storage.stored(rows.join(own.select("qid", "item_id", "label", F.col("pool_rank").alias("place")), ["qid", "item_id"]), "rank-rows")
    train = E.row_weights(learning.training_sample(own, fusion.fuse(fusion.fused_scores(ch, CONSTANT), 50), ch)).select("qid", "item_id", "weight")
    return storage.stored(every.join(train, ["qid", "item_id"]), "rank-train"), every


@query("gbt_rank")
def gbt_rank(spark: SparkSession, sf: str) -> DataFrame:
    train, every = _rows(spark, sf)
    scored = learning.rank_scores(learning.fit_ranker(train, _FEATURES, 10), every).drop("pool_rank")
    return E.rerank(scored.withColumnRenamed("place", "pool_rank"), 50).select("qid", "item_id", "label", F.round("prob", 6).alias("prob"), "rank")


@query("gbt_prefix_curve")
def gbt_prefix_curve(spark: SparkSession, sf: str) -> DataFrame:
    train, every = _rows(spark, sf)
    scored = learning.prefix_scores(learning.fit_ranker(train, _FEATURES, 10), every, [2, 5, 10])
    p = lambda n: F.avg(-(F.col("label") * F.ln(F.col(f"p{n}")) + (1 - F.col("label")) * F.log1p(-F.col(f"p{n}"))))
    return scored.agg(*(F.round(p(n), 6).alias(f"loss_{n}") for n in (2, 5, 10)), F.count("*").alias("n"))


_SAMPLE = f"""{_LABELLED}, hd AS (SELECT qid, item_id, min((rank, ch_ord)) AS turn FROM ch WHERE rank <= 20 GROUP BY ALL),
b AS (SELECT l.qid, l.item_id, label, CASE WHEN fr <= 50 THEN fr END AS base, turn, max(label) OVER (PARTITION BY l.qid) AS some1 FROM lab l LEFT JOIN hd ON hd.qid = l.qid AND hd.item_id = l.item_id),
c AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY base NULLS LAST, item_id) AS first FROM b), d AS (SELECT *, CASE WHEN base IS NOT NULL AND first <= 6 THEN 1 WHEN turn IS NOT NULL THEN 2 WHEN base IS NOT NULL THEN 3 ELSE 4 END AS kind FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY kind, CASE WHEN kind = 2 THEN turn END, base NULLS FIRST, item_id) AS place FROM d), f AS (SELECT *, label = 0 AND kind < 4 AND place <= 12 AS hard FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY hard DESC, sha256(to_json(['42', qid::VARCHAR, item_id::VARCHAR])), item_id) AS turn2 FROM f)"""


@query("training_sample", f"WITH {_SAMPLE} SELECT qid, item_id, label, hard FROM g WHERE some1 = 1 AND (label = 1 OR turn2 <= 24)")
def training_sample(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    baseline = fusion.fuse(fusion.fused_scores(ch, CONSTANT), 50)
    return learning.training_sample(labelled(spark, sf), baseline, ch, 24).select("qid", "item_id", "label", "hard")


@query("pairwise_rank")
def pairwise_rank(spark: SparkSession, sf: str) -> DataFrame:
    train, every = _rows(spark, sf)
    scored = learning.rank_scores(learning.fit_pairwise(train, _FEATURES), every).drop("pool_rank")
    return E.rerank(scored.withColumnRenamed("place", "pool_rank"), 50).select("qid", "item_id", "label", F.round("prob", 6).alias("prob"), "rank")


def category_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Titles as texts, languages as categories, each text weighing 1."""
    rows = R.corpus(spark, sf).select(F.col("title").alias("text"), F.col("category").alias("cat"), F.col("location").alias("context"))
    return category.fit_weights(rows.withColumn("text", X.normalize(F.col("text"))))


@query("oof_category_model")
def oof_category_model(spark: SparkSession, sf: str) -> DataFrame:
    """Each text's categories from the model of the fold that left it out, the likeliest first."""
    model = category_model.fit(category_examples(spark, sf), category_model.Settings(words=4000, characters=8000, iterations=10))
    scored = storage.stored(model.predict(R.corpus(spark, sf).select(F.col("title").alias("text"))), "category-scores")
    model.assert_unseen(scored)
    top = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("prob"), "cat"))
    return scored.withColumn("place", top).where("place <= 3").select("text", "cat", "by", F.round("prob", 6).alias("prob"), "place")


@query("category_channel_fitted")
def category_channel_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """The category channel of the corpus with probabilities of a fitted model."""
    q = R.queries(spark, sf)
    model = category_model.fit(category_examples(spark, sf), category_model.Settings(folds=0, words=4000, characters=8000, iterations=10))
    said = model.predict(q).join(q.select("qid", X.normalize(F.col("text")).alias("text")), "text").select("qid", "cat", "prob")
    items = R.corpus(spark, sf).select("item_id", F.col("category").alias("microcat"), "location")
    return category.channel(search(spark, sf), said, items, q, 50).select("qid", "item_id", "rank", "raw_score")


_POISSON = " + ".join(f"(u >= {c!r})::INTEGER" for c in E.POISSON)


def _drawn(clusters: str, more: str = "") -> str:
    return f"""dw AS (SELECT {clusters}.*, b, ('0x' || substr(sha256('42|' || b || '|' || cluster), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 AS u FROM {clusters}, range(1, 201) AS t(b)), dr0 AS (SELECT *, {_POISSON} AS w FROM dw)"""


_DELTA = f"{_PAIR}, cl AS (SELECT {R.norm('text')} AS cluster, avg(rb - ra) AS delta, count(*) AS n FROM x JOIN queries USING (qid) GROUP BY 1)"
_MEANS = "m AS (SELECT b, sum(w * delta * n) / nullif(sum(w * n), 0) AS m FROM dr0 GROUP BY b)"


@query("cluster_bootstrap_ci", f"WITH {_DELTA}, {_drawn('cl')}, {_MEANS} SELECT (SELECT round(sum(delta * n) / sum(n), 6) FROM cl) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM m WHERE m IS NOT NULL")
def cluster_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return E.bootstrap(_clusters(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("point", "low", "high")), "replicates")


@query("ordered_bootstrap_ci", f"WITH {_DELTA}, {_drawn('cl')}, m AS (SELECT b, sum(w * delta) / nullif(sum(w), 0) AS m FROM dr0 GROUP BY b), s AS (SELECT list_sort(list(m)) AS v FROM m WHERE m IS NOT NULL) SELECT (SELECT round(avg(delta), 6) FROM cl) AS point, round(v[least(floor(len(v) * 0.025)::INTEGER + 1, len(v))], 6) AS low, round(v[least(floor(len(v) * 0.975)::INTEGER + 1, len(v))], 6) AS high, len(v) AS replicates FROM s")
def ordered_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    out = E.bootstrap(_clusters(spark, sf), weighting="clusters", ordered=True)
    return out.select(*(F.round(c, 6).alias(c) for c in ("point", "low", "high")), "replicates")


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of two channels' recall by whole normalised text."""
    a, b = _two(spark, sf)
    own = R.queries(spark, sf).select("qid", X.normalize(F.col("text")).alias("cluster"))
    d = a.withColumnRenamed("r", "ra").join(b.withColumnRenamed("r", "rb"), "qid").join(own, "qid")
    return d.groupBy("cluster").agg(F.avg(F.col("rb") - F.col("ra")).alias("delta"), F.count("*").alias("n"))


#: Words with their published stems, beside the documents' words, which have no Russian among them and stay.
_STEMS = {"важная": "важн", "важный": "важн", "бегала": "бега", "красивейший": "красив", "столами": "стол", "дом": "дом"}


@query("stemmed_vocabulary", f"SELECT DISTINCT unnest({R.toks(R.norm('text'))}) AS term, term AS stem FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({w!r}, {s!r})' for w, s in _STEMS.items())})")
def stemmed_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    terms = R.table(spark, sf, "documents").select(F.explode(F.array_distinct(X.tokens(X.normalize(F.col("text"))))).alias("term"))
    more = spark.createDataFrame([(w,) for w in _STEMS], "term string")
    return stemming.stemmed_terms(terms.unionByName(more))
