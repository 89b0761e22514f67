"""A shop over the tables: items, searches, clicks, vectors and category predictions — as DataFrames and as SQL.

Documents are items, benchmark texts the searches; what the tables lack
(filters, places, prices, ...) is made from ids, by expressions that both
engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, geo, vectors
from ..operators.blocks import Search
from . import roles as R

QUERY_PLACE = "CASE item_id % 5 WHEN 4 THEN concat('reg', item_id % 3) WHEN 3 THEN '' ELSE concat('src', item_id % 20) END"
FILTERS = "CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN concat('lang en source src', item_id % 20) ELSE 'lang de рейтинг пользователя 3,5 звёзд' END"
CATEGORY = "CASE item_id % 4 WHEN 0 THEN '0' WHEN 1 THEN 'en' WHEN 2 THEN 'de' ELSE '' END"
ITEM_PLACE = "CASE WHEN doc_id % 10 = 9 THEN '' ELSE source END"
MICROCAT = "CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('m', doc_id % 5) END"
RATING = "CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat(doc_id % 5, '.', doc_id % 10) END"
REVIEWS = "CASE WHEN doc_id % 13 = 0 THEN 'n/a' ELSE CAST(doc_id % 100 AS VARCHAR(9)) END"
CLICK_PLACE = "CASE doc_id % 3 WHEN 0 THEN concat('reg', (doc_id % 9) % 4) ELSE concat('src', (doc_id * 7) % 20) END"

SQL = f"""sq AS (SELECT item_id AS qid, text, {FILTERS} AS filters, {QUERY_PLACE} AS location, {CATEGORY} AS category, CAST(item_id % 2 AS VARCHAR) AS delivery FROM benchmark),
si AS (SELECT doc_id AS item_id, split_part(coalesce(text, ''), chr(10), 1) AS title, 'lang ' || lang || ' source ' || source AS params, coalesce(text, '') AS description, lang AS category, {ITEM_PLACE} AS location,
 {MICROCAT} AS microcat, CAST(n_chars AS VARCHAR) AS price, {RATING} AS rating, {REVIEWS} AS reviews, CAST(doc_id % 2 AS VARCHAR) AS phone_hidden, CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '' END AS message_forbidden FROM documents),
sc AS (SELECT b.text, {CLICK_PLACE} AS search_loc, {ITEM_PLACE} AS item_loc, {MICROCAT} AS cat, d.doc_id AS item_id FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
pred AS (SELECT qid, 'm' || k AS cat, (1 + (qid + 3 * k) % 5) / 15 AS prob, 5 - (qid + 3 * k) % 5 AS r FROM sq, range(5) AS t(k))"""

FIELDS, STEMS = R.FIELDS, R.STEMS


def queries(spark: SparkSession, sf: str) -> DataFrame:
    e = {"filters": FILTERS, "location": QUERY_PLACE, "category": CATEGORY, "delivery": "CAST(item_id % 2 AS STRING)"}
    return R.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text", *(F.expr(x).alias(n) for n, x in e.items()))


def items(spark: SparkSession, sf: str) -> DataFrame:
    e = {
        "category": "lang", "location": ITEM_PLACE, "microcat": MICROCAT, "price": "CAST(n_chars AS STRING)", "rating": RATING, "reviews": REVIEWS.replace("VARCHAR(9)", "STRING"),
        "phone_hidden": "CAST(doc_id % 2 AS STRING)", "message_forbidden": "CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '' END",
    }
    text = F.coalesce("text", F.lit(""))
    params = F.concat(F.lit("lang "), "lang", F.lit(" source "), "source")
    return R.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.substring_index(text, "\n", 1).alias("title"), params.alias("params"),
        text.alias("description"), *(F.expr(x).alias(n) for n, x in e.items())
    )


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    own = d.select(
        F.col("doc_id").alias("item_id"), (F.col("doc_id") % 40).alias("q"), F.expr(CLICK_PLACE).alias("search_loc"),
        F.expr(ITEM_PLACE).alias("item_loc"), F.expr(MICROCAT).alias("cat"),
    )
    b = R.table(spark, sf, "benchmark").select(F.col("item_id").alias("q"), "text")
    return own.join(b, "q").select("text", "search_loc", "item_loc", "cat", "item_id")


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, cat, prob, r): a whole distribution over five categories for each query, and each category's place in it."""
    k = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    turn = (F.col("qid") + 3 * F.col("k")) % 5
    return queries(spark, sf).select("qid", k).select("qid", F.concat(F.lit("m"), "k").alias("cat"), ((1 + turn) / 15).alias("prob"), (5 - turn).alias("r"))


def vector_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors (own, embedding) of queries and of the items that have one."""
    v = R.table(spark, sf, "embeddings")
    q = queries(spark, sf).select(F.col("qid").alias("own"), ((F.col("qid") * 7 + 3) % 500).alias("vec_id")).join(v, "vec_id").select("own", "embedding")
    return q, v.select(F.col("vec_id").alias("own"), "embedding").join(
        spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("own")), "own", "left_semi",
    )


def dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """(qid, item_id, rank, raw_score): the nearest items of each query."""
    q, c = vector_pairs(spark, sf)
    return vectors.cosine_top_k(q, c, k, "own", skip_self=False).withColumnRenamed("score", "raw_score")


def search(spark: SparkSession, sf: str, text: str = "text") -> Search:
    """The search over all five fields; stems of the query for the fields of stems."""

    def make() -> Search:
        plain = tuple(f.name for f in FIELDS if f.name not in STEMS)
        q = queries(spark, sf).withColumn("values", F.concat_ws(" ", "text", filter_values(F.col("filters"))))
        terms = bm25.stem_queries(bm25.query_terms(q, text=text), plain, tuple(STEMS))
        about = items(spark, sf).select("item_id", F.col("location").alias("place"), F.col("microcat").alias("cat"))
        return Search(R.index(spark, sf), terms, FIELDS, about)

    return R.once(spark, sf, f"shop-search-{text}", make)


def filter_values(filters) -> F.Column:
    return X.filter_values(filters, ["lang", "source", "рейтинг пользователя"], {"lang", "source"})


def associations(spark: SparkSession, sf: str) -> DataFrame:
    return geo.associations(clicks(spark, sf))


def associations_without_own(spark: SparkSession, sf: str) -> DataFrame:
    """History by query, its own text's clicks left out."""
    c = clicks(spark, sf).withColumn("text", X.normalize(F.col("text")))
    return geo.without_own_text(queries(spark, sf), geo.associations(c), geo.associations(c, by_text=True))


#: The clicks' CTE goes by another name here, as the scores of BM25 are called ``sc``.
SHOP = SQL.replace("\nsc AS (", "\nsk AS (")
LEXICAL = """five AS (SELECT field, qid, doc, score FROM sc UNION ALL SELECT 'title_stem', qid, doc, score FROM sc WHERE field = 'title' UNION ALL SELECT 'params_stem', qid, doc, score FROM sc WHERE field = 'params'),
fw(field, w, o) AS (VALUES ('title', 2.0::DOUBLE, 0), ('params', 1.0::DOUBLE, 1), ('description', 0.5::DOUBLE, 2), ('title_stem', 0.5::DOUBLE, 3), ('params_stem', 0.25::DOUBLE, 4)),
assoc AS (SELECT search_loc, item_loc, count(*) AS n FROM sk WHERE search_loc <> '' AND item_loc <> '' GROUP BY ALL), locs AS (SELECT DISTINCT location FROM si WHERE location <> ''),
rel AS (SELECT search_loc, item_loc, row_number() OVER (PARTITION BY search_loc ORDER BY n DESC, item_loc) AS r FROM assoc JOIN (SELECT search_loc, sum(n) AS t FROM assoc GROUP BY 1) USING (search_loc) WHERE t >= 20 AND item_loc IN (SELECT location FROM locs) AND item_loc <> search_loc),
dest AS (SELECT qid, location AS place FROM sq WHERE location IN (SELECT location FROM locs) UNION ALL SELECT qid, item_loc FROM sq JOIN rel ON search_loc = location WHERE r <= 3 AND location NOT IN (SELECT location FROM locs))"""
GEO = LEXICAL + """,
mk AS (SELECT f.*, w, o, coalesce(i.location IN (SELECT place FROM dest WHERE dest.qid = f.qid), false) AS inside, f.qid IN (SELECT qid FROM dest) AS placed FROM five f JOIN fw USING (field) JOIN si i ON i.item_id = f.doc),
mr AS (SELECT *, row_number() OVER (PARTITION BY field, qid ORDER BY score DESC, doc) AS rank, row_number() OVER (PARTITION BY field, qid, inside ORDER BY score DESC, doc) AS near FROM mk),
hl AS (SELECT qid, field AS channel, 2 * o AS ch_ord, w / (4.25 * CASE WHEN placed THEN 1.25 ELSE 1 END) AS weight, doc AS item_id, rank, score AS raw_score FROM mr WHERE rank <= 50
 UNION ALL SELECT qid, field || '_geo', 2 * o + 1, w * 0.25 / (4.25 * 1.25), doc, near, score FROM mr WHERE inside AND near <= 20)"""
DENSE = """ds AS (SELECT sq.qid, d.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS raw_score FROM sq JOIN embeddings q ON q.vec_id = (sq.qid * 7 + 3) % 500, embeddings d WHERE d.vec_id IN (SELECT doc_id FROM documents)),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw_score DESC, item_id) AS rank FROM ds)"""
HYBRID = GEO + ", " + DENSE + """,
hc AS (SELECT * FROM hl UNION ALL SELECT qid, 'dense', 10, 1.0::DOUBLE, item_id, rank, raw_score FROM dr WHERE rank <= 50)"""
