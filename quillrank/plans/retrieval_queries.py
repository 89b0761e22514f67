"""BM25 channels, fusion, pools, fills, geography channels and category channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions import text as X
from ..operators import bm25, category, features, fusion, geo
from ..operators.blocks import Search
from . import roles as R
from .registry import query

DEPTH, LIMIT, CONSTANT = 50, 10, 60


def search(spark: SparkSession, sf: str) -> Search:
    """The search of all queries in the corpus's three fields, from the stored index."""

    def make() -> Search:
        about = R.corpus(spark, sf).select("item_id", F.col("location").alias("place"), F.col("category").alias("cat"))
        return Search(R.index(spark, sf), bm25.query_terms(R.queries(spark, sf)), bm25.FIELDS, about)

    return R.once(spark, sf, "search", make)


def channels(spark: SparkSession, sf: str) -> DataFrame:
    return R.once(spark, sf, "channels", lambda: storage.stored(bm25.channels(bm25.top_k(search(spark, sf).best(DEPTH), DEPTH, ["field", "qid"])), "channels"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fused_scores(channels(spark, sf), CONSTANT)


@query("bm25_top10", f"WITH {R.BM25} SELECT qid, doc AS item_id, score, rank FROM rk WHERE field = 'description' AND rank <= 10")
def bm25_top10(spark: SparkSession, sf: str) -> DataFrame:
    top = bm25.top_k(search(spark, sf).best(10, only=("description",)), 10, ["qid"])
    return top.select("qid", F.col("doc").alias("item_id"), "score", "rank")


@query("bm25_multifield", f"WITH {R.BM25} SELECT qid, channel, item_id, rank, raw_score, weight FROM ch")
def bm25_multifield(spark: SparkSession, sf: str) -> DataFrame:
    top = bm25.channels(bm25.top_k(search(spark, sf).best(DEPTH), DEPTH, ["field", "qid"]))
    return top.select("qid", "channel", "item_id", "rank", "raw_score", "weight")


@query("rrf_fusion", f"WITH {R.FUSED} SELECT qid, item_id, score, fr AS rank FROM fr WHERE fr <= {LIMIT}")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(scores(spark, sf), LIMIT)


_QUOTA = f"""q AS (SELECT *, fr <= {LIMIT} AS sel, head <= 4 AS g FROM fr),
m AS (SELECT *, least(count(*) FILTER (WHERE NOT sel AND g) OVER (PARTITION BY qid), count(*) FILTER (WHERE sel AND NOT g) OVER (PARTITION BY qid)) AS m,
 row_number() OVER (PARTITION BY qid, NOT sel AND g ORDER BY fr) AS mi, row_number() OVER (PARTITION BY qid, sel AND NOT g ORDER BY fr DESC) AS di FROM q)
SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM m
WHERE (sel AND NOT (NOT g AND di <= m)) OR (NOT sel AND g AND mi <= m)"""


@query("rrf_quota", f"WITH {R.FUSED}, {_QUOTA}")
def rrf_quota(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(scores(spark, sf), LIMIT, quota=4)


@query("location_bonus_grid", f"""WITH {R.FUSED}, g AS (SELECT b AS bonus, f.qid, f.item_id, round(f.score + CASE WHEN q.location = c.location AND q.location <> '' THEN b ELSE 0 END, 9) AS score
 FROM fused f JOIN queries q USING (qid) JOIN corpus c USING (item_id), (VALUES (0.0::DOUBLE), (0.02::DOUBLE), (0.1::DOUBLE)) AS v(b)),
r AS (SELECT *, row_number() OVER (PARTITION BY bonus, qid ORDER BY score DESC, item_id) AS rank FROM g) SELECT bonus, qid, item_id, score, rank FROM r WHERE rank <= {LIMIT}""")
def location_bonus_grid(spark: SparkSession, sf: str) -> DataFrame:
    q = R.queries(spark, sf).select("qid", F.col("location").alias("qloc"))
    c = R.corpus(spark, sf).select("item_id", "location")
    joined = scores(spark, sf).join(q, "qid").join(c, "item_id")
    return fusion.bonus_grid(joined, [0.0, 0.02, 0.1], (F.col("location") == F.col("qloc")) & (F.col("qloc") != ""), LIMIT)


@query("candidate_pool", f"WITH {R.FUSED} SELECT qid, item_id, pool_rank FROM pool WHERE pool_rank <= 998")
def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.pool(channels(spark, sf))


@query("channel_weights", f"WITH {R.BM25}, w AS (SELECT qid, channel, weight, sum(weight) OVER (PARTITION BY qid) AS t FROM (SELECT DISTINCT qid, channel, weight FROM ch)) SELECT qid, channel, round(0.7 * weight / t, 6) AS weight FROM w")
def channel_weights(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.normalized_weights(channels(spark, sf), 0.7).select("qid", "channel", F.round("weight", 6).alias("weight")).distinct()


_FILL = """base AS (SELECT qid, item_id FROM ch WHERE channel = 'description' AND rank <= 20), route AS (SELECT * FROM ch WHERE channel <> 'description'),
novel AS (SELECT r.* FROM route r ANTI JOIN base b ON r.qid = b.qid AND r.item_id = b.item_id), nb AS (SELECT qid, count(*) AS n FROM base GROUP BY qid)"""


@query("novel_fill", f"""WITH {R.BM25}, {_FILL}, f AS (SELECT qid, item_id, min((ch_ord, rank)) AS ord FROM novel GROUP BY ALL),
r AS (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY ord, item_id) AS rank FROM f) SELECT r.qid, item_id, rank FROM r LEFT JOIN nb ON r.qid = nb.qid WHERE rank <= 40 - coalesce(n, 0)""")
def novel_fill(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    return fusion.ordered_fill(ch.where("channel = 'description' and rank <= 20"), ch.where("channel <> 'description'"), 40)


@query("supplemental_fill", f"""WITH {R.BM25}, {_FILL}, s AS (SELECT qid, item_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM novel GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM s) SELECT r.qid, item_id, score, rank FROM r LEFT JOIN nb ON r.qid = nb.qid WHERE rank <= 40 - coalesce(n, 0)""")
def supplemental_fill(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    return fusion.novel_fill(ch.where("channel = 'description' and rank <= 20"), ch.where("channel <> 'description'"), 40)


_VARIANT = "var AS (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY ord, item_id) AS pool_rank FROM (SELECT qid, item_id, min((ch_ord, rank)) AS ord FROM ch WHERE (channel = 'title' AND rank <= 30) OR (channel = 'description' AND rank <= 15) GROUP BY ALL))"


@query("variant_pools", f"WITH {R.BM25}, {_VARIANT} SELECT * FROM var WHERE pool_rank <= 998")
def variant_pools(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.replaced(channels(spark, sf), {"title": 30, "description": 15})


@query("pool_diff", f"""WITH {R.BM25}, {R.TRUTH}, {_VARIANT}, base AS (SELECT qid, item_id FROM ch WHERE channel = 'description'),
f AS (SELECT coalesce(b.qid, v.qid) AS qid, coalesce(b.item_id, v.item_id) AS item_id, b.qid IS NOT NULL AS b, v.qid IS NOT NULL AS v FROM base b FULL JOIN var v ON b.qid = v.qid AND b.item_id = v.item_id),
g AS (SELECT f.*, t.qid IS NOT NULL AS h FROM f LEFT JOIN truth t ON f.qid = t.qid AND f.item_id = t.item_id)
SELECT qid, count(*) FILTER (WHERE b AND h) AS base_hits, count(*) FILTER (WHERE v AND h) AS variant_hits, count(*) FILTER (WHERE v AND NOT b) AS additions, count(*) FILTER (WHERE b AND NOT v) AS losses, count(*) FILTER (WHERE v AND NOT b AND h) AS new_hits, count(*) FILTER (WHERE b AND NOT v AND h) AS lost_hits FROM g GROUP BY qid""")
def pool_diff(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    return fusion.difference(ch.where("channel = 'description'"), fusion.replaced(ch, {"title": 30, "description": 15}), R.truth(spark, sf))


@query("source_controlled_pool", f"""WITH {R.FUSED}, r AS (SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM fused JOIN corpus USING (item_id) WHERE category <> 'en') SELECT * FROM r WHERE rank <= {LIMIT}""")
def source_controlled_pool(spark: SparkSession, sf: str) -> DataFrame:
    banned = R.corpus(spark, sf).where("category = 'en'").select("item_id")
    return fusion.fuse(scores(spark, sf).join(banned, "item_id", "left_anti"), LIMIT)


@query("geo_topk", f"""WITH {R.BM25}, s AS (SELECT field, qid, doc, score, row_number() OVER (PARTITION BY field, qid ORDER BY score DESC, doc) AS rank FROM sc JOIN queries USING (qid) JOIN corpus c ON c.item_id = doc WHERE c.location = queries.location)
SELECT qid, field || '_geo' AS channel, doc AS item_id, score, rank FROM s WHERE rank <= 20""")
def geo_topk(spark: SparkSession, sf: str) -> DataFrame:
    items, q = R.corpus(spark, sf), R.queries(spark, sf)
    found = search(spark, sf).best(0, q.select("qid", F.col("location").alias("place")), 20)
    inside = found.join(q.select("qid", "location"), "qid").join(items.select(F.col("item_id").alias("doc"), "location"), ["doc", "location"])  # the mask comes before the cut
    return bm25.top_k(inside, 20, ["field", "qid"]).select(
        "qid", F.concat("field", F.lit("_geo")).alias("channel"), F.col("doc").alias("item_id"), "score", "rank",
    )


@query("location_assoc", f"WITH {R.CLICKS} SELECT search_loc, item_loc, count(*) AS n FROM clicks GROUP BY ALL")
def location_assoc(spark: SparkSession, sf: str) -> DataFrame:
    return geo.associations(R.clicks(spark, sf))


_LOO = f"""{R.CLICKS}, a AS (SELECT search_loc, item_loc, count(*) AS n FROM clicks GROUP BY ALL), o AS (SELECT text, search_loc, item_loc, count(*) AS own FROM clicks GROUP BY ALL),
loo AS (SELECT t.text, t.search_loc, a.item_loc, a.n - coalesce(o.own, 0) AS n FROM (SELECT DISTINCT text, search_loc FROM clicks) t JOIN a USING (search_loc) LEFT JOIN o ON o.text = t.text AND o.search_loc = t.search_loc AND o.item_loc = a.item_loc WHERE a.n - coalesce(o.own, 0) > 0)"""


@query("location_assoc_loo", f"WITH {_LOO} SELECT * FROM loo")
def location_assoc_loo(spark: SparkSession, sf: str) -> DataFrame:
    c = R.clicks(spark, sf)
    return geo.without_own(geo.associations(c), geo.associations(c, by_text=True))


@query("related_destinations", f"""WITH {_LOO}, t AS (SELECT *, sum(n) OVER (PARTITION BY text, search_loc) AS total FROM loo),
r AS (SELECT *, row_number() OVER (PARTITION BY text, search_loc ORDER BY n DESC, item_loc) AS rank FROM t WHERE total >= 20 AND item_loc <> search_loc) SELECT text, search_loc, item_loc, n, rank FROM r WHERE rank <= 3""")
def related_destinations(spark: SparkSession, sf: str) -> DataFrame:
    c = R.clicks(spark, sf)
    left = geo.without_own(geo.associations(c), geo.associations(c, by_text=True))
    return geo.related(left, by=["text", "search_loc"])


PRIOR = f"""{R.CLICKS}, {R.PLACES}, c AS (SELECT place, median(lat) AS lat, median(lon) AS lon FROM places GROUP BY place), a AS (SELECT search_loc, item_loc, count(*) AS n FROM clicks GROUP BY ALL),
tot AS (SELECT search_loc, sum(n) AS total FROM a GROUP BY 1),
mw AS (SELECT a.search_loc, sum(lat * n) / sum(CASE WHEN lat IS NOT NULL THEN n END) AS lat, sum(lon * n) / sum(CASE WHEN lon IS NOT NULL THEN n END) AS lon FROM a LEFT JOIN c ON c.place = a.item_loc GROUP BY 1), own AS (SELECT mw.search_loc AS place, coalesce(c.lat, mw.lat) AS lat, coalesce(c.lon, mw.lon) AS lon FROM mw LEFT JOIN c ON c.place = mw.search_loc),
g AS (SELECT tot.search_loc, d.place AS item_loc, total, CASE WHEN h.lat IS NULL THEN 1.0 ELSE greatest(exp(-(2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin((radians(d.lat) - radians(h.lat)) / 2), 2) + cos(radians(h.lat)) * cos(radians(d.lat)) * pow(sin((radians(d.lon) - radians(h.lon)) / 2), 2), 0.0), 1.0)))) / 40), 1e-7) END AS k FROM tot LEFT JOIN own h ON h.place = tot.search_loc, c d),
prior AS (SELECT g.search_loc, g.item_loc, (coalesce(n, 0) + 3.0 * k / sum(k) OVER (PARTITION BY g.search_loc)) / (total + 3.0) AS p FROM g LEFT JOIN a ON a.search_loc = g.search_loc AND a.item_loc = g.item_loc)"""


@query("geo_distance_prior", f"WITH {PRIOR} SELECT search_loc, item_loc, round(p, 9) AS p FROM prior")
def geo_distance_prior(spark: SparkSession, sf: str) -> DataFrame:
    p = geo.destination_prior(geo.associations(R.clicks(spark, sf)), geo.centres(R.places(spark, sf)))
    return p.select("search_loc", "item_loc", F.round("p", 9).alias("p"))


@query("geo_click_features", f"""WITH {R.CLICKS}, a AS (SELECT search_loc, item_loc, count(*) AS n FROM clicks GROUP BY ALL), s AS (SELECT s_nationkey AS item_loc, count(*) / (SELECT count(*) FROM supplier) AS share FROM supplier GROUP BY 1),
t AS (SELECT *, sum(n) OVER (PARTITION BY search_loc) AS total, 1.0 / row_number() OVER (PARTITION BY search_loc ORDER BY n DESC, item_loc) AS r FROM a)
SELECT search_loc, t.item_loc, round(CASE WHEN total >= 20 THEN n / total ELSE 0 END, 6) AS probability, round(ln(1 + CASE WHEN total >= 20 THEN n / total ELSE 0 END / share), 6) AS lift, round(CASE WHEN total >= 20 THEN r ELSE 0 END, 6) AS rank FROM t LEFT JOIN s ON s.item_loc = t.item_loc""")
def geo_click_features(spark: SparkSession, sf: str) -> DataFrame:
    items = R.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("item_loc"))
    f = geo.click_features(geo.associations(R.clicks(spark, sf)), items)
    return f.select("search_loc", "item_loc", *(F.round(c, 6).alias(c) for c in ("probability", "lift", "rank")))


_SHARES = f"""cnt AS (SELECT {R.norm('text')} AS text, cat, count(*) AS n FROM clicks WHERE cat NOT IN ('', '0') GROUP BY ALL), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY text) AS share FROM cnt),
wd AS (SELECT text, unnest(list_distinct(list_filter({R.toks('text')}, lambda x: length(x) >= 2))) AS token FROM (SELECT DISTINCT text FROM sh)),
mass AS (SELECT token, cat, sum(share) AS mass FROM wd JOIN sh USING (text) GROUP BY ALL), tot AS (SELECT token, count(*) AS total FROM wd GROUP BY token)"""


def prior_ctes(loo: int) -> str:
    own = "LEFT JOIN sh o ON o.text = k.text AND o.cat = m.cat" if loo else ""
    m = "greatest(0, m.mass - coalesce(o.share, 0))" if loo else "m.mass"
    return f"""{_SHARES}, k AS (SELECT text, token, total - {loo} AS lft, count(*) OVER (PARTITION BY text) AS kept FROM wd JOIN tot USING (token) WHERE total - {loo} >= 5),
p0 AS (SELECT k.text, m.cat, round(sum({m} / lft / kept), 6) AS p FROM k JOIN mass m USING (token) {own} GROUP BY ALL),
pr0 AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY p DESC, cat) AS r FROM p0 WHERE p > 0)"""


def _prior(loo: int) -> str:
    return f"WITH {R.CLICKS}, {prior_ctes(loo)} SELECT text, cat, p, round(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END, 6) AS rank_feature FROM pr0"


def _prior_rows(spark: SparkSession, sf: str, loo: bool) -> DataFrame:
    shares = category.text_shares(R.clicks(spark, sf))
    out = category.prior_scores(shares.select("text").distinct(), shares, loo)
    return out.withColumn("rank_feature", F.round("rank_feature", 6))


@query("microcat_prior", _prior(0))
def microcat_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _prior_rows(spark, sf, False)


@query("microcat_loo", _prior(1))
def microcat_loo(spark: SparkSession, sf: str) -> DataFrame:
    return _prior_rows(spark, sf, True)


@query("fit_weights", f"""WITH {R.CLICKS}, e AS (SELECT DISTINCT text, context, cat FROM clicks), c AS (SELECT text, count(DISTINCT context) AS contexts FROM e GROUP BY text)
SELECT text, context, cat, round(1.0 / (contexts * count(*) OVER (PARTITION BY text, context)), 9) AS weight FROM e JOIN c USING (text)""")
def fit_weights(spark: SparkSession, sf: str) -> DataFrame:
    return category.fit_weights(R.clicks(spark, sf)).withColumn("weight", F.round("weight", 9))


_SOFT = f"""{R.BM25}, lex AS (SELECT qid, item_id, round(sum(weight * raw_score / peak), 6) AS lexical FROM (SELECT *, max(raw_score) OVER (PARTITION BY qid, channel) AS peak FROM ch) GROUP BY ALL),
pc AS (SELECT qid, cat, cat_ord, prob FROM queries, (VALUES ('fr', 0, 0.5::DOUBLE), ('de', 1, 0.3::DOUBLE), ('es', 2, 0.2::DOUBLE)) AS v(cat, cat_ord, prob)),
cand AS (SELECT l.qid, l.item_id, c.category AS cat, cat_ord, round(lexical * pow(prob, 0.5), 6) AS score FROM lex l JOIN corpus c USING (item_id) JOIN pc ON pc.qid = l.qid AND pc.cat = c.category WHERE lexical > 0)"""


@query("category_guarantee_topk", f"""WITH {_SOFT}, k AS (SELECT *, row_number() OVER (PARTITION BY qid, cat ORDER BY score DESC, item_id) AS crk FROM cand),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN crk <= 3 THEN 0 ELSE 1 END, CASE WHEN crk <= 3 THEN crk END, CASE WHEN crk <= 3 THEN cat_ord END, score DESC, item_id) AS s FROM k)
SELECT qid, item_id, cat, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM s WHERE s <= 12""")
def category_guarantee_topk(spark: SparkSession, sf: str) -> DataFrame:
    lexical = category.combined_fields(channels(spark, sf)).join(R.corpus(spark, sf).select("item_id", F.col("category").alias("cat")), "item_id")
    cats = F.explode(
        F.array(
            *(F.struct(F.lit(c).alias("cat"), F.lit(i).alias("cat_ord"), F.lit(p).alias("prob")) for i, (c, p) in enumerate((("fr", 0.5), ("de", 0.3), ("es", 0.2))))
        )
    )
    predicted = R.queries(spark, sf).select("qid", cats.alias("c")).select("qid", "c.*")
    return category.guaranteed_top_k(category.soft_scores(lexical, predicted), 12, 3)


_BASE_ROWS = f"""{R.FUSED}, base AS (SELECT p.qid, p.item_id, p.pool_rank, f.score AS rrf_score, f.fr FROM pool p JOIN fr f USING (qid, item_id) WHERE pool_rank <= 998)"""


@query("rank_features_pivot", f"""WITH {_BASE_ROWS} SELECT b.qid, b.item_id, b.rrf_score, round(1.0 / (1 + b.pool_rank), 9) AS pool_rank, (b.fr <= 50)::INTEGER AS baseline_top50, count(c.rank) AS channel_count,
 {', '.join(f"round(coalesce(max(1.0 / (60 + c.rank)) FILTER (WHERE channel = '{c}'), 0), 9) AS rank_{c}, (count(*) FILTER (WHERE channel = '{c}') > 0)::INTEGER AS present_{c}, round(coalesce(max(raw_score) FILTER (WHERE channel = '{c}'), 0), 6) AS score_{c}" for c in ('title', 'params', 'description'))}
 FROM base b JOIN ch c USING (qid, item_id) GROUP BY ALL""")
def rank_features_pivot(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    return features.channel_features(ch, fusion.fused_scores(ch, CONSTANT), ["title", "params", "description"], CONSTANT)


_LABELLED = f"""{_BASE_ROWS}, {R.TRUTH}, lab AS (SELECT b.*, (t.qid IS NOT NULL)::INTEGER AS label FROM base b LEFT JOIN truth t USING (qid, item_id))"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    rows = fusion.pool(ch).join(fusion.fused_scores(ch, CONSTANT).select("qid", "item_id", F.col("score").alias("rrf_score")), ["qid", "item_id"])
    return rows.join(R.truth(spark, sf).withColumn("label", F.lit(1)), ["qid", "item_id"], "left").na.fill(0, ["label"])


@query("row_weights", f"""WITH {_LABELLED}, w AS (SELECT *, sum(label) OVER (PARTITION BY qid) AS pos, sum(1 - label) OVER (PARTITION BY qid) AS neg FROM lab)
SELECT qid, item_id, label, round(CASE WHEN label = 1 THEN 1.0 / pos ELSE 1.0 / neg END, 9) AS weight FROM w WHERE pos > 0 AND neg > 0""")
def row_weights(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluation import row_weights as weigh

    return weigh(labelled(spark, sf)).select("qid", "item_id", "label", F.round("weight", 9).alias("weight"))


@query("rerank_order", f"""WITH {_BASE_ROWS}, r AS (SELECT qid, item_id, round(rrf_score * 2, 2) AS prob, row_number() OVER (PARTITION BY qid ORDER BY round(rrf_score * 2, 2) DESC, rrf_score DESC, pool_rank) AS rank FROM base) SELECT * FROM r WHERE rank <= 50""")
def rerank_order(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluation import rerank

    rows = labelled(spark, sf).withColumn("prob", F.round(F.col("rrf_score") * 2, 2))
    return rerank(rows, 50).select("qid", "item_id", "prob", "rank")


@query("exact_category_bonus", f"""WITH {R.CLICKS}, n AS (SELECT text, cat, count(*) AS n FROM clicks GROUP BY ALL) SELECT text, cat, round(0.3 * n / (sum(n) OVER (PARTITION BY text) + 3), 6) AS bonus FROM n""")
def exact_category_bonus(spark: SparkSession, sf: str) -> DataFrame:
    n = R.clicks(spark, sf).groupBy("text", "cat").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("text"))
    return n.select("text", "cat", F.round(0.3 * F.col("n") / (total + 3), 6).alias("bonus"))
