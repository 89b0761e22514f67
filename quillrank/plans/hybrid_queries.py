"""Hybrid retrieval over the shop: lexical, stem, geographic, category, supplemental and dense channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X
from ..operators import category, evaluation, fusion, geo, hybrid, protocol, variants
from . import roles as R
from . import shop
from .registry import query

PLAN = hybrid.Plan(fields=tuple((f.name, f.weight) for f in shop.FIELDS), depth=50, geo_depth=20, bonus=0.02)
COLUMNS = ("qid", "channel", "ch_ord", "weight", "item_id", "rank", "raw_score")


def destinations(spark: SparkSession, sf: str, with_related: bool = False) -> DataFrame:
    return geo.destinations(shop.queries(spark, sf), shop.items(spark, sf), shop.associations(spark, sf), with_related=with_related)


def lexical_channels(spark: SparkSession, sf: str) -> DataFrame:
    places = storage.stored(destinations(spark, sf), "destinations")
    found = shop.search(spark, sf).best(PLAN.depth, places, PLAN.geo_depth)
    return hybrid.lexical_channels(found, places, shop.items(spark, sf), PLAN)


def make_channels(spark: SparkSession, sf: str) -> DataFrame:
    dense = shop.dense(spark, sf, PLAN.depth).select(
        "qid", F.lit("dense").alias("channel"), F.lit(10).alias("ch_ord"), F.lit(PLAN.dense).alias("weight"), "item_id", "rank",
        "raw_score",
    )
    return lexical_channels(spark, sf).select(*COLUMNS).unionByName(dense)


def channels(spark: SparkSession, sf: str) -> DataFrame:
    return R.once(spark, sf, "hybrid-channels", lambda: storage.stored(make_channels(spark, sf), "hybrid-channels"))


def micro_route(spark: SparkSession, sf: str) -> DataFrame:
    return category.channel(shop.search(spark, sf, "values"), shop.predicted(spark, sf), shop.items(spark, sf), shop.queries(spark, sf), 60, bonus=0.1)


_HEAD = f"WITH {R.BM25}, {shop.SHOP}, {shop.HYBRID}"


@query("hybrid_channels", f"{_HEAD} SELECT qid, channel, ch_ord, round(weight, 9) AS weight, item_id, rank, raw_score FROM hc")
def hybrid_channels(spark: SparkSession, sf: str) -> DataFrame:
    return make_channels(spark, sf).withColumn("weight", F.round("weight", 9))


FUSE = """hf AS (SELECT qid, item_id, round(sum(weight / (60 + rank)), 9) AS base, min(rank) AS head FROM hc GROUP BY ALL),
hs AS (SELECT hf.qid, hf.item_id, head, round(base + CASE WHEN sq.location = si.location AND sq.location <> '' THEN 0.02 ELSE 0 END, 9) AS score FROM hf JOIN sq USING (qid) JOIN si USING (item_id)),
ho AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM hs)"""


@query("hybrid_topk", f"{_HEAD}, {FUSE} SELECT qid, item_id, score, rank FROM ho WHERE rank <= 50")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: fused lexical, stem, geographic and dense channels, with the bonus of the query's own place."""
    scores = hybrid.fused(make_channels(spark, sf), shop.queries(spark, sf), shop.items(spark, sf), PLAN)
    return fusion.fuse(scores, 50)


@query("geo_channels_fused", f"""WITH {R.BM25}, {shop.SHOP}, {shop.GEO}, f AS (SELECT qid, item_id, round(sum(weight / (30 + rank)), 9) AS score, min(rank) AS head FROM hl GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS fr FROM f),
q AS (SELECT *, fr <= 30 AS sel, head <= 4 AS g FROM r), m AS (SELECT *, least(count(*) FILTER (WHERE NOT sel AND g) OVER (PARTITION BY qid), count(*) FILTER (WHERE sel AND NOT g) OVER (PARTITION BY qid)) AS m,
 row_number() OVER (PARTITION BY qid, NOT sel AND g ORDER BY fr) AS mi, row_number() OVER (PARTITION BY qid, sel AND NOT g ORDER BY fr DESC) AS di FROM q)
SELECT qid, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM m WHERE (sel AND NOT (NOT g AND di <= m)) OR (NOT sel AND g AND mi <= m)""")
def geo_channels_fused(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(fusion.fused_scores(lexical_channels(spark, sf), 30), 30, quota=4)


@query("search_destinations", f"WITH {R.BM25}, {shop.SHOP}, {shop.LEXICAL} SELECT qid, place, place = location AS exact FROM dest JOIN sq USING (qid) UNION ALL SELECT qid + 1000000, location, true FROM sq WHERE location IN (SELECT location FROM locs) UNION ALL SELECT qid + 1000000, item_loc, false FROM sq JOIN rel ON search_loc = location WHERE r <= CASE WHEN location IN (SELECT location FROM locs) THEN 2 ELSE 3 END")
def search_destinations(spark: SparkSession, sf: str) -> DataFrame:
    """Destinations, and (ids raised by a million) those with related places beside the exact one."""
    more = destinations(spark, sf, with_related=True).withColumn("qid", F.col("qid") + 1_000_000)
    return destinations(spark, sf).unionByName(more)


_RELATED = f"""dest2 AS (SELECT qid, item_loc AS place FROM sq JOIN rel ON search_loc = location WHERE r <= 2 AND location IN (SELECT location FROM locs)),
held AS (SELECT DISTINCT qid, item_id FROM hc), hn AS (SELECT qid, count(*) AS n FROM held GROUP BY qid),
ra AS (SELECT f.qid, field, 40 + o AS ch_ord, doc AS item_id, score, row_number() OVER (PARTITION BY f.qid, field ORDER BY score DESC, doc) AS rank FROM five f JOIN fw USING (field) JOIN si i ON i.item_id = doc JOIN dest2 ON dest2.qid = f.qid AND dest2.place = i.location),
rb AS (SELECT ra.*, n, row_number() OVER (PARTITION BY qid, item_id ORDER BY ch_ord, rank) AS turn FROM ra LEFT JOIN hn USING (qid) ANTI JOIN held USING (qid, item_id) WHERE rank <= least(20, 330 - coalesce(n, 0))),
rc AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ch_ord, rank, item_id) AS fill FROM rb WHERE turn = 1)
SELECT qid, field || '_geo_related' AS channel, ch_ord, item_id, row_number() OVER (PARTITION BY qid, ch_ord ORDER BY rank, item_id) AS rank, score AS raw_score FROM rc WHERE fill <= 330 - coalesce(n, 0)"""


@query("related_geo_channels", f"{_HEAD}, {_RELATED}")
def related_geo_channels(spark: SparkSession, sf: str) -> DataFrame:
    related = destinations(spark, sf, with_related=True).where("not exact").join(
        destinations(spark, sf).where("exact").select("qid"), "qid", "left_semi",
    ).select("qid", "place")
    found = shop.search(spark, sf).best(0, related, PLAN.geo_depth)
    out = hybrid.related_channels(found, related, shop.items(spark, sf), channels(spark, sf), PLAN, capacity=330)
    return out.drop("weight")


#: Lexical scores of the search text with the values of its filters.
_VALUES = R.BM25.replace(
    "FROM queries)",
    "FROM (SELECT qid, text || CASE qid % 3 WHEN 0 THEN '' WHEN 1 THEN ' en ; src' || (qid % 20) ELSE ' de' END AS text FROM queries))", 1,
)
MICRO = """pk AS (SELECT field, qid, max(score) AS peak FROM sc GROUP BY ALL), lx AS (SELECT s.qid, doc AS item_id, round(sum(CASE field WHEN 'title' THEN 2.0 WHEN 'params' THEN 1.0 ELSE 0.5 END::DOUBLE * score / peak), 6) AS lexical FROM sc s JOIN pk USING (field, qid) GROUP BY ALL),
cd AS (SELECT l.qid, l.item_id, i.microcat AS cat, r, round(lexical * pow(prob, 0.5) + CASE WHEN i.location = sq.location AND sq.location <> '' THEN 0.1 ELSE 0 END, 6) AS score FROM lx l JOIN si i USING (item_id) JOIN sq USING (qid) JOIN pred p ON p.qid = l.qid AND p.cat = i.microcat AND r <= 3 WHERE lexical > 0 AND i.microcat <> ''),
ck AS (SELECT *, row_number() OVER (PARTITION BY qid, cat ORDER BY score DESC, item_id) AS crk FROM cd),
cs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN crk <= 5 THEN 0 ELSE 1 END, CASE WHEN crk <= 5 THEN crk END, CASE WHEN crk <= 5 THEN r END, score DESC, item_id) AS s FROM ck),
mc AS (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank, score AS raw_score FROM cs WHERE s <= 60)"""


@query("category_channel", f"WITH {_VALUES}, {shop.SHOP}, {MICRO} SELECT * FROM mc")
def category_channel(spark: SparkSession, sf: str) -> DataFrame:
    return micro_route(spark, sf)


@query("novel_category_channel", f"WITH {_VALUES}, {shop.SHOP}, {MICRO}, {shop.DENSE}, b AS (SELECT qid, item_id FROM dr WHERE rank <= 50), n AS (SELECT mc.*, row_number() OVER (PARTITION BY qid ORDER BY rank, item_id) AS place FROM mc ANTI JOIN b USING (qid, item_id) WHERE rank <= 75) SELECT qid, item_id, place AS rank, raw_score FROM n WHERE place <= 25")
def novel_category_channel(spark: SparkSession, sf: str) -> DataFrame:
    """What the category route adds to the dense channel when 75 places are all and 40 may be its own."""
    out = hybrid.novel_channel(micro_route(spark, sf), shop.dense(spark, sf, 50), "micro_combined", 11, 40, capacity=75)
    return out.select("qid", "item_id", "rank", "raw_score")


@query("supplemental_four_routes", f"""WITH {_VALUES}, {shop.SHOP}, {MICRO}, {shop.DENSE}, b AS (SELECT qid, item_id FROM dr WHERE rank <= 50),
rt AS (SELECT qid, 'supplemental_' || field || '_values' AS channel, doc AS item_id, rank, score AS raw_score FROM rk WHERE field IN ('title', 'params') AND rank <= 300 UNION ALL SELECT qid, 'micro_combined', item_id, rank, raw_score FROM mc UNION ALL SELECT qid, 'supplemental_dense_current', item_id, rank, raw_score FROM dr WHERE rank <= 300),
s AS (SELECT qid, item_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM rt ANTI JOIN b USING (qid, item_id) GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS rank FROM s), g AS (SELECT * FROM f WHERE rank <= 200 - 50)
SELECT qid, 'supplemental_fill' AS channel, item_id, rank, score AS raw_score FROM g UNION ALL SELECT rt.qid, channel, rt.item_id, row_number() OVER (PARTITION BY rt.qid, channel ORDER BY rt.rank, rt.item_id), rt.raw_score FROM rt SEMI JOIN g ON g.qid = rt.qid AND g.item_id = rt.item_id""")
def supplemental_four_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and parameters by text and filter values, the category route and a deep dense ranking fill what the dense channel leaves of 200 places."""
    top = shop.search(spark, sf, "values").best(300, only=("title", "params"))
    from ..operators.bm25 import top_k

    lexical = top_k(top, 300, ["field", "qid"]).select(
        "qid", F.concat(F.lit("supplemental_"), "field", F.lit("_values")).alias("channel"), F.col("doc").alias("item_id"), "rank",
        F.col("score").alias("raw_score"),
    )
    dense = shop.dense(spark, sf, 300).select("qid", F.lit("supplemental_dense_current").alias("channel"), "item_id", "rank", "raw_score")
    micro = micro_route(spark, sf).select("qid", F.lit("micro_combined").alias("channel"), "item_id", "rank", "raw_score")
    routes = storage.stored(lexical.unionByName(micro).unionByName(dense), "routes")
    out = hybrid.supplemental_channels(routes, dense.where("rank <= 50"), capacity=200)
    return out.select("qid", "channel", "item_id", "rank", "raw_score")


@query("swapped_channel", f"{_HEAD}, x AS (SELECT * FROM hc WHERE channel <> 'dense' UNION ALL SELECT qid, 'dense', 10, 1.0, item_id, rank, raw_score FROM hl WHERE channel = 'title' AND rank <= 5) SELECT qid, item_id, round(sum(weight / (60 + rank)), 9) AS score FROM x GROUP BY ALL")
def swapped_channel(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    other = ch.where("channel = 'title' AND rank <= 5").select("qid", "item_id", "rank", "raw_score")
    return fusion.fused_scores(hybrid.swapped(ch, "dense", other), 60).select("qid", "item_id", "score")


_VARIANT_LIST = """[{"name": "values", "mode": "fill", "channels": {"supplemental_title_values": 1.0, "micro_combined": 0.5}, "addition_quota": 30, "matched_addition_family": "f"},
 {"name": "micro", "mode": "fill", "channels": {"micro_combined": 1.0}, "matched_addition_family": "f"}, {"name": "deep", "mode": "fill", "channels": {"supplemental_dense_current": 1.0}},
 {"name": "heads", "mode": "replace", "channels": {"dense": {"source": "base", "quota": 20}, "micro_combined": {"source": "new", "quota": 15}}}]"""


def new_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes beside the base: titles by values, categories, and a deep dense ranking."""
    from ..operators.bm25 import top_k

    top = top_k(shop.search(spark, sf, "values").best(80, only=("title",)), 80, ["qid"]).select(
        "qid", F.lit("supplemental_title_values").alias("channel"), F.col("doc").alias("item_id"), "rank",
    )
    micro = micro_route(spark, sf).select("qid", F.lit("micro_combined").alias("channel"), "item_id", "rank")
    deep = shop.dense(spark, sf, 120).select("qid", F.lit("supplemental_dense_current").alias("channel"), "item_id", "rank")
    return R.once(spark, sf, "new-routes", lambda: storage.stored(top.unionByName(micro).unionByName(deep), "new-routes"))


_NEW = f"""WITH {_VALUES}, {shop.SHOP}, {MICRO}, {shop.DENSE}, b AS (SELECT qid, item_id, rank AS pool_rank FROM dr WHERE rank <= 50),
rt AS (SELECT qid, 'supplemental_title_values' AS channel, doc AS item_id, rank FROM rk WHERE field = 'title' AND rank <= 80 UNION ALL SELECT qid, 'micro_combined', item_id, rank FROM mc UNION ALL SELECT qid, 'supplemental_dense_current', item_id, rank FROM dr WHERE rank <= 120),
vw(variant, channel, w) AS (VALUES ('values', 'supplemental_title_values', 1.0::DOUBLE), ('values', 'micro_combined', 0.5::DOUBLE), ('micro', 'micro_combined', 1.0::DOUBLE), ('deep', 'supplemental_dense_current', 1.0::DOUBLE)),
vs AS (SELECT variant, rt.qid, rt.item_id, round(sum(w / (60 + rank)), 9) AS score FROM rt ANTI JOIN b USING (qid, item_id) JOIN vw USING (channel) GROUP BY ALL), vr AS (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, item_id) AS place FROM vs),
nn AS (SELECT q.qid, v.variant, least(100 - coalesce((SELECT count(*) FROM b WHERE b.qid = q.qid), 0), coalesce((SELECT count(*) FROM vr WHERE vr.qid = q.qid AND vr.variant = v.variant), 0), CASE v.variant WHEN 'values' THEN 30 ELSE 998 END) AS want FROM (SELECT DISTINCT qid FROM rt) q, (SELECT DISTINCT variant FROM vw) v),
nm AS (SELECT qid, variant, CASE WHEN variant IN ('values', 'micro') THEN min(want) FILTER (WHERE variant IN ('values', 'micro')) OVER (PARTITION BY qid) ELSE want END AS want FROM nn),
hd AS (SELECT qid, item_id, min((o, rank)) AS spot FROM (SELECT qid, item_id, 0 AS o, rank FROM dr WHERE rank <= 20 UNION ALL SELECT qid, item_id, 1, rank FROM mc WHERE rank <= 15) GROUP BY ALL)"""


@query("declared_variants", f"""{_NEW} SELECT variant, qid, item_id, pool_rank FROM b, (SELECT DISTINCT variant FROM vw) UNION ALL SELECT variant, qid, item_id, 50 + place FROM vr JOIN nm USING (variant, qid) WHERE place <= want
UNION ALL SELECT 'heads', qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY spot, item_id) FROM hd""")
def declared_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of declared variants: fills of one family equally large, others by quota, and a pool of heads."""
    base = shop.dense(spark, sf, 50).select("qid", F.lit("dense").alias("channel"), F.lit(0).alias("ch_ord"), "item_id", "rank")
    return variants.pools(base, new_routes(spark, sf), variants.declared(_VARIANT_LIST), capacity=100)


@query("hypothesis_channels", f"""SELECT * FROM (WITH {R.BM25} SELECT qid, 'text_' || field AS channel, doc AS item_id, rank, score AS raw_score FROM rk WHERE rank <= 20 AND field IN ('title', 'params')) UNION ALL SELECT * FROM (WITH {_VALUES} SELECT qid, 'values_' || field, doc, rank, score FROM rk WHERE rank <= 20 AND field IN ('title', 'params'))""")
def hypothesis_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Channels of several layouts of a query over several fields, for trying them out."""
    from ..operators.bm25 import top_k

    out = None
    for layout in ("text", "values"):
        top = top_k(shop.search(spark, sf, layout).best(20, only=("title", "params")), 20, ["field", "qid"])
        one = top.select(
            "qid", F.concat(F.lit(f"{layout}_"), "field").alias("channel"), F.col("doc").alias("item_id"), "rank",
            F.col("score").alias("raw_score"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("popular_fill", f"WITH {R.BM25}, {shop.SHOP}, a AS (SELECT qid, doc AS item_id, rank FROM rk WHERE field = 'title' AND rank <= (qid % 4) * 3), h AS (SELECT queries.qid, count(a.qid) AS had FROM queries LEFT JOIN a USING (qid) GROUP BY 1), t AS (SELECT item_id, count(*) AS n FROM sk WHERE item_id % 3 = 0 OR item_id % 7 = 0 GROUP BY 1), o AS (SELECT h.*, t.* FROM h, t WHERE had < 10), p AS (SELECT o.*, row_number() OVER (PARTITION BY o.qid ORDER BY n DESC, o.item_id) AS k FROM o ANTI JOIN a USING (qid, item_id)) SELECT qid, item_id, rank FROM a UNION ALL SELECT qid, item_id, had + k FROM p WHERE had + k <= 10")
def popular_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Short rankings filled with the most clicked items."""
    from ..operators.bm25 import top_k

    top = top_k(
        shop.search(spark, sf).best(9, only=("title",)), 9, ["qid"],
    ).where("rank <= (qid % 4) * 3").select("qid", F.col("doc").alias("item_id"), "rank")
    clicks = shop.clicks(spark, sf).where("item_id % 3 = 0 OR item_id % 7 = 0")
    return protocol.popular_fill(top, shop.queries(spark, sf), clicks, shop.items(spark, sf), 10)


@query("audit_cache_rows", f"""WITH {R.BM25}, {R.TRUTH}, {shop.SHOP}, {shop.DENSE}, x AS (SELECT text, sha256(to_json(['cold', text])) AS h FROM (SELECT DISTINCT {R.norm('text')} AS text FROM sq)), pt AS (SELECT text, CASE WHEN row_number() OVER (ORDER BY h, text) <= 10 THEN 'audit' WHEN row_number() OVER (ORDER BY h, text) <= 15 THEN 'tune' ELSE 'fit' END AS partition FROM x)
SELECT dr.qid, dr.item_id, dr.rank AS pool_rank, (t.qid IS NOT NULL)::INTEGER AS label, partition, location NOT IN (SELECT location FROM si) OR location = '' AS no_exact_location, filters <> '' AS has_filters, len({R.toks(R.norm('sq.text'))}) <= 1 AS one_word FROM dr JOIN sq USING (qid) JOIN pt ON pt.text = {R.norm('sq.text')} LEFT JOIN truth t ON t.qid = dr.qid AND t.item_id = dr.item_id WHERE dr.rank <= 50""")
def audit_cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Pool rows with labels, flags and partitions, as the audit cache holds them."""
    q = shop.queries(spark, sf)
    texts = q.select(X.normalize(F.col("text")).alias("text")).distinct()
    parts = protocol.partitions(texts, "text", "cold", {"audit": 10, "tune": 5}, "fit")
    strata = evaluation.stratum(q, shop.items(spark, sf)).select("qid", "text", "no_exact_location", "has_filters", "one_word")
    pool = shop.dense(spark, sf, 50).select("qid", "item_id", F.col("rank").alias("pool_rank"))
    return protocol.audit_rows(pool, R.truth(spark, sf), strata, parts).drop("text")


@query("allowed_texts", f"WITH {shop.SQL} SELECT qid FROM sq WHERE {R.norm('text')} IN (SELECT {R.norm('text')} FROM sq WHERE qid % 3 = 1)")
def allowed_texts(spark: SparkSession, sf: str) -> DataFrame:
    q = shop.queries(spark, sf)
    return protocol.allowed(q, q.where("qid % 3 = 1").select(F.concat(F.lit("  "), "text").alias("text"))).select("qid")


@query("pair_split", f"""WITH {shop.SQL}, k AS (SELECT qid, qid * 7 AS item_id, to_json([{R.norm('text')}, location, delivery, {R.norm('filters')}, category]) AS k FROM sq) SELECT qid, ('0x' || substr(sha256('[42,[' || k || ',' || to_json(item_id::VARCHAR) || ']]'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.3 AS valid FROM k""")
def pair_split(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a whole query key and an item, split by hash."""
    fit, valid = protocol.split(shop.queries(spark, sf).withColumn("item_id", F.col("qid") * 7), "pairs", 0.3)
    return fit.select("qid", F.lit(False).alias("valid")).unionByName(valid.select("qid", F.lit(True).alias("valid")))


_CENTRES = "ce AS (SELECT location AS place, ((substr(location, 4)::INTEGER * 7) % 180 - 90)::DOUBLE AS lat, ((substr(location, 4)::INTEGER * 13) % 360 - 180)::DOUBLE AS lon FROM locs WHERE substr(location, 4)::INTEGER < 12)"
_PRIOR = f"""{R.BM25}, {shop.SHOP}, {shop.LEXICAL}, {_CENTRES}, ah AS (SELECT search_loc, item_loc, count(*) AS n FROM sk WHERE search_loc <> '' AND item_loc <> '' AND (search_loc <> 'reg3' OR substr(item_loc, 4)::INTEGER >= 12) GROUP BY ALL), ht AS (SELECT search_loc, sum(n) AS total FROM ah GROUP BY 1),
hm AS (SELECT a.search_loc, sum(lat * n) / sum(CASE WHEN lat IS NOT NULL THEN n END) AS lat, sum(lon * n) / sum(CASE WHEN lon IS NOT NULL THEN n END) AS lon FROM ah a LEFT JOIN ce ON ce.place = a.item_loc GROUP BY 1),
hc0 AS (SELECT hm.search_loc, coalesce(ce.lat, hm.lat) AS lat1, coalesce(ce.lon, hm.lon) AS lon1 FROM hm LEFT JOIN ce ON ce.place = hm.search_loc),
gr AS (SELECT h.search_loc, total, p.location AS item_loc, CASE WHEN lat1 IS NULL THEN CASE WHEN p.location = '' THEN 1e-7 ELSE 1.0 END ELSE coalesce(greatest(exp(-(2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin((radians(lat) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(lon1)) / 2), 2), 0.0), 1.0)))) / 40), 1e-7), 1e-7) END AS k FROM hc0 h JOIN ht USING (search_loc), (SELECT DISTINCT location FROM si) p LEFT JOIN ce ON ce.place = p.location),
pp AS (SELECT gr.search_loc, gr.item_loc, (coalesce(n, 0) + 3.0 * k / sum(k) OVER (PARTITION BY gr.search_loc)) / (total + 3.0) AS p FROM gr LEFT JOIN ah ON ah.search_loc = gr.search_loc AND ah.item_loc = gr.item_loc)"""


@query("geo_prior_without_centres", f"WITH {_PRIOR} SELECT search_loc, item_loc, round(p, 9) AS p FROM pp")
def geo_prior_without_centres(spark: SparkSession, sf: str) -> DataFrame:
    """Priors where items lie in places without coordinates or without a place, and searched places have no centre, or none of their destinations has one."""
    items, number = shop.items(spark, sf), F.expr("try_cast(substring(location, 4) AS INT)")
    placed = items.where((F.col("location") != "") & (number < 12)).select(
        F.col("location").alias("place"), ((number * 7) % 180 - 90).cast("double").alias("lat"),
        ((number * 13) % 360 - 180).cast("double").alias("lon"),
    )
    counts = shop.associations(spark, sf).where("search_loc <> 'reg3' OR CAST(substring(item_loc, 4) AS INT) >= 12")
    p = geo.destination_prior(counts, geo.centres(placed), places=items.select(F.col("location").alias("place")))
    return p.select("search_loc", "item_loc", F.round("p", 9).alias("p"))


@query("category_prior_features", f"WITH {R.BM25}, {shop.SHOP}, t AS (SELECT {R.norm('text')} AS text, cat, count(*) AS n FROM sk WHERE cat NOT IN ('', '0') GROUP BY ALL) SELECT text, cat, round(n / sum(n) OVER (PARTITION BY text), 6) AS share FROM t")
def category_prior_features(spark: SparkSession, sf: str) -> DataFrame:
    """A text's own category shares; a run that leaves out a query's own clicks gets none of them."""
    shares = category.text_shares(shop.clicks(spark, sf))
    own = category.exact_shares(shares, leave_out=False).unionByName(category.exact_shares(shares, leave_out=True))
    return own.withColumn("share", F.round("share", 6))


_COLD = f"""{shop.SHOP}, fr AS (SELECT {R.norm('text')} AS text, search_loc AS key, item_id FROM sk WHERE {R.norm('text')} NOT IN (SELECT {R.norm('text')} FROM sq WHERE qid % 4 = 0)),
tx AS (SELECT text, sha256(to_json(['cold', text])) AS h FROM (SELECT DISTINCT text FROM fr)), tp0 AS (SELECT text, CASE WHEN row_number() OVER (ORDER BY h, text) <= 8 THEN 'audit' WHEN row_number() OVER (ORDER BY h, text) <= 14 THEN 'tune' ELSE 'fit' END AS partition FROM tx),
kn AS (SELECT * FROM fr WHERE item_id IN (SELECT item_id FROM si WHERE item_id % 3 <> 1)), rp AS (SELECT text, key, row_number() OVER (PARTITION BY text ORDER BY sha256(to_json(['cold', key])), key) AS rn FROM (SELECT DISTINCT text, key FROM kn)),
cl AS (SELECT DISTINCT item_id FROM kn), ot AS (SELECT item_id, row_number() OVER (ORDER BY sha256(to_json(['cold', item_id::VARCHAR])), item_id) AS rn FROM si WHERE item_id % 3 <> 1 AND item_id NOT IN (SELECT item_id FROM cl)),
ct AS (SELECT item_id FROM cl UNION ALL SELECT item_id FROM ot WHERE rn <= greatest(0, (SELECT count(*) FROM cl) + 20 - (SELECT count(*) FROM cl)))"""


@query("cold_protocol", f"WITH {_COLD}, m AS (SELECT text, string_agg(item_id::VARCHAR, ' ' ORDER BY item_id) AS item_ids FROM (SELECT DISTINCT text, item_id FROM kn) GROUP BY text) SELECT text, partition, key, item_ids FROM tp0 JOIN rp USING (text) JOIN m USING (text) WHERE rn = 1 UNION ALL SELECT 'catalogue', '', '', string_agg(item_id::VARCHAR, ' ' ORDER BY item_id) FROM ct")
def cold_protocol(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of unseen texts, and the catalogue as one row; 20 items beside the clicked ones."""
    clicks = shop.clicks(spark, sf).withColumnRenamed("search_loc", "key").select("text", "key", "item_id")
    items = shop.items(spark, sf).where("item_id % 3 <> 1")
    historic = shop.queries(spark, sf).where("qid % 4 = 0").select("text")
    own = clicks.withColumn("text", X.normalize(F.col("text"))).join(historic.select(X.normalize(F.col("text")).alias("text")), "text", "left_anti")
    size = own.join(items.select("item_id"), "item_id", "left_semi").select("item_id").distinct().count() + 20
    catalogue, manifest = protocol.cold(clicks, items, historic, "cold", {"audit": 8, "tune": 6}, "fit", size)
    joined = lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")
    whole = catalogue.agg(joined(F.array_sort(F.collect_list("item_id"))).alias("item_ids"))
    return manifest.withColumn("item_ids", joined(F.col("item_ids"))).unionByName(
        whole.select(F.lit("catalogue").alias("text"), F.lit("").alias("partition"), F.lit("").alias("key"), "item_ids")
    )
