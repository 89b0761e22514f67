"""Recall, slices, re-weighting, paired comparison, profiles, protocol and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import category, fusion, protocol
from . import hybrid_queries, shop
from . import roles as R
from .registry import query
from .retrieval_queries import channels, scores


def groups(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """One row per query with hits, denominators, and flags of the query."""
    q = R.queries(spark, sf)
    found = E.hits(fusion.fuse(scores(spark, sf), k), R.truth(spark, sf), R.corpus(spark, sf).where("category = 'en'").select("item_id"), k)
    own = q.select(
        "qid", X.normalize(F.col("text")).alias("text"), (F.size(X.tokens(X.normalize(F.col("text")))) <= 30).alias("short"),
        (F.col("qid") % 2 == 0).alias("even"),
    )
    return own.join(found, "qid", "left").na.fill(0, ["n_hit", "n_available", "n_full"])


_GROUPS = f"""{R.FUSED}, {R.TRUTH}, top AS (SELECT qid, item_id FROM fr WHERE fr <= 10), hit AS (SELECT t.qid, count(x.qid) AS n_hit, count(*) FILTER (WHERE c.category = 'en') AS n_available, count(*) AS n_full FROM truth t JOIN corpus c USING (item_id) LEFT JOIN top x ON x.qid = t.qid AND x.item_id = t.item_id GROUP BY t.qid),
grp AS (SELECT q.qid, {R.norm('text')} AS text, len({R.toks(R.norm('text'))}) <= 30 AS short, q.qid % 2 = 0 AS even, coalesce(n_hit, 0) AS n_hit, coalesce(n_available, 0) AS n_available, coalesce(n_full, 0) AS n_full FROM queries q LEFT JOIN hit USING (qid))"""
_R = f"{_GROUPS}, ok AS (SELECT *, n_hit / n_full AS r FROM grp WHERE n_full > 0)"


@query("recall_groups", f"WITH {_GROUPS} SELECT * FROM grp")
def recall_groups(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf)


@query("recall_macro_micro", f"WITH {_R}, t AS (SELECT text, avg(r) AS r, sum(r) AS s, count(*) AS c, sum(n_hit) AS h, sum(n_full) AS d FROM ok GROUP BY text) SELECT round(sum(s) / sum(c), 6) AS macro, round(avg(r), 6) AS text_macro, round(sum(h) / sum(d), 6) AS micro, sum(c)::BIGINT AS n_queries FROM t")
def recall_macro_micro(spark: SparkSession, sf: str) -> DataFrame:
    return E.recall(groups(spark, sf), denominator="n_full")


@query("recall_text_macro", f"WITH {_R} SELECT text, count(*) AS n, round(avg(r), 6) AS mean_recall, round(avg(CASE WHEN n_available > 0 THEN n_hit / n_available END), 6) AS conditional FROM ok GROUP BY text")
def recall_text_macro(spark: SparkSession, sf: str) -> DataFrame:
    ok = groups(spark, sf).where("n_full > 0")
    return ok.groupBy("text").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("n_hit") / F.col("n_full")), 6).alias("mean_recall"),
        F.round(F.avg(F.when(F.col("n_available") > 0, F.col("n_hit") / F.col("n_available"))), 6).alias("conditional"),
    )


@query("recall_slices", f"WITH {_R} SELECT 'even' AS flag, even AS value, count(*) AS n, round(avg(r), 6) AS mean_recall FROM ok GROUP BY even UNION ALL SELECT 'short', short, count(*), round(avg(r), 6) FROM ok GROUP BY short")
def recall_slices(spark: SparkSession, sf: str) -> DataFrame:
    return E.slices(groups(spark, sf).where("n_full > 0").withColumn("r", F.col("n_hit") / F.col("n_full")), ["even", "short"])


@query("benchmark_mix", f"WITH {_R}, own AS (SELECT even, short, avg(r) AS r FROM ok GROUP BY ALL), mix AS (SELECT even, short, count(*) AS m FROM grp GROUP BY ALL) SELECT round(sum(m * r) / sum(CASE WHEN r IS NOT NULL THEN m END), 6) AS mixed_recall, round(coalesce(sum(CASE WHEN r IS NOT NULL THEN m END), 0) / sum(m), 6) AS covered, count(*) AS strata FROM mix LEFT JOIN own USING (even, short)")
def benchmark_mix(spark: SparkSession, sf: str) -> DataFrame:
    g = groups(spark, sf)
    return E.mix_weighted(g.where("n_full > 0").withColumn("r", F.col("n_hit") / F.col("n_full")), g, ["even", "short"])


@query("effective_sample_size", "SELECT l_returnflag, round(pow(sum(l_quantity), 2) / sum(l_quantity * l_quantity), 6) AS ess, count(*) AS n FROM lineitem GROUP BY 1")
def effective_sample_size(spark: SparkSession, sf: str) -> DataFrame:
    return E.effective_size(R.table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("route_overlap", f"""WITH {R.BM25}, {R.TRUTH}, f AS (SELECT qid, item_id, bool_or(channel = 'title') AS a, bool_or(channel = 'description') AS b FROM ch GROUP BY ALL), g AS (SELECT f.*, t.qid IS NOT NULL AS h FROM f LEFT JOIN truth t USING (qid, item_id))
SELECT qid, count(*) FILTER (WHERE a) AS n_title, count(*) FILTER (WHERE b) AS n_description, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND h) AS title_hits, count(*) FILTER (WHERE b AND h) AS description_hits,
 round(count(*) FILTER (WHERE a AND b) / nullif(count(*) FILTER (WHERE a OR b), 0), 6) AS jaccard, round(count(*) FILTER (WHERE a AND b) / nullif(least(count(*) FILTER (WHERE a), count(*) FILTER (WHERE b)), 0), 6) AS overlap_coefficient FROM g GROUP BY qid""")
def route_overlap(spark: SparkSession, sf: str) -> DataFrame:
    f = channels(spark, sf).groupBy("qid", "item_id").agg(
        F.bool_or(F.col("channel") == "title").alias("a"), F.bool_or(F.col("channel") == "description").alias("b"),
    )
    f = f.join(R.truth(spark, sf).withColumn("h", F.lit(True)), ["qid", "item_id"], "left").na.fill(False, ["h"])
    n = {k: F.count_if(k) for k in ("a", "b", "a and b", "a or b", "a and h", "b and h")}
    n = {k: F.count_if(F.expr(k)) for k in n}
    return f.groupBy("qid").agg(n["a"].alias("n_title"), n["b"].alias("n_description"), n["a and b"].alias("n_both"), n["a and h"].alias("title_hits"), n["b and h"].alias("description_hits"),
                                F.round(n["a and b"] / F.nullif(n["a or b"], F.lit(0)), 6).alias("jaccard"), F.round(n["a and b"] / F.nullif(F.least(n["a"], n["b"]), F.lit(0)), 6).alias("overlap_coefficient"))


@query("geo_contribution", f"""WITH {R.BM25}, {R.TRUTH}, g AS (SELECT field, qid, doc, row_number() OVER (PARTITION BY field, qid ORDER BY score DESC, doc) AS rank FROM sc JOIN queries USING (qid) JOIN corpus c ON c.item_id = doc WHERE c.location = queries.location), ge AS (SELECT DISTINCT qid, doc AS item_id FROM g WHERE rank <= 20), cb AS (SELECT DISTINCT qid, item_id FROM ch),
n AS (SELECT count(*) AS extra, count(DISTINCT qid) AS n_queries FROM ge ANTI JOIN cb ON ge.qid = cb.qid AND ge.item_id = cb.item_id),
t AS (SELECT t.qid, avg((cb.qid IS NOT NULL)::INTEGER) AS b, avg((cb.qid IS NOT NULL OR ge.qid IS NOT NULL)::INTEGER) AS a, count(*) FILTER (WHERE cb.qid IS NULL AND ge.qid IS NOT NULL) AS new FROM truth t LEFT JOIN cb ON cb.qid = t.qid AND cb.item_id = t.item_id LEFT JOIN ge ON ge.qid = t.qid AND ge.item_id = t.item_id GROUP BY t.qid)
SELECT extra, n_queries, recall_before, recall_after, incremental_recall, queries_with_new_positive FROM n, (SELECT round(avg(b), 6) AS recall_before, round(avg(a), 6) AS recall_after, round(avg(a - b), 6) AS incremental_recall, count(*) FILTER (WHERE new > 0) AS queries_with_new_positive FROM t)""")
def geo_contribution(spark: SparkSession, sf: str) -> DataFrame:
    from .retrieval_queries import geo_topk

    return E.contribution(channels(spark, sf), geo_topk(spark, sf), R.truth(spark, sf), R.corpus(spark, sf))


_HC = f"{R.BM25}, {R.TRUTH}, {shop.SHOP}, {shop.HYBRID}"
_MASKED = {
    "description": "d", "dense": "e", "geo": "g", "description_or_dense": "d OR e", "description_and_dense": "d AND e",
    "description_only": "d AND NOT e", "dense_only": "e AND NOT d", "geo_unique_additions": "g AND NOT (d OR e)",
    "other_routes": "NOT (d OR e OR g)", "full_pool": "true",
}
_MASKS = f"""{_HC}, f AS (SELECT qid, item_id, bool_or(channel = 'description') AS d, bool_or(channel = 'dense') AS e, bool_or(channel LIKE '%geo') AS g FROM hc GROUP BY ALL), x AS (SELECT f.*, t.qid IS NOT NULL AS hit FROM f LEFT JOIN truth t USING (qid, item_id)),
rm AS (SELECT qid, {', '.join(f"count(*) FILTER (WHERE {m}) AS {n}_count, count(*) FILTER (WHERE ({m}) AND hit) AS {n}_hits" for n, m in _MASKED.items())} FROM x GROUP BY qid),
rs AS (SELECT *, round(description_and_dense_count / nullif(description_or_dense_count, 0), 6) AS jaccard, round(description_and_dense_count / nullif(description_count, 0), 6) AS description_overlap, round(description_and_dense_count / nullif(dense_count, 0), 6) AS dense_overlap,
 round(description_and_dense_count / nullif(least(description_count, dense_count), 0), 6) AS overlap_coefficient FROM rm)"""


@query("route_masks", f"WITH {_MASKS} SELECT * FROM rs")
def route_masks(spark: SparkSession, sf: str) -> DataFrame:
    return E.route_masks(hybrid_queries.channels(spark, sf), R.truth(spark, sf))


@query("route_statistics", f"""WITH {_MASKS}, v AS (SELECT category AS text, 'jaccard' AS field, jaccard AS v FROM rs JOIN sq USING (qid) UNION ALL SELECT category, 'geo_hits', CASE WHEN geo_count > 0 THEN geo_hits END FROM rs JOIN sq USING (qid)), t AS (SELECT field, text, count(v) AS n, count(*) AS c, avg(v) AS m, sum(v) AS s FROM v GROUP BY ALL)
SELECT field, sum(n)::BIGINT AS groups, sum(c - n)::BIGINT AS undefined, count(m) AS texts, round(sum(s) / nullif(sum(n), 0), 6) AS group_mean, round(avg(m), 6) AS text_macro_mean FROM t GROUP BY field""")
def route_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of queries and their means over groups of queries (here those of a category)."""
    rows = route_masks(spark, sf).join(shop.queries(spark, sf).select("qid", F.col("category").alias("text")), "qid")
    return E.described(rows.withColumn("geo_hits", F.when(F.col("geo_count") > 0, F.col("geo_hits"))), ["jaccard", "geo_hits"])


@query("query_strata", f"WITH {shop.SQL} SELECT qid, location NOT IN (SELECT location FROM si) OR location = '' AS no_exact_location, filters <> '' AS has_filters, len({R.toks(R.norm('text'))}) <= 1 AS one_word FROM sq")
def query_strata(spark: SparkSession, sf: str) -> DataFrame:
    return E.stratum(shop.queries(spark, sf), shop.items(spark, sf)).select("qid", "no_exact_location", "has_filters", "one_word")


@query("search_population", f"""WITH {shop.SQL} SELECT qid % 5 AS part, count(*) AS n, round(avg((filters <> '')::INTEGER), 6) AS with_filters, round(avg((location <> '')::INTEGER), 6) AS with_place, round(avg((category NOT IN ('', '0'))::INTEGER), 6) AS with_category, round(avg((delivery = '1')::INTEGER), 6) AS with_delivery, round(avg(len({R.toks(R.norm('text'))})), 6) AS mean_words FROM sq GROUP BY 1""")
def search_population(spark: SparkSession, sf: str) -> DataFrame:
    return E.population(shop.queries(spark, sf).withColumn("part", F.col("qid") % 5), ["part"])


@query("representative_recall", f"""WITH {_R}, g AS (SELECT *, qid % 8 AS ctx FROM ok), rp AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY sha256(to_json(['eval', qid::VARCHAR])), qid) = 1 AS rep FROM g),
t AS (SELECT ctx, avg(r) AS r, sum(r) AS s, count(*) AS c, sum(n_hit) AS h, sum(n_full) AS d FROM rp GROUP BY ctx) SELECT (SELECT round(sum(s) / sum(c), 6) FROM t) AS macro, (SELECT round(avg(r), 6) FROM t) AS text_macro, (SELECT round(sum(h) / sum(d), 6) FROM t) AS micro, (SELECT sum(c)::BIGINT FROM t) AS n_queries, (SELECT round(avg(r), 6) FROM rp WHERE rep) AS representative_macro""")
def representative_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The four averages, queries of equal id modulo 8 standing for contexts of one text."""
    g = groups(spark, sf).where("n_full > 0").withColumn("text", F.col("qid") % 8)
    chosen = protocol.representatives(g.select("text", "qid"), "text", "qid", "eval").select("qid", F.lit(True).alias("rep"))
    return E.recall(g.join(chosen, "qid", "left").na.fill(False, ["rep"]), denominator="n_full", representative="rep")


@query("top_categories_report", "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 4")
def top_categories_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = R.table(spark, sf, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"))
    return E.counter_report(counts, "category", "n", 4)


_PAIR = f"""{R.BM25}, {R.TRUTH}, n AS (SELECT qid, count(*) AS n FROM truth GROUP BY qid), x AS (SELECT n.qid, count(*) FILTER (WHERE channel = 'title' AND rank <= 10) / any_value(n) AS ra, count(*) FILTER (WHERE channel = 'description' AND rank <= 10) / any_value(n) AS rb FROM n LEFT JOIN (SELECT ch.* FROM ch JOIN truth USING (qid, item_id)) c ON c.qid = n.qid GROUP BY n.qid)"""


@query("win_loss_tie", f"WITH {_PAIR} SELECT count(*) FILTER (WHERE rb > ra) AS wins, count(*) FILTER (WHERE rb < ra) AS losses, count(*) FILTER (WHERE rb = ra) AS ties, round(avg(rb - ra), 6) AS mean_delta FROM x")
def win_loss_tie(spark: SparkSession, sf: str) -> DataFrame:
    return E.paired(*_two(spark, sf))


def _two(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Recall of the title and of the description channel, by query."""
    ch, truth, all_items = channels(spark, sf), R.truth(spark, sf), R.corpus(spark, sf).select("item_id")
    return [
        E.hits(
            ch.where(F.col("channel") == c), truth, all_items, 10,
        ).select("qid", (F.col("n_hit") / F.col("n_full")).alias("r")) for c in ("title", "description")
    ]


@query("stage_selection", "WITH c AS (SELECT l_linenumber AS stage, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1), b AS (SELECT max(value) AS best FROM c) SELECT min(stage) AS stage, max(best) AS best FROM c, b WHERE best - value <= 0.0005")
def stage_selection(spark: SparkSession, sf: str) -> DataFrame:
    curve = R.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("stage")).agg(F.round(F.avg("l_discount"), 6).alias("value"))
    return E.stage(curve, 0.0005)


@query("population_profile", f"""WITH {R.CLICKS} SELECT count(*) AS pairs, count(DISTINCT text) AS texts, count(DISTINCT (text, search_loc)) AS keys, count(*) - count(DISTINCT (text, search_loc, item_id)) AS repeated, round(avg((search_loc = item_loc)::INTEGER), 6) AS local_share, round(count(DISTINCT item_id) / (SELECT count(*) FROM supplier), 6) AS seen_items FROM clicks""")
def population_profile(spark: SparkSession, sf: str) -> DataFrame:
    items = R.table(spark, sf, "supplier").agg(F.count("*").alias("items"))
    c = R.clicks(spark, sf).agg(
        F.count("*").alias("pairs"), F.count_distinct("text").alias("texts"),
        F.count_distinct(F.struct("text", "search_loc")).alias("keys"),
        F.count_distinct(F.struct("text", "search_loc", "item_id")).alias("d"),
        F.round(F.avg((F.col("search_loc") == F.col("item_loc")).cast("int")), 6).alias("local_share"),
        F.count_distinct("item_id").alias("seen"),
    )
    return c.crossJoin(items).select("pairs", "texts", "keys", (F.col("pairs") - F.col("d")).alias("repeated"), "local_share", F.round(F.col("seen") / F.col("items"), 6).alias("seen_items"))  # one row each


@query("source_coverage", """WITH t AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O'), u AS (SELECT coalesce(t.id, b.id) AS id, CASE WHEN t.id IS NULL THEN 'benchmark_only' WHEN b.id IS NULL THEN 'train_only' ELSE 'overlap' END AS src FROM t FULL JOIN b ON t.id = b.id)
SELECT src AS source, c_mktsegment AS class, count(*) AS n FROM u JOIN customer ON c_custkey = id GROUP BY ALL""")
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    o = R.table(spark, sf, "orders")
    ids = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")).distinct()
    sources = protocol.sources(ids("F"), ids("O"), "id")
    return sources.join(
        R.table(spark, sf, "customer"), F.col("id") == F.col("c_custkey"),
    ).groupBy("source", F.col("c_mktsegment").alias("class")).agg(F.count("*").alias("n"))


@query("binary_auc", """WITH r AS (SELECT quality AS y, (toxic = 0)::INTEGER AS p FROM labels), s AS (SELECT avg(p) FILTER (WHERE y = 1) AS tpr, avg(p) FILTER (WHERE y = 0) AS fpr FROM r) SELECT round(0.5 + 0.5 * (tpr - fpr), 6) AS auc FROM s""")
def binary_auc(spark: SparkSession, sf: str) -> DataFrame:
    p = (F.col("toxic") == 0).cast("int")
    rates = R.table(spark, sf, "labels").agg(F.avg(F.when(F.col("quality") == 1, p)).alias("tpr"), F.avg(F.when(F.col("quality") == 0, p)).alias("fpr"))
    return rates.select(F.round(0.5 + 0.5 * (F.col("tpr") - F.col("fpr")), 6).alias("auc"))


@query("catalog_dedup", """WITH u AS (SELECT s_nationkey AS id, 0 AS src, s_suppkey AS row_id, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey, c_name FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, row_id) AS rn FROM u) SELECT id, src::INTEGER AS src, row_id, name FROM r WHERE rn = 1""")
def catalog_dedup(spark: SparkSession, sf: str) -> DataFrame:
    first = R.table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("row_id"), F.col("c_name").alias("name"))
    second = R.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("row_id"), F.col("s_name").alias("name"))
    return protocol.catalog([second, first], "id", "row_id").select("id", "src", "row_id", "name")


@query("cold_partitions", """WITH h AS (SELECT p_name AS text, sha256(to_json(['cold', p_name])) AS h FROM (SELECT DISTINCT p_name FROM part)), r AS (SELECT *, row_number() OVER (ORDER BY h, text) AS rn FROM h) SELECT text, h AS digest, CASE WHEN rn <= 16 THEN 'audit' WHEN rn <= 32 THEN 'tune' ELSE 'fit' END AS partition FROM r""")
def cold_partitions(spark: SparkSession, sf: str) -> DataFrame:
    texts = R.table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    return protocol.partitions(texts, "text", "cold", {"audit": 16, "tune": 16}, "fit").select("text", F.col("h").alias("digest"), "partition")


@query("representative_rows", """WITH h AS (SELECT o_orderpriority AS text, o_orderkey, sha256(to_json(['rep', o_orderkey::VARCHAR])) AS h FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY h, o_orderkey) AS rn FROM h) SELECT text, o_orderkey, h AS digest FROM r WHERE rn = 1""")
def representative_rows(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.representatives(
        R.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("text"), "o_orderkey"), "text", "o_orderkey", "rep",
    ).select("text", "o_orderkey", F.col("h").alias("digest"))


@query("unseen_rows", f"WITH {R.CLICKS} SELECT DISTINCT text FROM clicks ANTI JOIN (SELECT text AS t FROM clicks WHERE context = 'ECONOMY') s ON s.t = clicks.text UNION ALL SELECT 'seen ' || text FROM (SELECT DISTINCT text FROM clicks SEMI JOIN (SELECT text AS t FROM clicks WHERE context = 'ECONOMY') s ON s.t = clicks.text)")
def unseen_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = R.clicks(spark, sf)
    old = c.where("context = 'ECONOMY'").select("text").distinct()
    texts = c.select("text").distinct()
    return texts.join(old, "text", "left_anti").unionByName(texts.join(old, "text", "left_semi").select(F.concat(F.lit("seen "), "text").alias("text")))


@query("answer_format", f"WITH {R.FUSED} SELECT qid AS query_id, string_agg(item_id::VARCHAR, ' ' ORDER BY fr) AS answer FROM fr WHERE fr <= 10 GROUP BY qid")
def answer_format(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.answers(fusion.fuse(scores(spark, sf), 10))


@query("score_report", f"WITH {R.FUSED} SELECT fr AS rank, count(*) AS n, round(avg(score), 6) AS mean_score, min(score) AS min_score, max(score) AS max_score FROM fr WHERE fr <= 10 GROUP BY fr")
def score_report(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(scores(spark, sf), 10).groupBy("rank").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


@query("answer_validation", f"""WITH {R.FUSED}, a AS (SELECT qid, list(CASE WHEN location = 'src0' THEN item_id + 100000000 ELSE item_id END ORDER BY rank) AS ids FROM ch JOIN corpus USING (item_id) WHERE channel = 'title' GROUP BY qid)
SELECT 'missing_query' AS violation, count(*) AS n FROM queries ANTI JOIN a ON a.qid = queries.qid UNION ALL SELECT 'unknown_item', count(*) FROM (SELECT unnest(ids) AS id FROM a) u ANTI JOIN corpus ON corpus.item_id = u.id UNION ALL SELECT 'too_many', count(*) FROM a WHERE len(ids) > 50
UNION ALL SELECT 'repeated_item', count(*) FROM a WHERE len(ids) <> len(list_distinct(ids)) UNION ALL SELECT 'unknown_query', count(*) FROM a ANTI JOIN queries ON a.qid = queries.qid UNION ALL SELECT 'repeated_query', 0""")
def answer_validation(spark: SparkSession, sf: str) -> DataFrame:
    title = channels(spark, sf).where("channel = 'title'").join(R.corpus(spark, sf).select("item_id", "location"), "item_id")
    top = title.withColumn("item_id", F.when(F.col("location") == "src0", F.col("item_id") + 100000000).otherwise(F.col("item_id")))
    return protocol.violations(protocol.answers(top), R.queries(spark, sf).select("qid"), R.corpus(spark, sf).select("item_id"))


@query("group_contiguity", """WITH r AS (SELECT l_returnflag AS g, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem), s AS (SELECT g, i, CASE WHEN lag(g) OVER (ORDER BY i) = g THEN 0 ELSE 1 END AS new FROM r) SELECT g AS grp, sum(new)::BIGINT AS islands, count(*) AS n FROM s GROUP BY g""")
def group_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    li = R.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return protocol.islands(li, "grp", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("sentinel_fix", "SELECT event_id, CASE WHEN event_type IN ('', '0', 'error') THEN 0 ELSE value END AS value FROM events")
def sentinel_fix(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "events").select(
        "event_id",
        F.when(
            category.without_sentinel(F.when(F.col("event_type") == "error", "0").otherwise(F.col("event_type"))) == "", 0.0,
        ).otherwise(F.col("value")).alias("value"),
    )


@query("dataset_overlap", "SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS n_union, (SELECT count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)) AS n_both, (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)) AS n_without")
def dataset_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c, s, n = (R.table(spark, sf, t).select(F.col(k).alias("id")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(c.union(s).distinct(), "n_union").crossJoin(one(c.intersect(s), "n_both")).crossJoin(one(n.subtract(s), "n_without"))


@query("corpus_fingerprint", """WITH r AS (SELECT sha256(to_json([p_partkey::VARCHAR, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END, p_brand])) AS h FROM part), b AS (SELECT ('0x' || substr(h, 1, 8))::BIGINT % 4096 AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(lpad(b::VARCHAR, 12, '0') || ':' || d, chr(10) ORDER BY lpad(b::VARCHAR, 12, '0') || ':' || d)) AS fingerprint, sum(n)::BIGINT AS n FROM b""")
def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.fingerprint(R.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("p_name"), "p_brand"))


@query("table_inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels")))
def table_inventory(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import inventory

    return inventory(
        spark,
        {
            t: f"{sf}/{t}.parquet" for t in (
                "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels",
            )
        },
    ).select("name", "n_rows", "n_columns")


@query("text_scan", "SELECT coalesce(p_partkey::VARCHAR, '') AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_size::VARCHAR, '') AS p_size FROM part")
def text_scan(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import read_text

    return read_text(spark, f"{sf}/part.parquet", ["p_partkey", "p_name", "p_size"])
