"""Reconstructions and checks of stored rankings, encoder inputs, and grids over mixing weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import fusion, geo, integrity, protocol
from . import roles as R
from .evaluation_queries import _PAIR, _two
from .learning_queries import _drawn
from .registry import query
from .vector_queries import _TOP, POOL, ranked_pool
from .retrieval_queries import _LABELLED, channels, labelled, location_bonus_grid, scores

_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("rank_recovery", f"WITH {R.BM25}, v AS (SELECT qid, channel, round(1 / (1.0::DOUBLE / (60 + rank)) - 60)::BIGINT AS r FROM ch) SELECT qid, channel, count(*) AS n, max(r) AS max_rank, count(*) = max(r) AND count(DISTINCT r) = count(*) AND min(r) = 1 AS complete FROM v GROUP BY ALL")
def rank_recovery(spark: SparkSession, sf: str) -> DataFrame:
    rows = channels(spark, sf).withColumn("inverse", S.reciprocal_rank(F.col("rank"), 60))
    return integrity.recovered_ranks(rows, "inverse", 60, ["qid", "channel"])


@query("norm_recovery", f"""WITH {_TOP}, p AS (SELECT r.qid, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos,
 list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS raw
 FROM r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.item_id WHERE rank <= {POOL}),
n AS (SELECT qid, median(raw / cos) FILTER (WHERE abs(cos) >= 1e-3) AS norm FROM p GROUP BY qid)
SELECT qid, round(norm, 6) AS norm, round(max(abs(raw - norm * cos)), 6) AS residual, count(*) AS n FROM p JOIN n USING (qid) GROUP BY qid, norm""")
def norm_recovery(spark: SparkSession, sf: str) -> DataFrame:
    v = R.table(spark, sf, "embeddings")
    q, c = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")), v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("iv"))
    pairs = ranked_pool(spark, sf).join(q, "qid").join(c, "item_id")
    dot, own = S.dot(F.col("qv"), F.col("iv")), F.sqrt(S.dot(F.col("iv"), F.col("iv")))
    pairs = pairs.select("qid", (dot / own).alias("raw"), S.cosine(F.col("qv"), F.col("iv")).alias("cos"))
    return integrity.recovered_norms(pairs, "qid").select("qid", F.round("norm", 6).alias("norm"), F.round("residual", 6).alias("residual"), "n")


@query("label_groups", """WITH r AS (SELECT (l_returnflag = 'R')::INTEGER AS y, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
s AS (SELECT y, i, CASE WHEN i = 1 OR (y = 1 AND lag(y) OVER (ORDER BY i) = 0) THEN 1 ELSE 0 END AS new FROM r), g AS (SELECT y, sum(new) OVER (ORDER BY i)::BIGINT AS grp FROM s)
SELECT grp, count(*) AS n, sum(y)::BIGINT AS positives FROM g GROUP BY grp""")
def label_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.table(spark, sf, "lineitem").select(*_LINE, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return integrity.label_groups(rows, "y", _LINE).groupBy("grp").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


@query("training_groups", f"""WITH {_LABELLED}, w AS (SELECT qid, item_id, label, sum(label) OVER (PARTITION BY qid) AS pos, sum(1 - label) OVER (PARTITION BY qid) AS neg FROM lab)
SELECT qid, count(*) AS n, sum(label)::BIGINT AS positives, count(DISTINCT item_id) = count(*) AS valid FROM w WHERE pos > 0 AND neg > 0 GROUP BY qid""")
def training_groups(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.training_groups(E.row_weights(labelled(spark, sf)))


@query("score_alignment", f"WITH {R.BM25}, j AS (SELECT a.rank AS a, b.rank AS b FROM (SELECT * FROM ch WHERE channel = 'title') a FULL JOIN (SELECT * FROM ch WHERE channel = 'description') b ON a.qid = b.qid AND a.item_id = b.item_id) SELECT count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only, count(*) FILTER (WHERE a = a AND b = b) AS both, count(*) FILTER (WHERE a <> b) AS differing FROM j")
def score_alignment(spark: SparkSession, sf: str) -> DataFrame:
    ch = channels(spark, sf)
    return integrity.alignment(ch.where("channel = 'title'"), ch.where("channel = 'description'"), ["qid", "item_id"], "rank")


@query("pool_digest", f"WITH {R.FUSED} SELECT qid, sha256(string_agg(pool_rank || ':' || item_id, ',' ORDER BY pool_rank)) AS digest FROM pool WHERE pool_rank <= 998 GROUP BY qid")
def pool_digest(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.pool_digest(fusion.pool(channels(spark, sf)), "qid", "pool_rank", [F.col("pool_rank").cast("string"), F.col("item_id").cast("string")])


@query("prior_fingerprint", f"""WITH {R.CLICKS}, n AS (SELECT search_loc, item_loc, count(*) AS n FROM clicks GROUP BY ALL),
h AS (SELECT sha256(to_json([search_loc::VARCHAR, item_loc::VARCHAR, n::VARCHAR])) AS h, n FROM n), b AS (SELECT ('0x' || substr(h, 1, 8))::BIGINT % 256 AS b, sha256(string_agg(h, ',' ORDER BY h)) AS d, count(*) AS c, sum(n) AS t FROM h GROUP BY 1)
SELECT sum(c)::BIGINT AS n_rows, sum(t)::BIGINT AS total, sha256(string_agg(b || ':' || d, ',' ORDER BY b || ':' || d)) AS digest FROM b""")
def prior_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.counts_fingerprint(geo.associations(R.clicks(spark, sf)).select("search_loc", "item_loc", "n"), ["search_loc", "item_loc"], "n")


_VALUES = "CASE WHEN p_size % 3 = 0 THEN '' ELSE lower(p_brand) END"
_CATEGORY = "CASE WHEN p_size % 4 = 0 THEN '0' ELSE lower(p_type) END"
_FILTERS = "CASE WHEN p_size % 3 = 0 THEN '' ELSE lower('brand ' || p_brand) END"


@query("query_formats", f"""WITH p AS (SELECT p_partkey, lower(p_name) AS t, {_VALUES} AS v, {_CATEGORY} AS c, {_FILTERS} AS f FROM part), x AS (SELECT *, 'запрос: ' || t || CASE WHEN f <> '' THEN ' фильтры: ' || f ELSE '' END AS base FROM p)
SELECT p_partkey, base || CASE WHEN c <> '0' THEN ' категория: ' || c ELSE '' END AS current_text, t AS plain_text, t || CASE WHEN v <> '' THEN ' | ' || v ELSE '' END AS values_text, base AS no_category_text, 'query: ' || t AS encoder_text FROM x""")
def query_formats(spark: SparkSession, sf: str) -> DataFrame:
    p = R.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("t"), F.expr(_VALUES).alias("v"), F.expr(_CATEGORY).alias("c"), F.expr(_FILTERS).alias("f"),
    )
    styles = (X.query_format(F.col("t"), F.col("f"), F.col("v"), F.col("c"), s).alias(f"{s}_text") for s in ("current", "plain", "values", "no_category"))
    return p.select("p_partkey", *styles, X.prefixed("query: ", X.normalize(F.col("t"))).alias("encoder_text"))


@query("rating_floor", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_size::DOUBLE ELSE round(p_size / 10.0::DOUBLE, 1) END AS floor FROM part""")
def rating_floor(spark: SparkSession, sf: str) -> DataFrame:
    whole, tenths = F.col("p_size").cast("string"), F.replace(F.format_string("%.1f", F.col("p_size") / 10.0), F.lit("."), F.lit(","))
    text = F.when(F.col("p_size") % 3 == 0, "рейтинг пользователя не важен").when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("цвет рейтинг пользователя  "), whole, F.lit(" звёзд")),
    ).otherwise(F.concat(F.lit("рейтинг пользователя "), tenths))
    return R.table(spark, sf, "part").select("p_partkey", X.rating_floor(text).alias("floor"))


@query("id_patterns", r"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN left(md5(o_orderkey::VARCHAR), 16) WHEN 1 THEN upper(left(md5(o_orderkey::VARCHAR), 16)) WHEN 2 THEN left(md5(o_orderkey::VARCHAR), 15) ELSE left(md5(o_orderkey::VARCHAR), 16) || ' ' END AS id FROM orders)
SELECT o_orderkey, regexp_full_match(id, '[0-9a-f]{16}') AS is_item_id, length(id) = 16 AS is_query_id FROM x""")
def id_patterns(spark: SparkSession, sf: str) -> DataFrame:
    m, h = F.col("o_orderkey") % 4, F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 16)
    ids = F.when(m == 0, h).when(m == 1, F.upper(h)).when(m == 2, F.substring(h, 1, 15)).otherwise(F.concat(h, F.lit(" ")))
    return R.table(spark, sf, "orders").select("o_orderkey", protocol.is_item_id(ids).alias("is_item_id"), protocol.is_query_id(ids).alias("is_query_id"))


@query("alpha_grid", f"""WITH {R.FUSED}, s AS (SELECT f.qid, f.item_id, f.score * 10 AS p, count(*) OVER (PARTITION BY f.qid, c.category) / count(*) OVER (PARTITION BY f.qid) AS share FROM fused f JOIN corpus c USING (item_id)),
c AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS k FROM s), g AS (SELECT a AS alpha, qid, item_id, round(ln(k / (1 - k)) + a * ln(greatest(share, 1e-4)), 6) AS mixed FROM c, (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE)) AS v(a)),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY mixed DESC, item_id) AS rank FROM g) SELECT alpha, qid, item_id, mixed, rank FROM r WHERE rank <= 10""")
def alpha_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).join(R.corpus(spark, sf).select("item_id", "category"), "item_id")
    share = F.count("*").over(Window.partitionBy("qid", "category")) / F.count("*").over(Window.partitionBy("qid"))
    return integrity.alpha_grid(rows.select("qid", "item_id", (F.col("score") * 10).alias("prob"), share.alias("share")), [0.0, 0.05, 0.1, 0.25], 10)


@query("location_bonus_summary", f"""WITH {R.FUSED}, {R.TRUTH}, g AS (SELECT b AS bonus, f.qid, f.item_id, round(f.score + CASE WHEN q.location = c.location AND q.location <> '' THEN b ELSE 0 END, 9) AS score
 FROM fused f JOIN queries q USING (qid) JOIN corpus c USING (item_id), (VALUES (0.0::DOUBLE), (0.02::DOUBLE), (0.1::DOUBLE)) AS v(b)),
r AS (SELECT *, row_number() OVER (PARTITION BY bonus, qid ORDER BY score DESC, item_id) AS rank FROM g),
tl AS (SELECT t.*, q.location AS here, c.location = q.location AND q.location <> '' AS loc FROM truth t JOIN queries q USING (qid) LEFT JOIN corpus c USING (item_id)),
s AS (SELECT qid, count(*) AS size, count(*) FILTER (WHERE loc) AS locals, count(*) FILTER (WHERE NOT loc AND here <> '') AS others FROM tl GROUP BY qid), k AS (SELECT bonus, r.qid, count(*) AS hits, count(*) FILTER (WHERE loc) AS lh FROM r JOIN tl ON tl.qid = r.qid AND tl.item_id = r.item_id WHERE rank <= 10 GROUP BY ALL),
ls AS (SELECT bonus, r.qid, avg((q.location <> '' AND c.location = q.location)::INTEGER) AS share FROM r JOIN queries q USING (qid) JOIN corpus c USING (item_id) WHERE rank <= 10 GROUP BY ALL),
h AS (SELECT b.bonus, s.qid, coalesce(hits, 0) / size AS rec, CASE WHEN locals > 0 THEN coalesce(lh, 0) / locals END AS lr, CASE WHEN others > 0 THEN (coalesce(hits, 0) - coalesce(lh, 0)) / others END AS orr, coalesce(share, 0) AS share FROM s CROSS JOIN (SELECT DISTINCT bonus FROM g) b LEFT JOIN k ON k.bonus = b.bonus AND k.qid = s.qid LEFT JOIN ls ON ls.bonus = b.bonus AND ls.qid = s.qid),
o AS (SELECT bonus, round(avg(rec), 6) AS all_recall, round(avg(rec) FILTER (WHERE qid % 2 = 0), 6) AS first_recall, round(avg(rec) FILTER (WHERE qid % 2 <> 0), 6) AS second_recall, round(avg(lr), 6) AS local_recall, round(avg(orr), 6) AS other_recall, round(avg(share), 6) AS local_share FROM h GROUP BY bonus)
SELECT *, row_number() OVER (ORDER BY first_recall DESC NULLS LAST, bonus) = 1 AS best FROM o""")
def location_bonus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.bonus_summary(location_bonus_grid(spark, sf), R.truth(spark, sf), F.col("qid") % 2 == 0, R.queries(spark, sf), R.corpus(spark, sf))


@query("hash_sample", "SELECT p_name AS text, sha256(to_json(['draw', p_name])) AS digest FROM (SELECT DISTINCT p_name FROM part) ORDER BY digest, text LIMIT 50")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.sample(R.table(spark, sf, "part").select(F.col("p_name").alias("text")), "text", "draw", 50).select("text", F.col("h").alias("digest"))


@query("one_positive_per_text", f"WITH {R.CLICKS}, h AS (SELECT DISTINCT text, item_id, sha256(to_json(['pair', item_id::VARCHAR])) AS h FROM clicks), r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY h, item_id) AS rn FROM h) SELECT text, item_id FROM r WHERE rn = 1")
def one_positive_per_text(spark: SparkSession, sf: str) -> DataFrame:
    pairs = R.clicks(spark, sf).select("text", "item_id").distinct()
    return protocol.representatives(pairs, "text", "item_id", "pair").select("text", "item_id")


_STRATA = f"""{_PAIR}, cl AS (SELECT {R.norm('text')} AS cluster, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS stratum, avg(rb - ra) AS delta, count(*) AS n FROM x JOIN queries USING (qid) GROUP BY ALL),
mx AS (SELECT CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS stratum, count(*) AS m FROM queries GROUP BY 1), sh AS (SELECT * FROM mx WHERE stratum IN (SELECT stratum FROM cl)), {_drawn('cl')},
e AS (SELECT b, stratum, sum(w * delta * n) / nullif(sum(w * n), 0) AS v FROM dr0 GROUP BY ALL), m AS (SELECT b, sum(v * m) / sum(m) AS m, count(*) AS c FROM e JOIN sh USING (stratum) WHERE v IS NOT NULL GROUP BY b HAVING count(*) = (SELECT count(*) FROM sh)),
p AS (SELECT sum(v * m) / sum(m) AS point FROM (SELECT stratum, sum(delta * n) / sum(n) AS v FROM cl GROUP BY 1) JOIN sh USING (stratum))"""


@query("stratified_bootstrap_ci", f"WITH {_STRATA} SELECT (SELECT round(point, 6) FROM p) AS point, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM m WHERE m IS NOT NULL")
def stratified_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    own = R.queries(spark, sf).select(
        "qid", X.normalize(F.col("text")).alias("cluster"), F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("stratum"),
    )
    d = a.withColumnRenamed("r", "ra").join(b.withColumnRenamed("r", "rb"), "qid").join(own, "qid")
    clusters = d.groupBy("cluster", "stratum").agg(F.avg(F.col("rb") - F.col("ra")).alias("delta"), F.count("*").alias("n"))
    return E.stratified_bootstrap(clusters, own.groupBy("stratum").agg(F.count("*").alias("m"))).select(
        *(F.round(c, 6).alias(c) for c in ("point", "low", "high")), "replicates",
    )
