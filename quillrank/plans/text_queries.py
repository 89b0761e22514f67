"""Text, hashing and scalar operators over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..functions import text as X
from ..operators import tfidf
from . import roles as R
from .registry import query

_N = R.norm("text")
_HEX = "('0x' || substr(sha256('[{seed},' || to_json({c}) || ']'), 1, 16))::UBIGINT"


@query("norm_tokens", rf"""WITH d AS (SELECT doc_id, {_N} AS n FROM documents), t AS (SELECT doc_id, n, {R.toks('n')} AS t FROM d)
SELECT doc_id, md5(n) AS norm_md5, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, len(list_distinct(list_filter(t, lambda x: length(x) >= 2)))::BIGINT AS n_long,
 (CASE WHEN len(t) >= 2 THEN len(list_distinct(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) ELSE 0 END)::BIGINT AS n_bigrams FROM t""")
def norm_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("n")).withColumn("t", X.tokens(F.col("n")))
    size = lambda c: F.size(c).cast("long")
    return d.select(
        "doc_id", F.md5(F.col("n").cast("binary")).alias("norm_md5"), size("t").alias("n_tokens"),
        size(F.array_distinct("t")).alias("n_distinct"), size(F.array_distinct(X.long_tokens(F.col("n")))).alias("n_long"),
        size(X.bigrams(F.col("t"))).alias("n_bigrams"),
    )


@query("held_out_split", f"""WITH d AS (SELECT doc_id, {_N} AS n FROM documents)
SELECT doc_id, round({_HEX.format(seed=42, c='n')}::DOUBLE / 18446744073709551616.0, 9) AS fraction, {_HEX.format(seed=42, c='n')}::DOUBLE / 18446744073709551616.0 < 0.2 AS is_valid FROM d""")
def held_out_split(spark: SparkSession, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").select("doc_id", X.normalize(F.col("text")).alias("n"))
    return d.select("doc_id", F.round(S.hash_fraction(F.col("n"), 42), 9).alias("fraction"), S.held_out(F.col("n"), 0.2).alias("is_valid"))


@query("group_id_hash", "SELECT o_orderkey, sha256(to_json([o_orderstatus, o_orderpriority, o_custkey::VARCHAR, '', 'x'])) AS group_id, sha256(to_json(['salt', o_orderpriority])) AS salted FROM orders")
def group_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    o = R.table(spark, sf, "orders")
    key = [F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.lit(""), F.lit("x")]
    return o.select("o_orderkey", S.digest(*key).alias("group_id"), S.salted_digest("salt", F.col("o_orderpriority")).alias("salted"))


@query("fold_assignment", f"SELECT c_custkey, ({_HEX.format(seed=7, c='c_name')} % 5)::INTEGER AS fold FROM customer")
def fold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "customer").select("c_custkey", S.fold(F.col("c_name"), 5, 7).alias("fold"))


_KEYS, _SEMANTIC = ["brand", "type", "size", "type code"], {"brand", "type"}


@query("filter_values", r"""WITH p AS (SELECT p_partkey, '  ' || replace(lower(p_name || ' brand ' || p_brand || ' type code ' || p_size || ' type ' || p_type || ' size ' || p_size), ' ', '  ') || '  ' AS t FROM part),
m AS (SELECT p_partkey, regexp_replace(t, ' (type  code|brand|size|type) ', chr(1) || '\1' || chr(2), 'g') AS m FROM p),
s AS (SELECT p_partkey, string_split(m, chr(1)) AS s FROM m),
v AS (SELECT p_partkey, list_filter([trim(s[1])] || list_transform(list_filter(s[2:], lambda x: split_part(x, chr(2), 1) IN ('brand', 'type')), lambda x: trim(split_part(x, chr(2), 2))), lambda x: x <> '') AS v FROM s)
SELECT p_partkey, replace(array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ' ; '), '  ', ' ') AS filter_text FROM v""")
def filter_values(spark: SparkSession, sf: str) -> DataFrame:
    p = R.table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    text = F.concat_ws(" ", "p_name", F.lit("brand"), "p_brand", F.lit("type code"), size, F.lit("type"), "p_type", F.lit("size"), size)
    return p.select("p_partkey", X.filter_values(text, _KEYS, _SEMANTIC).alias("filter_text"))


def _first(c: str, n: int) -> str:
    return f"array_to_string(string_split({R.norm(c)}, ' ')[1:{n}], ' ')"


@query("doc_templates", f"""WITH {R.CORPUS} SELECT item_id,
 md5('товар: ' || {R.norm('title')} || ' категория: ' || {R.norm('category')} || ' параметры: ' || {_first('params', 40)} || ' описание: ' || {_first('description', 48)}) AS item_md5,
 md5(array_to_string(list_filter([{R.norm('title')}, {_first('params', 40)}, {_first('description', 48)}], lambda x: x <> ''), '. ')) AS compact_md5,
 md5(array_to_string(list_filter([{R.norm('title')}, {R.norm("left(description, 400)")}], lambda x: x <> ''), '. ')) AS brief_md5,
 md5('запрос: ' || {R.norm('title')} || CASE WHEN {R.norm('params')} <> '' THEN ' фильтры: ' || {R.norm('params')} ELSE '' END || CASE WHEN {R.norm('category')} NOT IN ('', '0') THEN ' категория: ' || {R.norm('category')} ELSE '' END) AS query_md5 FROM corpus""")
def doc_templates(spark: SparkSession, sf: str) -> DataFrame:
    t, c, p, d = (F.col(x) for x in ("title", "category", "params", "description"))
    md5 = lambda x: F.md5(x.cast("binary"))
    return R.corpus(spark, sf).select(
        "item_id", md5(X.item_text(t, c, p, d)).alias("item_md5"), md5(X.compact_text(t, p, d)).alias("compact_md5"),
        md5(X.title_description(t, d)).alias("brief_md5"), md5(X.query_text(t, p, c)).alias("query_md5"),
    )


@query("json_filter_atoms", "SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(json_keys(props), lambda k: 'filter_' || k || ' ' || json_extract_string(props, k)))), ' | ') AS atoms FROM events")
def json_filter_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "events").select("event_id", F.array_join(S.filter_atoms(F.col("props")), " | ").alias("atoms"))


_NESTED = """'{"Color  Name":"  Deep ' || p_brand || ' ","size":{"Value":' || p_size || ',"deep":{"x":{"y":[1,"' || p_type || '",null,true,{"z":{"w":[["q"]]}}]}}},"list":[{"k":"a"},{"k":"B"},["c"]],"empty":"","nul":null}'"""
_WALK = f"""p AS (SELECT p_partkey, p_size, {_NESTED} AS j FROM part), w AS (SELECT p_partkey, t.fullkey AS f, t.type AS kind, t.atom AS atom FROM p, json_tree(p.j) t),
a AS (SELECT p_partkey, replace(lower(regexp_replace(trim(array_to_string(string_split(replace(regexp_replace(substr(f, 2), '\\[[0-9]+\\]', '', 'g'), '"', ''), '.'), '_'), '_'), '\\s+', ' ', 'g')), ' ', '_') AS path, trim(regexp_replace(lower(atom::JSON->>'$'), '\\s+', ' ', 'g')) AS v FROM w WHERE kind NOT IN ('OBJECT', 'ARRAY', 'NULL')),
x AS (SELECT p_partkey, list_sort(list_distinct(list('filter_' || path || ' ' || v))) AS atoms FROM a WHERE v <> '' GROUP BY 1)"""


@query("json_filter_atoms_nested", f"WITH {_WALK} SELECT p_partkey, array_to_string(atoms, ' | ') AS atoms FROM x")
def json_filter_atoms_nested(spark: SparkSession, sf: str) -> DataFrame:
    j = F.expr(_NESTED)
    return R.table(spark, sf, "part").select("p_partkey", F.array_join(S.filter_atoms(j), " | ").alias("atoms"))


@query("category_query_texts", f"""WITH {_WALK} SELECT p.p_partkey, lower(p_name) || CASE p.p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' | filter_ not json' ELSE ' | ' || array_to_string(atoms, ' | ') END || CASE p.p_size % 2 WHEN 0 THEN '' ELSE ' | category_' || lower(p_brand) END AS t
 FROM part JOIN p USING (p_partkey) JOIN x USING (p_partkey)""")
def category_query_texts(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    filters = F.when(size % 3 == 0, "").when(size % 3 == 1, " Not  JSON").otherwise(F.expr(_NESTED))
    category = F.when(size % 2 == 0, F.when(size % 4 == 0, "0").otherwise("")).otherwise(F.col("p_brand"))
    return R.table(spark, sf, "part").select("p_partkey", S.category_query_text(F.col("p_name"), filters, category).alias("t"))


@query("filter_values_special_keys", r"""WITH p AS (SELECT p_partkey, 'wide c++ ' || lower(p_brand) || ' size (cm) ' || p_size || ' c++ ' || p_size || ' a.b ' || lower(p_type) AS t FROM part)
SELECT p_partkey, 'wide ; ' || lower(p_brand) || CASE WHEN lower(p_brand) = p_size::VARCHAR THEN '' ELSE ' ; ' || p_size END || CASE WHEN lower(p_type) IN (lower(p_brand), p_size::VARCHAR) THEN '' ELSE ' ; ' || lower(p_type) END AS filter_text FROM part""")
def filter_values_special_keys(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat_ws(" ", F.lit("wide c++"), "p_brand", F.lit("size (cm)"), size, F.lit("c++"), size, F.lit("a.b"), "p_type")
    return R.table(spark, sf, "part").select("p_partkey", X.filter_values(text, ["c++", "size (cm)", "a.b", "axb"], {"c++", "a.b"}).alias("filter_text"))


@query("content_spans", """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS b, p_name AS n, p_type AS t FROM part)
SELECT p_partkey, 'name:0-' || length(n) || CASE WHEN b = '' THEN '' ELSE ',brand:' || (length(n) + 1) || '-' || (length(n) + 1 + length(b)) END || ',type:' || (length(n) + 1 + CASE WHEN b = '' THEN 0 ELSE length(b) + 1 END) || '-' || (length(n) + 1 + CASE WHEN b = '' THEN 0 ELSE length(b) + 1 END + length(t)) AS spans FROM p""")
def content_spans(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand"))
    spans = X.content_spans([("name", F.col("p_name")), ("brand", brand), ("type", F.col("p_type"))])
    named = F.transform(spans, lambda s: F.concat(s["name"], F.lit(":"), s["start"], F.lit("-"), s["end"]))
    return R.table(spark, sf, "part").select("p_partkey", F.array_join(named, ",").alias("spans"))


def _tfidf(grams: str) -> str:
    return f"""WITH d AS (SELECT doc_id, {_N} AS n FROM documents), g AS ({grams}),
tf AS (SELECT doc_id, g, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT g, count(*) AS df FROM tf GROUP BY g HAVING count(*) >= 2),
w AS (SELECT doc_id, tf.g, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.g = df.g)
SELECT doc_id, count(*) AS n_terms, round(sum(w * w), 4) AS norm2, round(max(w) / sqrt(sum(w * w)), 6) AS top_weight FROM w GROUP BY doc_id"""


def _tfidf_rows(d: DataFrame, grams: Column) -> DataFrame:
    """Sizes and norms of the documents' vectors."""
    rows = tfidf.vectors(d.select("doc_id", grams.alias("grams")), "doc_id", "grams", least=2)
    norm = F.sum(F.col("w") * F.col("w"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(norm, 4).alias("norm2"), F.round(F.max("w") / F.sqrt(norm), 6).alias("top_weight"))


@query("tfidf_word", _tfidf(f"""SELECT doc_id, unnest(t || CASE WHEN len(t) >= 2 THEN list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END) AS g FROM (SELECT doc_id, {R.toks('n')} AS t FROM d)"""))
def tfidf_word(spark: SparkSession, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").repartition("doc_id")  # texts are shipped, not their grams
    cut = d.select("doc_id", X.tokens(X.normalize(F.col("text"))).alias("t"))
    return _tfidf_rows(cut, X.word_ngrams(F.col("t"), 1, 2))


@query("tfidf_char_wb", _tfidf("""SELECT doc_id, unnest(list_transform(generate_series(1, length(w) - k + 1), lambda i: substr(w, i, k))) AS g
 FROM (SELECT doc_id, ' ' || unnest(list_filter(string_split(n, ' '), lambda x: x <> '')) || ' ' AS w FROM d), (VALUES (2), (3), (4)) AS s(k) WHERE length(w) >= k"""))
def tfidf_char_wb(spark: SparkSession, sf: str) -> DataFrame:
    d = R.table(spark, sf, "documents").repartition("doc_id")
    return _tfidf_rows(d, X.char_ngrams(X.normalize(F.col("text")), 2, 4))


@query("token_quantiles", f"""WITH d AS (SELECT lang, len({R.toks(_N)})::DOUBLE AS n FROM documents)
SELECT lang, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, count(*) AS n_docs, round(avg(least(n, 128) / greatest(n, 1)), 6) AS retained FROM d GROUP BY lang""")
def token_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.evaluation import quantiles

    d = R.table(spark, sf, "documents").select("lang", F.size(X.tokens(X.normalize(F.col("text")))).cast("double").alias("n"))
    kept = d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.least("n", F.lit(128.0)) / F.greatest("n", F.lit(1.0))), 6).alias("retained"))
    return quantiles(d, "n", ["lang"], [0.1, 0.5, 0.9, 0.99]).join(kept, "lang")


@query("haversine", f"""WITH {R.PLACES}, c AS (SELECT place, median(lat) AS lat, median(lon) AS lon FROM places GROUP BY place)
SELECT a.place AS a, b.place AS b, round(2 * 6371.0088 * asin(sqrt(least(greatest(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 0.0), 1.0))), 4) AS km FROM c a, c b""")
def haversine(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.geo import centres

    c = centres(R.places(spark, sf))
    a, b = (c.select(F.col("place").alias(x), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")) for x in "ab")
    km = S.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return a.crossJoin(b).select("a", "b", F.round(km, 4).alias("km"))  # places: a small dimension


@query("log_loss", """WITH r AS (SELECT l_returnflag AS f, (l_linestatus = 'O')::INTEGER AS y, least(greatest(l_discount * 5 + l_tax, 1e-6), 1 - 1e-6) AS p, l_quantity AS w FROM lineitem)
SELECT f AS flag, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss, round(sum(w * -(y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 6) AS weighted_loss FROM r GROUP BY f""")
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    y, p, w = F.when(F.col("l_linestatus") == "O", 1).otherwise(0), F.col("l_discount") * 5 + F.col("l_tax"), F.col("l_quantity")
    loss = S.log_loss(y, p)
    return R.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.round(F.avg(loss), 6).alias("loss"), F.round(F.sum(w * loss) / F.sum(w), 6).alias("weighted_loss"),
    )


@query("logit_mix", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(greatest(l_discount * 5, 1e-6), 1 - 1e-6) AS p, greatest(l_tax, 1e-4) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(p / (1 - p)), 6) AS a0, round(ln(p / (1 - p)) + 0.1 * ln(q), 6) AS a10, round(ln(p / (1 - p)) + 0.25 * ln(q), 6) AS a25 FROM r""")
def logit_mix(spark: SparkSession, sf: str) -> DataFrame:
    p, q = F.col("l_discount") * 5, F.col("l_tax")
    return R.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *(F.round(S.logit_mix(p, q, a), 6).alias(n) for n, a in (("a0", 0.0), ("a10", 0.1), ("a25", 0.25)))
    )


@query("entropy_features", """WITH s AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, list(n / t ORDER BY l_returnflag) AS p FROM (SELECT *, sum(n) OVER (PARTITION BY l_orderkey) AS t FROM s) GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN len(p) > 1 THEN list_sum(list_transform(p, lambda x: -x * ln(x))) / ln(len(p)) ELSE 0 END, 6) AS entropy, round(list_sum(list_reverse_sort(p)[1:2]), 6) AS top2 FROM p""")
def entropy_features(spark: SparkSession, sf: str) -> DataFrame:
    s = R.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("l_orderkey"))
    p = s.withColumn("share", share).groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_returnflag", "share"))), lambda x: x["share"]).alias("p")
    )
    return p.select("l_orderkey", F.round(S.entropy(F.col("p")), 6).alias("entropy"), F.round(S.top_mass(F.col("p"), 2), 6).alias("top2"))


@query("number_parse", """SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 ELSE v END AS num FROM (SELECT event_id, try_cast(CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'NaN' WHEN 2 THEN '' ELSE value::VARCHAR END AS DOUBLE) AS v FROM events)""")
def number_parse(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 5
    text = F.when(m == 0, F.col("event_type")).when(m == 1, "NaN").when(m == 2, "").otherwise(F.col("value").cast("string"))
    return R.table(spark, sf, "events").select("event_id", S.number(text).alias("num"))
