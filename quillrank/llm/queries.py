"""The queries opN_<name>: each operator over its whole table with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, exact_dedup, language_model, line_dedup, near_dedup, packing, quality, secret_scan, sharding, token_counts

#: Fixed values of the contracts.
TOKEN_LIMIT, SEQUENCE, END_ID, SHARDS, LINE_DOCUMENTS, KEEP = 4096, 2048, 1, 24, 10, 0.3


def op1_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"), count("crf"),
    )


def op2_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir).select("doc_id", "text"), SHARDS)


def op3_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    out = language_model.score(common.documents(spark, sf_dir).select("doc_id", "text"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return quality.score(docs, model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(common.documents(spark, sf_dir).select("doc_id", "text"))


def op6_bbit_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.documents(spark, sf_dir).select("doc_id", "text"))


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(
        docs, public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT,
    ).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op8_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE)


def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_line_runs_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(common.documents(spark, sf_dir).select("doc_id", "text"), LINE_DOCUMENTS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES = {
    "op9_winnowing_decontamination": r"""
WITH low AS (SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
item AS (SELECT id, w, least(10, len(w)) AS n FROM w WHERE kind = 'b' AND len(w) > 0),
bench AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM item)),
sizes AS (SELECT DISTINCT n FROM item),
docs AS (SELECT id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, sizes WHERE kind = 'd' AND len(w) >= n)),
hit AS (SELECT d.id, d.i, d.n, b.id AS item FROM docs d JOIN bench b ON d.n = b.n AND d.win = b.win),
words AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM hit) GROUP BY id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON words.id = w.id LEFT JOIN items ON items.id = w.id WHERE w.kind = 'd'
""",
    "op5_content_sort_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
""",
    "op6_bbit_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
c AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, min(doc_id) AS rep, any_value(s) AS s, any_value(len(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
x AS (SELECT rep, n, unnest(s) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, to_) AS (SELECT rep, rep FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_ WHERE e.b <> r.to_),
k AS (SELECT node, min(to_) AS comp FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.comp, s.doc_id) AS component_id, coalesce(k.comp, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.c = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN k ON k.node = c.rep
""",
    "op10_line_runs_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
