"""Which tables play which part: corpus, queries, truth, clicks, vectors — as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import storage
from ..functions import text as X
from ..operators import bm25
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small file with work for every core is dealt out; a table of many splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, language the category, source the place."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.substring_index(text, "\n", 1).alias("title"), F.concat(
            F.lit("lang "), "lang", F.lit(" source "), "source",
        ).alias("params"),
        text.alias("description"), F.col("lang").alias("category"), F.col("source").alias("location"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", F.concat(F.lit("src"), F.col("item_id") % 20).alias("location"))


_stored: dict[tuple[str, str, str], object] = {}


def once[T](spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """A table, or a search with its own, that is made once for a session and a folder of tables, as an index is, and then read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


#: The three fields and two of stems (of texts without Russian words, so that stems are the words).
FIELDS = (*bm25.FIELDS, bm25.Field("title_stem", 1.0, 0.2, 0.5), bm25.Field("params_stem", 1.2, 0.7, 0.25))
STEMS = {"title_stem": "title", "params_stem": "params"}


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored counts of the corpus's fields and stems."""
    return once(spark, sf_dir, "index", lambda: bm25.counted(corpus(spark, sf_dir), FIELDS, STEMS))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, item_id): documents whose normalised text contains the query's, found once."""

    def make() -> DataFrame:
        with storage.splits(spark, bm25.SPLIT):
            return storage.stored(contained(queries(spark, sf_dir), corpus(spark, sf_dir)), "truth")

    return once(spark, sf_dir, "truth", make)


#: Words of a run by which texts find each other; queries have to have two more, as their first and last may be parts of words.
RUN = 5


def contained(q: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, item_id) where an item's normalised description contains the query's normalised text.

    All words of a query but the first and last are whole words wherever its
    text occurs, so a run of them finds the candidates; runs are as long as
    the query allows, RUN at most.  Where the queries are few enough, they go
    to every task and texts meet them where they are read (``_Runs``); else
    runs are joined by a shuffle.  Queries of one or two words, which have no
    inner word, are compared with every item; queries are a set of their own,
    given beforehand, and don't grow with the items.
    """
    q = q.select("qid", X.normalize(F.col("text")).alias("qt")).where("qt <> ''")
    if storage.small_enough(q, FEW):
        return _found_where_read(q, items)
    q = q.withColumn("w", F.split("qt", " "))
    d = items.select("item_id", X.normalize(F.col("description")).alias("dt"))
    inner = q.where("size(w) >= 3").withColumn("n", F.least(F.size("w") - 2, F.lit(RUN)))
    keys = inner.select("qid", "qt", "n", F.expr("array_join(slice(w, 2, n), ' ')").alias("k"))
    lengths = [r["n"] for r in keys.select("n").distinct().collect()]  # at most RUN rows
    found = None
    for n in sorted(lengths):
        own = keys.where(F.col("n") == n).select("qid", "qt", "k")
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
        cut = d.withColumn("w", F.split("dt", " ")).where(F.size("w") >= n)
        one = cut.select("item_id", F.explode(F.array_distinct(runs)).alias("k")).join(own, "k").join(d, "item_id")
        one = one.where(F.contains("dt", F.col("qt"))).select("qid", "item_id")
        found = one if found is None else found.unionByName(one)
    short = q.where("size(w) < 3").select("qid", "qt")
    if not short.isEmpty():
        one = d.join(F.broadcast(short), F.contains("dt", F.col("qt"))).select("qid", "item_id")
        found = one if found is None else found.unionByName(one)
    return q.select("qid", F.lit(None).alias("item_id")).limit(0) if found is None else found.distinct()


class _Runs:
    """Runs of the queries' inner words, by length and hash, and texts of queries without any."""

    def __init__(self, texts: list[str]) -> None:
        known: dict[str, int] = {}
        self.texts = texts
        self.short: list[int] = []
        runs: dict[int, dict[int, list[int]]] = {}
        for i, text in enumerate(texts):
            own = text.split(" ")[1:-1][:RUN]
            if own:
                code = np.array([known.setdefault(w, len(known)) for w in own], np.int64)
                runs.setdefault(len(own), {}).setdefault(int(self.hashed(code, len(own))[0]), []).append(i)
            else:
                self.short.append(i)
        self.runs, self.known = runs, pa.array(list(known), pa.large_string())
        self.word = ~np.array([chr(i).isspace() for i in range(0x110000)])
        self.keys = {n: np.sort(np.fromiter(r, np.int64, len(r))) for n, r in runs.items()}

    @staticmethod
    def hashed(code: np.ndarray, n: int) -> np.ndarray:
        """A number for each window of n."""
        size = max(0, len(code) - n + 1)
        out = np.zeros(size, np.int64)
        for i in range(n):
            out = out * 6364136223846793005 + code[i : i + size] + 1
        return out

    def found(self, texts: pa.Array) -> tuple[list[int], list[int]]:
        """(query, text) where the text, its white space collapsed, contains the query's."""
        words = bm25.Tokens([texts], self.word)  # on the same white space as ``X.normalize``
        ends = np.cumsum(words.counts + 1)
        code = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)  # -1 also parts texts
        own = pc.fill_null(pc.index_in(words.each, value_set=self.known), -1).to_numpy()
        code[np.arange(len(own)) + np.repeat(np.arange(len(texts)), words.counts)] = own
        met = {(q, t) for q in self.short for t in range(len(texts))}
        for n, keys in self.keys.items():
            h = self.hashed(code, n)
            whole = np.ones(len(h), bool)
            for i in range(n):
                whole &= code[i : i + len(h)] >= 0
            at = np.flatnonzero(whole)
            at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
            for t, k in set(zip(np.searchsorted(ends, at, "right").tolist(), h[at].tolist(), strict=True)):
                met.update((q, t) for q in self.runs[n][k])
        normal = {t: " ".join(texts[t].as_py().split()) for t in {t for _, t in met}}
        kept = sorted((q, t) for q, t in met if self.texts[q] in normal[t])
        return [q for q, _ in kept], [t for _, t in kept]


#: Up to so many queries go to every task to be found in texts; texts that are searched at once.
FEW, PART = 50_000, 256


def _found_where_read(q: DataFrame, items: DataFrame) -> DataFrame:
    ship(items.sparkSession)
    rows = [(r["qid"], r["qt"]) for r in q.collect()]  # at most FEW
    sent = items.sparkSession.sparkContext.broadcast((pa.array([i for i, _ in rows], to_arrow_type(q.schema["qid"].dataType)), [t for _, t in rows]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = sent.value
        runs = _Runs(texts)
        for batch in batches:
            for low in range(0, batch.num_rows, PART):
                part = batch.slice(low, PART)
                own, at = runs.found(part.column("dt"))
                if own:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), part.column("item_id").take(pa.array(at))], ["qid", "item_id"])

    schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("item_id", items.schema["item_id"].dataType)])
    return items.select("item_id", X.folded(F.col("description")).alias("dt")).mapInArrow(run, schema).distinct()


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a click log: part names are texts, nations places, brands categories, suppliers items."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.col("p_name").alias("text"), F.col("c_nationkey").alias("search_loc"), F.col("s_nationkey").alias("item_loc"),
        F.col("p_brand").alias("cat"), F.col("l_suppkey").alias("item_id"), F.col("p_type").alias("context"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with coordinates derived from their nation."""
    n = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        n.alias("place"), ((n * 7) % 180 - 90).cast("double").alias("lat"), ((n * 13) % 360 - 180).cast("double").alias("lon"),
    )


def norm(c: str) -> str:
    return rf"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ё', 'е'), '\s+', ' ', 'g'))"


def toks(c: str) -> str:
    return rf"regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+')"


CORPUS = "corpus AS (SELECT doc_id AS item_id, split_part(coalesce(text, ''), chr(10), 1) AS title, 'lang ' || lang || ' source ' || source AS params, coalesce(text, '') AS description, lang AS category, source AS location FROM documents)"
QUERY_ROWS = "queries AS (SELECT item_id AS qid, text, 'src' || (item_id % 20) AS location FROM benchmark)"
TRUTH = f"""truth AS (SELECT qid, item_id FROM (SELECT qid, {norm('text')} AS qt FROM queries) JOIN (SELECT item_id, {norm('description')} AS dt FROM corpus) ON qt <> '' AND contains(dt, qt))"""
CLICKS = "clicks AS (SELECT p_name AS text, c_nationkey AS search_loc, s_nationkey AS item_loc, p_brand AS cat, l_suppkey AS item_id, p_type AS context FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"
PLACES = "places AS (SELECT s_nationkey AS place, ((s_nationkey * 7) % 180 - 90)::DOUBLE AS lat, ((s_nationkey * 13) % 360 - 180)::DOUBLE AS lon FROM supplier)"
BM25 = f"""{CORPUS}, {QUERY_ROWS},
terms AS (SELECT DISTINCT qid, unnest({toks(norm('text'))}) AS term FROM queries),
stack AS (SELECT 'title' AS field, item_id AS doc, {toks(norm('title'))} AS t FROM corpus
  UNION ALL SELECT 'params', item_id, {toks(norm('params'))} FROM corpus UNION ALL SELECT 'description', item_id, {toks(norm('description'))} FROM corpus),
stats AS (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM stack GROUP BY field),
tf AS (SELECT field, doc, dl, term, count(*) AS tf FROM (SELECT field, doc, len(t) AS dl, unnest(t) AS term FROM stack) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
par(field, k1, b, weight, ch_ord) AS (VALUES ('title', 1.0::DOUBLE, 0.2::DOUBLE, 2.0::DOUBLE, 0), ('params', 1.2::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE, 1), ('description', 1.0::DOUBLE, 0.8::DOUBLE, 0.5::DOUBLE, 2)),
post AS (SELECT field, term, doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) AS w FROM tf JOIN df USING (field, term) JOIN stats USING (field) JOIN par USING (field)),
sc AS (SELECT field, qid, doc, round(sum(w), 6) AS score FROM post JOIN terms USING (term) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY field, qid ORDER BY score DESC, doc) AS rank FROM sc),
ch AS (SELECT qid, field AS channel, ch_ord, weight, doc AS item_id, rank, score AS raw_score FROM rk JOIN par USING (field) WHERE rank <= 50)"""
FUSED = BM25 + """,
fused AS (SELECT qid, item_id, round(sum(weight / (60 + rank)), 9) AS score, min(rank) AS head FROM ch GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id) AS fr FROM fused),
firsts AS (SELECT qid, item_id, min((ch_ord, rank)) AS ord FROM ch GROUP BY ALL),
pool AS (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY ord, item_id) AS pool_rank FROM firsts)"""
