"""Exact vector search in blocks, and scoring of given pools."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import storage
from ..functions import scalar as S
from ..functions import text as X
from ..shipping import ship

BLOCK = 4096
#: Queries of a block scored at once; with BLOCK it bounds the matrix of scores to 16 MB.
STRIPE = 512


def key_type(df: DataFrame, key: str) -> T.DataType:
    return T.StringType() if isinstance(df.schema[key].dataType, T.StringType) else T.LongType()


def packed(vectors: DataFrame, key: str, vector: str, group: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(ids, groups, data, width): unit vectors of at most ``block`` rows each, packed; null and zero vectors stay out.

    Ids are strings if the key is one, else whole numbers.
    """
    ship(vectors.sparkSession)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        held = 0

        def made(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            rows = rows.sort_values("g", kind="stable")
            for at in range(0, len(rows), block):
                part = rows.iloc[at : at + block]
                data = np.stack(part["v"].to_list()).astype(np.float64)
                norm = np.linalg.norm(data, axis=1)
                ok = norm > 0
                if ok.any():
                    yield pd.DataFrame(
                        {
                            "ids": [part["k"].to_numpy()[ok]], "groups": [part["g"].to_numpy()[ok]],
                            "data": [(data[ok] / norm[ok, None]).tobytes()], "width": [data.shape[1]],
                        }
                    )

        for rows in batches:  # blocks are full whatever size the batches come in
            rows = rows[rows["v"].notna()]
            waiting.append(rows)
            held += len(rows)
            if held >= block:
                yield from made(pd.concat(waiting))
                waiting, held = [], 0
        if held:
            yield from made(pd.concat(waiting))

    kind = key_type(vectors, key)
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kind)), T.StructField("groups", T.ArrayType(T.LongType())),
            T.StructField("data", T.BinaryType()), T.StructField("width", T.IntegerType()),
        ]
    )
    one = F.lit(0) if group is None else F.coalesce(group, F.lit(-1))
    return vectors.select(F.col(key).cast(kind).alias("k"), one.cast("long").alias("g"), F.col(vector).alias("v")).mapInPandas(run, schema)


def _best(near: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row, ties at the edge by the smaller id; at most a few more than k a row before the cut."""
    if near.shape[1] > k:
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero(near >= edge[:, None])
    else:
        row, col = np.divmod(np.arange(near.size), near.shape[1])
    order = np.lexsort((ids[col], -near[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def cosine_top_k(
    queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = False,
    group: Column | None = None,
) -> DataFrame:
    """(qid, item_id, score, rank): the k most similar rows of the corpus to each query, exactly.

    With ``group``, a whole-number expression over the corpus, the k of each
    group (null is one), and a column ``grp``.  With ``skip_self``, for queries
    that are rows of the corpus, a row isn't its own answer.  The queries are a
    given set, not the corpus itself: each of their blocks meets every block
    of the corpus; up to BLOCK queries are broadcast.  Each meeting is one matrix product, stripe by stripe, and
    gives at most k rows a query and group, so only those are shuffled.
    """
    q = packed(queries, key, vector).select(F.col("ids").alias("q_ids"), F.col("data").alias("q"), "width")
    c = packed(corpus, key, vector, group).select("ids", "groups", "data")
    if storage.small_enough(queries, BLOCK):  # else rows of the corpus would be packed anew for each partition of queries
        q = F.broadcast(q)
    more = k + 1 if skip_self else k

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                left, right = (np.frombuffer(d).reshape(-1, r.width) for d in (r.q, r.data))
                q_ids, ids, groups = np.asarray(list(r.q_ids)), np.asarray(list(r.ids)), np.asarray(r.groups)
                starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
                for at in range(0, len(q_ids), STRIPE):
                    near, own = np.round(left[at : at + STRIPE] @ right.T, 6) + 0.0, q_ids[at : at + STRIPE]
                    for low, high in zip(starts, np.r_[starts[1:], len(groups)], strict=True):
                        row, col = _best(near[:, low:high], ids[low:high], more)
                        out = pd.DataFrame({"qid": own[row], "item_id": ids[low + col], "grp": groups[low], "score": near[row, low + col]})
                        yield out[out["qid"] != out["item_id"]] if skip_self else out

    names = {"qid": key_type(queries, key), "item_id": key_type(corpus, key), "grp": T.LongType(), "score": T.DoubleType()}
    found = q.crossJoin(c).mapInPandas(run, T.StructType([T.StructField(n, t) for n, t in names.items()]))
    rank = F.row_number().over(Window.partitionBy("qid", "grp").orderBy(F.desc("score"), "item_id")).cast("long")
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.drop("grp") if group is None else best


def channel(queries: DataFrame, items: DataFrame, query_vectors: DataFrame, item_vectors: DataFrame, k: int, order: int = 0, weight: float = 1.0) -> DataFrame:
    """The channel ``dense`` of the long table: the k most similar items of each query that has a text.

    ``query_vectors`` (text, embedding) are found by normalised text,
    ``item_vectors`` (item_id, embedding) by id; of repeated rows the least
    counts.  A query with text or an item without a vector is an error: its
    answers would be missing.
    """
    normal = X.normalize(F.col("text"))
    q = queries.select(F.col("qid").alias("own"), normal.alias("nt")).where("nt <> ''").distinct()
    known = query_vectors.where("embedding IS NOT NULL").groupBy(normal.alias("nt")).agg(F.min("embedding").alias("embedding"))
    q = q.join(known, "nt", "left").select("own", "embedding")
    held = item_vectors.where("embedding IS NOT NULL").groupBy("item_id").agg(F.min("embedding").alias("embedding"))
    i = items.select("item_id").distinct().join(held, "item_id", "left").select(F.col("item_id").alias("own"), "embedding")
    for name, rows in (("queries", q), ("items", i)):
        if missing := rows.where("embedding IS NULL").count():
            raise ValueError(f"{missing} {name} have no vector")
    found = cosine_top_k(q, i, k, "own", skip_self=False)
    return found.select(
        "qid", F.lit("dense").alias("channel"), F.lit(order).alias("ch_ord"), F.lit(weight).alias("weight"), "item_id", "rank",
        F.col("score").alias("raw_score"),
    )


def score_pool(pool: DataFrame, queries: DataFrame, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Cosine of each (qid, item_id) of a pool, by two equi-joins."""
    q = queries.select(F.col(key).alias("qid"), F.col(vector).alias("qv"))
    c = corpus.select(F.col(key).alias("item_id"), F.col(vector).alias("iv"))
    return pool.join(q, "qid").join(c, "item_id").select("qid", "item_id", F.round(S.cosine(F.col("qv"), F.col("iv")), 6).alias("score"))
