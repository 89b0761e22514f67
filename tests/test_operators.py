"""Operators on hand-made cases and against plain implementations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillrank.functions import scalar as S
from quillrank.functions import text as X
from quillrank.operators import bm25, category, evaluation, features, fusion, geo, learning, protocol, stemming
from quillrank.sources import sinks, tables
from quillrank.streaming import ingest


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, X.normalize(F.col("t")), t="  Ёлка\tи\x1cдом ") == "елка и дом"
    assert one(spark, X.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, X.tokens(F.col("t")), t="a-b_c 1,2") == ["a", "b_c", "1", "2"]
    assert one(spark, X.bigrams(X.tokens(F.col("t"))), t="a b a b") == ["a b", "b a"] and one(spark, X.bigrams(X.tokens(F.col("t"))), t="a") == []
    assert one(spark, X.word_ngrams(X.tokens(F.col("t")), 1, 3), t="a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, X.char_ngrams(F.col("t"), 2, 4), t="ab") == [" a", "ab", "b ", " ab", "ab ", " ab "]
    assert one(spark, X.filter_values(F.col("t"), ["type", "type code", "size"], {"type"}), t="red type code 5 type big size 3 type big") == "red ; big"
    assert one(spark, X.filter_values(F.col("t"), ["type"], {"type"}), t="no key") == "no key"
    assert one(spark, X.rating_floor(F.col("t")), t="рейтинг пользователя 4,5 и выше") == 4.5 and one(spark, X.rating_floor(F.lit("x"))) is None
    assert one(spark, X.query_text(F.lit("A"), F.lit(""), F.lit("0"))) == "запрос: a"
    with pytest.raises(ValueError):
        X.first_words(F.lit("a"), -1)


def test_scalars(spark):
    for v, want in (("1.5", 1.5), ("NaN", 0.0), ("inf", 0.0), ("x", 0.0), (None, 0.0)):
        assert one(spark, S.number(F.lit(v).cast("string"))) == want
    assert one(spark, S.filter_atoms(F.lit('{"b": {"c": [2, 1, 2]}, "a": null, "d": true}'))) == ["filter_b_c 1", "filter_b_c 2", "filter_d true"]
    assert one(spark, S.filter_atoms(F.lit("bad"))) == []
    assert abs(one(spark, S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - math.pi * S.EARTH_KM) < 1e-6
    assert one(spark, S.entropy(F.array(F.lit(0.5), F.lit(0.5)))) == 1.0 and one(spark, S.entropy(F.array(F.lit(1.0)))) == 0.0


def test_bm25_by_hand(spark):
    items = spark.createDataFrame([(1, "cat"), (2, "cat dog owl"), (3, "...")], "item_id long, title string")
    q = spark.createDataFrame([(7, "Cat cat"), (8, "...")], "qid long, text string")
    field = (bm25.Field("title", 1.5, 0.75, 1.0),)
    got = {(r["qid"], r["item_id"]): r["raw_score"] for r in bm25.retrieve(items, q, 5, field).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 4 / 3
    weight = lambda dl: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {(7, 1): round(weight(1), 6), (7, 2): round(weight(3), 6)}
    assert bm25.retrieve(items.limit(0), q, 5, field).count() == 0


def plain_fusion(lists, limit, constant, quota):
    scores, head = {}, {}
    for items, weight in lists:
        for rank, i in enumerate(items, 1):
            scores[i] = scores.get(i, 0) + weight / (constant + rank)
            head[i] = min(head.get(i, rank), rank)
    scores = {i: round(s, 9) for i, s in scores.items()}
    order = sorted(scores, key=lambda i: (-scores[i], i))
    chosen = order[:limit]
    wanted = [i for i in order[limit:] if head[i] <= quota]
    for i in wanted:
        free = [j for j in chosen if head[j] > quota]
        if not free:
            break
        chosen.remove(free[-1])
        chosen = sorted([*chosen, i], key=lambda i: (-scores[i], i))
    return chosen


def test_fusion_against_lists(spark):
    r, rows, want = random.Random(3), [], {}
    for qid in range(40):
        lists = [(r.sample(range(30), r.randint(0, 12)), w) for w in (2.0, 1.0, 0.5)]
        rows += [(qid, f"c{c}", c, w, i, rank) for c, (items, w) in enumerate(lists) for rank, i in enumerate(items, 1)]
        want[qid] = [plain_fusion(lists, 6, 10, quota) for quota in (0, 2)]
    ch = spark.createDataFrame(rows, "qid long, channel string, ch_ord int, weight double, item_id long, rank long")
    scores = fusion.fused_scores(ch, 10)
    for k, quota in enumerate((0, 2)):
        got = {}
        for row in fusion.fuse(scores, 6, quota).orderBy("qid", "rank").collect():
            got.setdefault(row["qid"], []).append(row["item_id"])
        assert got == {q: w[k] for q, w in want.items() if w[k]}


def test_fill_keeps_raw_ranks(spark):
    base = spark.createDataFrame([(1, 10)], "qid long, item_id long")
    route = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid long, item_id long, rank long")
    got = fusion.novel_fill(base, route, 2).collect()
    assert [(r["item_id"], r["score"]) for r in got] == [(11, round(1 / 62, 9))]


def test_geography(spark):
    clicks = spark.createDataFrame(
        [("a", "1", "2")] * 3 + [("b", "1", "2")] * 2 + [("b", "1", "3"), ("b", "", "3")],
        "text string, search_loc string, item_loc string",
    )
    counts = geo.associations(clicks)
    left = {(r["text"], r["item_loc"]): r["n"] for r in geo.without_own(counts, geo.associations(clicks, True)).collect()}
    assert left == {("a", "2"): 2, ("a", "3"): 1, ("b", "2"): 3}
    assert [(r["item_loc"], r["rank"]) for r in geo.related(counts, min_history=6).collect()] == [("2", 1), ("3", 2)]
    assert geo.related(counts, min_history=7).count() == 0


def test_category_weights(spark):
    clicks = spark.createDataFrame([("t", "x", "1")] * 10 + [("t", "y", "1"), ("t", "y", "2"), ("u", "x", "1")], "text string, context string, cat string")
    rows = category.fit_weights(clicks).collect()
    assert len(rows) == 4 and abs(sum(r["weight"] for r in rows) - 2) < 1e-9


def test_recall(spark):
    g = spark.createDataFrame([(1, "a", 1, 2), (2, "a", 1, 1), (3, "b", 0, 1), (4, "c", 0, 0)], "qid long, text string, n_hit long, n_available long")
    r = evaluation.recall(g).first()
    assert (r["macro"], r["text_macro"], r["micro"], r["n_queries"]) == (0.5, 0.375, 0.5, 3)


def test_feature_schemas():
    assert [len(features.schema(v)) for v in (3, 4, 5, 6, 7, 8)] == [70, 75, 76, 77, 83, 85]
    assert features.schema(7)[:75] == features.schema(4)
    with pytest.raises(ValueError):
        features.schema(9)


def test_prefix_of_all_trees_is_the_model(spark):
    r = random.Random(1)
    rows = spark.createDataFrame(
        [(i, float(r.random()), float(r.random()), int(r.random() < 0.5), 1.0) for i in range(200)],
        "i long, a double, b double, label int, weight double",
    )
    model = learning.fit_ranker(rows, ["a", "b"], 5, 3)
    both = learning.rank_scores(model, rows).select("i", "prob").join(learning.prefix_scores(model, rows, [2, 5]).select("i", "p5"), "i")
    assert both.where("abs(prob - p5) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        learning.prefix_scores(model, rows, [6])


def test_stems():
    assert [
        stemming.stem(w) for w in ("важная", "важный", "бегала", "красивейший", "столами", "дом", "abc", "")
    ] == ["важн", "важн", "бега", "красив", "стол", "дом", "abc", ""]


def test_bootstrap_holds_the_mean(spark):
    clusters = spark.createDataFrame([(str(i), float(i % 5), 1 + i % 3) for i in range(300)], "cluster string, delta double, n long")
    r = evaluation.bootstrap(clusters, 100).first()
    assert r["low"] < r["point"] < r["high"] and r["replicates"] == 100


def test_islands_over_ranges(spark):
    df = spark.createDataFrame([(i, "a" if i % 100 < 50 else "b") for i in range(1000)], "i long, g string").repartition(7)
    assert {r["g"]: r["islands"] for r in protocol.islands(df, "g", ["i"]).collect()} == {"a": 10, "b": 10}


def test_sources_and_sinks(spark, tmp_path):
    ranked = spark.createDataFrame([("q", "x", 0.5, 1), ("q", "y", 0.25, 2)], "qid string, item_id string, score double, rank long")
    sinks.write_answers(protocol.answers(ranked), f"{tmp_path}/a")
    assert [tuple(r) for r in tables.read_answers(spark, f"{tmp_path}/a").collect()] == [("q", "x y")]
    assert sinks.write_scores(ranked, f"{tmp_path}/s").first()["n"] == 2
    assert tables.read_ranked(spark, f"{tmp_path}/s").count() == 2
    sinks.write_features(ranked, f"{tmp_path}/f", "qid")
    with pytest.raises(Exception, match="exists"):
        sinks.write_features(ranked, f"{tmp_path}/f")
    sinks.write_report(ranked, f"{tmp_path}/r")
    sinks.write_labels(ranked, "item_id", f"{tmp_path}/l")
    assert tables.read_scores(spark, f"{tmp_path}/l", "qid string, item_id string").count() == 2


def test_stream_indexes_each_file_once(spark, tmp_path):
    schema = "item_id long, text string"
    for k in range(2):
        spark.createDataFrame([(k, "a b a")], schema).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.index_stream(spark, f"{tmp_path}/in", schema, f"{tmp_path}/index", f"{tmp_path}/cp").awaitTermination()
    got = sorted((r["item_id"], r["term"], r["tf"]) for r in ingest.read_index(spark, f"{tmp_path}/index").collect())
    assert got == [(0, "a", 2), (0, "b", 1), (1, "a", 2), (1, "b", 1)]


def test_vector_blocks_keep_ties_and_groups(spark):
    import numpy as np
    import pandas as pd

    from quillrank.operators import vectors

    r = np.random.default_rng(3)
    data = r.integers(-2, 3, (300, 4)).astype(float)  # few directions: many ties; zero rows have no direction
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(300), "embedding": data.tolist(), "place": np.arange(300) % 7})).repartition(3)
    got = vectors.cosine_top_k(rows.where("vec_id % 10 = 0"), rows, 4, skip_self=True, group=F.col("place")).collect()
    unit = data / np.maximum(np.linalg.norm(data, axis=1), 1e-12)[:, None]
    live, want = np.flatnonzero(np.abs(data).sum(1)), set()
    for q in (i for i in live if i % 10 == 0):
        for place in range(7):
            pool = sorted((-round(float(unit[q] @ unit[i]), 6), int(i)) for i in live if i % 7 == place and i != q)
            want |= {(int(q), i, place, n + 1) for n, (_, i) in enumerate(pool[:4])}
    assert {(x.qid, x.item_id, x.grp, x.rank) for x in got} == want


def test_label_groups_over_many_ranges(spark):
    from quillrank.operators import integrity

    labels = [0, 0, 1, 1, 0, 1, 0, 0, 1, 0] * 30
    want, grp = [], 0
    for i, y in enumerate(labels):
        grp += i == 0 or (labels[i - 1] == 0 and y == 1)
        want.append((i, grp))
    rows = spark.createDataFrame(list(enumerate(labels)), "i long, y int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = integrity.label_groups(rows, "y", ["i"]).select("i", "grp").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == want
    assert integrity.label_groups(rows.limit(0), "y", ["i"]).count() == 0


def test_rank_and_group_checks_find_faults(spark):
    from quillrank.operators import integrity

    ranks = spark.createDataFrame(
        [("a", 1 / 61), ("a", 1 / 62), ("b", 1 / 61), ("b", 1 / 63), ("c", 1 / 61), ("c", 1 / 61), ("d", 0.0), ("d", None)],
        "k string, v double",
    )
    assert {r.k: r.complete for r in integrity.recovered_ranks(ranks, "v", 60, ["k"]).collect()} == {"a": True, "b": False, "c": False}
    rows = spark.createDataFrame(
        [(1, 1, 1, 1.0), (1, 2, 0, 0.5), (1, 3, 0, 0.5), (2, 1, 1, 1.0), (3, 1, 1, 1.0), (3, 2, 0, 0.9), (4, 1, 1, 1.0), (4, 2, 0, 0.5), (4, 2, 0, 0.5)],
        "qid int, item_id int, label int, weight double",
    )
    assert {r.qid: r.valid for r in integrity.training_groups(rows).collect()} == {1: True, 2: False, 3: False, 4: False}
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 2), (3, None)], [(2, 2), (3, 5), (4, 4)]))
    assert tuple(integrity.alignment(a, b, ["k"], "v").first()) == (1, 1, 2, 1)
