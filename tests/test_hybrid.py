"""Hand-made cases of channels, places, variants, features, samples and models."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrank.functions import scalar as S
from quillrank.functions import text as X
from quillrank.operators import blocks, bm25, category, encode, evaluation, features, geo, hybrid, integrity, learning, protocol, tfidf, variants, vectors
from quillrank.sources import sinks, tables

CHANNEL = "qid string, channel string, ch_ord int, weight double, item_id string, rank long, raw_score double"


def channel(spark, rows):
    return spark.createDataFrame([(q, c, o, w, i, r, 1.0 / r) for q, c, o, w, i, r in rows], CHANNEL)


def items_of(df, *by):
    return [r["item_id"] for r in df.orderBy(*by).collect()]


def test_geographic_channels(spark):
    """Five equal titles, one of them local: the global channel has the first, the local one its own; weights as the fields'."""
    items = spark.createDataFrame(
        [(f"i{k}", "red shoe", "", "", "p1" if k == 4 else "p0") for k in range(5)],
        "item_id string, title string, params string, description string, location string",
    )
    queries = spark.createDataFrame([("a", "red", "p1"), ("b", "red", "")], "qid string, text string, location string")
    plan = hybrid.Plan(depth=1, geo_depth=1)
    index = bm25.build(items)
    terms = bm25.query_terms(queries)
    scored = bm25.scores(index, terms, True)
    none = spark.createDataFrame([], "search_loc string, item_loc string, n long")
    rows = hybrid.lexical_channels(scored, geo.destinations(queries, items, none), items, plan)
    got = {(r["qid"], r["channel"]): (r["item_id"], r["weight"]) for r in rows.collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", "title"): "i0", ("a", "title_geo"): "i4", ("b", "title"): "i0"}
    assert math.isclose(got["a", "title"][1], 2 / 3.5 / 1.25) and math.isclose(
        got["a", "title_geo"][1], 2 / 3.5 / 1.25 / 4,
    ) and math.isclose(got["b", "title"][1], 2 / 3.5)


def test_destinations(spark):
    """The exact place alone; else related ones if the history is long enough; both if asked for; own clicks left out."""
    items = spark.createDataFrame([("x", "city"), ("y", "town"), ("z", "port"), ("w", "")], "item_id string, location string")
    queries = spark.createDataFrame([("a", "t", "city"), ("b", "t", "region"), ("c", "t", ""), ("d", "u", "far")], "qid string, text string, location string")
    counts = spark.createDataFrame(
        [("region", "town", 18), ("region", "port", 12), ("region", "gone", 40), ("city", "town", 25), ("far", "port", 19)],
        "search_loc string, item_loc string, n long",
    )
    got = lambda **k: {(r["qid"], r["place"]) for r in geo.destinations(queries, items, counts, **k).collect()}
    assert got() == {("a", "city"), ("b", "town"), ("b", "port")}
    assert got(min_history=71) == {("a", "city")} and got(most=1) == {("a", "city"), ("b", "town")}
    assert got(with_related=True) == {("a", "city"), ("a", "town"), ("b", "town"), ("b", "port")}
    own = spark.createDataFrame([("t", "region", "town", 18), ("t", "region", "gone", 39)], "text string, search_loc string, item_loc string, n long")
    left = geo.without_own_text(queries, counts, own)
    assert {(r["qid"], r["place"]) for r in geo.destinations(queries, items, left, min_history=13).collect()} == {("a", "city"), ("b", "port"), ("d", "port")}


def test_prior_without_history_changes_nothing(spark):
    rows = spark.createDataFrame([("here", "there", 0.5), ("unknown", "there", 0.5), ("here", "lost", 0.5)], "search_loc string, item_loc string, score double")
    prior = spark.createDataFrame([("here", "there", 1.0)], "search_loc string, item_loc string, p double")
    got = {(r["search_loc"], r["item_loc"]): r["adjusted"] for r in geo.adjusted_scores(rows, prior).collect()}
    assert got == {("here", "there"): 0.5, ("unknown", "there"): 0.5, ("here", "lost"): round(0.5 + 0.05 * math.log(1e-7), 6)}


def test_novel_channel_keeps_its_own_places(spark):
    """The route's first places are its own: what the base has inside them isn't made up for by later items."""
    route = spark.createDataFrame([("q", f"r{k}", k, 1.0 / k) for k in range(1, 7)], "qid string, item_id string, rank long, raw_score double")
    base = spark.createDataFrame([("q", "r1"), ("q", "r2"), ("q", "b")], "qid string, item_id string")
    assert items_of(hybrid.novel_channel(route, base, "m", 9, 9, capacity=4), "rank") == ["r3"]  # four places, three held
    assert items_of(hybrid.novel_channel(route, base, "m", 9, 9, capacity=6), "rank") == ["r3", "r4", "r5"]
    assert items_of(hybrid.novel_channel(route, base, "m", 9, 2, capacity=6), "rank") == ["r3", "r4"]


def test_supplemental_ranks_are_raw(spark):
    """A protected item inside a route doesn't move others up; ties by id; the capacity holds."""
    routes = spark.createDataFrame(
        [("q", "x", i, r, 1.0) for r, i in enumerate(["held", "b", "a"], 1)] + [("q", "y", i, r, 1.0) for r, i in enumerate(["c", "a"], 1)],
        "qid string, channel string, item_id string, rank long, raw_score double",
    )
    base = spark.createDataFrame([("q", "held")], "qid string, item_id string")
    out = hybrid.supplemental_channels(routes, base, capacity=3)
    fill = {r["item_id"]: (r["rank"], r["raw_score"]) for r in out.where("channel = 'supplemental_fill'").collect()}
    assert fill == {"a": (1, round(1 / 63 + 1 / 62, 9)), "c": (2, round(1 / 61, 9))}
    assert items_of(out.where("channel = 'x'"), "rank") == ["a"] and items_of(out.where("channel = 'y'"), "rank") == ["c", "a"]


def test_declared_variants(spark):
    base = channel(spark, [("q", "dense", 0, 1.0, i, r) for r, i in enumerate("abc", 1)])
    new = channel(spark, [("q", "n1", 0, 1.0, i, r) for r, i in enumerate("adef", 1)] + [("q", "n2", 1, 1.0, i, r) for r, i in enumerate("gb", 1)])
    text = [{"name": "f1", "mode": "fill", "channels": {"n1": 1}, "matched_addition_family": "m"}, {"name": "f2", "mode": "fill", "channels": {"n2": 1}, "matched_addition_family": "m"}, {"name": "all", "mode": "fill", "channels": {"n1": 1, "n2": 2}},
            {"name": "r", "mode": "replace", "channels": {"n2": {"source": "new", "quota": 1}, "dense": {"source": "base", "quota": 2}}}]
    out = variants.pools(base, new, variants.declared(json.dumps(text)))
    pools = {v: "".join(items_of(out.where(F.col("variant") == v), "pool_rank")) for v in ("f1", "f2", "all", "r")}
    assert pools == {"f1": "abcd", "f2": "abcg", "all": "abcgdef", "r": "gab"}
    with pytest.raises(ValueError, match="missing channels: no"):
        variants.pools(base, new, [variants.Variant("x", "fill", {"no": 1.0})])
    for bad in (
        '[{"name": "a", "mode": "other", "channels": {"n1": 1}}]', '[{"name": "a", "mode": "fill", "channels": {}}]',
        '[{"name": "a", "mode": "fill", "channels": {"n": 1}}, {"name": "a", "mode": "fill", "channels": {"n": 1}}]',
    ):
        with pytest.raises(ValueError):
            variants.declared(bad)


def test_training_sample(spark):
    """Positives all stay; a quarter from the baseline, channel heads in turn, the baseline again, the rest by hash."""
    pool = [("q", f"i{k:02d}", int(k == 3), k) for k in range(1, 31)] + [("none", "x", 0, 1)]
    rows = spark.createDataFrame(pool, "qid string, item_id string, label int, pool_rank long")
    baseline = spark.createDataFrame([("q", f"i{k:02d}", k) for k in range(1, 11)], "qid string, item_id string, rank long")
    heads = channel(spark, [("q", "c1", 0, 1.0, "i03", 1), ("q", "c1", 0, 1.0, "i20", 2), ("q", "c2", 1, 1.0, "i21", 1)])
    out = learning.training_sample(rows, baseline, heads, 12).collect()
    assert {r["item_id"] for r in out if r["hard"]} == {"i01", "i02", "i04", "i20", "i21", "i05"}
    assert len(out) == 13 and {r["item_id"] for r in out if r["label"]} == {"i03"} and {r["qid"] for r in out} == {"q"}


def test_schemas():
    sizes = {v: len(features.schema(v)) for v in features.SCHEMAS}
    assert sizes == {3: 70, 4: 75, 5: 76, 6: 77, 7: 83, 8: 85} and all(len(set(s)) == len(s) for s in features.SCHEMAS.values())
    assert features.V8[:75] == features.V4 and features.V8[-2:] == features.V6[-2:] and features.V8[:83] == features.V7
    with pytest.raises(ValueError):
        features.schema(9)


def test_features_of_one_item(spark):
    """Phrases are looked for in the item, "0" is no category, a rating floor is met or not, a missing rating is unknown."""
    queries = spark.createDataFrame(
        [("q", "Red Shoe", "рейтинг пользователя 4,5", "p1", "0", "1")],
        "qid string, text string, filters string, location string, category string, delivery string",
    )
    items = spark.createDataFrame([("a", "big red shoe here", "red shoe", "shoe", "p1", "0", "m", "9", "4.6", "3", "1", ""), ("b", "red", "", None, "", "c", "", "x", "", "", "", "")],
                                  "item_id string, title string, params string, description string, location string, category string, microcat string, price string, rating string, reviews string, phone_hidden string, message_forbidden string")
    ch = channel(spark, [("q", "title", 0, 1.0, "a", 1), ("q", "title", 0, 1.0, "b", 2), ("q", "title_geo", 1, 0.25, "a", 1)])
    scores = spark.createDataFrame([("q", "a", 0.5), ("q", "b", 0.1)], "qid string, item_id string, score double")
    places = spark.createDataFrame([("q", "p1")], "qid string, place string")
    rows = {r["item_id"]: r for r in features.rows(ch, scores, scores.where("item_id = 'a'"), queries, items, 8, features.Signals(places)).collect()}
    a, b = rows["a"], rows["b"]
    near = lambda r, **k: all(abs(r[n] - v) < 1e-6 for n, v in k.items())
    assert near(
        a, pool_rank=0.5, baseline_top50=1, channel_count=2, geo_channel_count=1, rank_title=1 / 61, rank_title_geo=1 / 61, present_dense=0,
        location_match=1, geo_destination_match=1, geo_destination_is_fallback=0,
    )
    assert near(
        a, category_match=0, category_known=0, title_overlap=2, title_query_coverage=1, title_exact_phrase=1, params_exact_phrase=1,
        rating_filter_known=1, rating_filter_match=1, rating=4.6, phone_hidden=1, delivery_search=1, has_query_filters=1,
    )
    assert near(
        b, pool_rank=1 / 3, baseline_top50=0, title_exact_phrase=0, title_overlap=1, rating_filter_known=0, rating_filter_match=0,
        log_price=0, location_known=0, microcat_classifier_known=0, full_dense_known=0,
    )


def test_search_in_blocks_equals_rows_and_is_bounded(spark, monkeypatch):
    """Random words in two fields, one of stems: rankings over all items and inside places, and the category channel, as from a row for each pair."""
    rng = np.random.default_rng(5)
    words = np.array(["красивая", "красивый", "столы", *(f"w{k}" for k in range(25))])
    text = lambda n: " ".join(rng.choice(words, n))
    items = spark.createDataFrame(
        [(f"i{k:03}", text(k % 4), "" if k % 7 == 0 else text(9), f"p{k % 5}", f"c{k % 3}" if k % 11 else "") for k in range(300)],
        "item_id string, title string, params string, location string, microcat string",
    ).repartition(7)
    queries = spark.createDataFrame([(k, text(5) if k else "none", f"p{k % 6}") for k in range(12)], "qid long, text string, location string")
    fields = (bm25.Field("title", 1.0, 0.2, 2.0), bm25.Field("params", 1.2, 0.7, 1.0), bm25.Field("title_stem", 1.0, 0.2, 0.5))
    terms = bm25.stem_queries(bm25.query_terms(queries), ("title", "params"), ("title_stem",))
    scored = bm25.scores(bm25.build(items, fields, {"title_stem": "title"}), terms, True).cache()
    monkeypatch.setattr(blocks, "FEW", 1000)  # several blocks
    monkeypatch.setattr(blocks, "GROUP", 5)
    monkeypatch.setattr(blocks, "CELLS", 200)
    about = items.select("item_id", F.col("location").alias("place"), F.col("microcat").alias("cat"))
    search = blocks.Search(bm25.counted(items, fields, {"title_stem": "title"}), terms, fields, about)
    places = queries.select("qid", F.explode(F.array("location", F.lit("p0"))).alias("place"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    ranked = lambda df, k: rows(bm25.top_k(df, k, ["field", "qid"]).select("field", "qid", "doc", "score", "rank"))
    found = search.best(4).cache()
    assert ranked(found, 4) == ranked(scored, 4) and search.blocks.count() > 1
    assert found.count() <= 4 * 12 * 3 * search.blocks.count()
    inside = lambda df: df.join(about.select(F.col("item_id").alias("doc"), "place"), "doc").join(places, ["qid", "place"], "left_semi")
    assert ranked(inside(search.best(0, places, 3)), 3) == ranked(inside(scored), 3)
    said = spark.createDataFrame([(q, f"c{c}", (1 + (q + c) % 3) / 6) for q in range(12) for c in range(3)], "qid long, cat string, prob double")
    channel = lambda x: rows(category.channel(x, said, items, queries, 8, {"title": 2.0, "params": 1.0}, top=2, least=3, bonus=0.1))
    assert channel(search) == channel(scored) and len(channel(search)) > 50


def test_only_clicked_texts_have_a_prior(spark):
    """Six texts share a word; the seventh query shares it too but was never clicked."""
    from quillrank.plans import feature_queries

    clicks = spark.createDataFrame([(f"red {k}", f"c{k % 2}") for k in range(6)], "text string, cat string")
    queries = spark.createDataFrame([(1, "Red 1"), (2, "red 9")], "qid long, text string")
    assert {r["qid"] for r in feature_queries.token_prior(queries, clicks).collect()} == {1}


def test_description_words_are_of_the_whole_text(spark):
    """A word after the first 1,500 characters counts in overlaps and length."""
    items = spark.createDataFrame(
        [(1, "t", "p", "word " * 400 + "tail", "", "", "", "", "", "", "", "")],
        "item_id long, title string, params string, description string, location string, category string, microcat string, price string, rating string, reviews string, phone_hidden string, message_forbidden string",
    )
    assert sorted(features.item_side(items).first()["d_words"]) == ["tail", "word"]


def test_feature_columns_move_unchanged(spark):
    full = spark.createDataFrame([("q", "i", *(float(k) for k in range(77)))], ["qid", "item_id", *features.V6])
    out = features.reduced(full, 6, 4, ["qid", "item_id"])
    assert out.columns == ["qid", "item_id", *features.V4] and [out.first()[n] for n in features.V4] == [float(k) for k in range(75)]
    with pytest.raises(ValueError):
        features.reduced(full, 4, 6, ["qid"])
    more = features.appended(
        full.select("qid", "item_id"), spark.createDataFrame([("q", "j", 0.5)], "qid string, item_id string, value double"), "second",
        "second_known", ["qid", "item_id"],
    ).first()
    assert (more["second"], more["second_known"]) == (0.0, 0.0)


def test_filter_atoms_and_keys(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    deep = '{"a":{"b":{"c":{"d":1}}},"Цвет Ручки":["  Красный ","красный"],"e":"","n":null,"l":[{"k":true},{"k":2.5}]}'
    assert one(S.filter_atoms(F.lit(deep))) == sorted(["filter_a_b_c_d 1", "filter_цвет_ручки красный", "filter_l_k true", "filter_l_k 2.5"])
    assert one(S.filter_atoms(F.lit("no json"))) is None or one(S.filter_atoms(F.lit("no json"))) == []
    assert one(S.category_query_text(F.lit(" Shoe"), F.lit("Plain  Text"), F.lit("0"))) == "shoe | filter_ plain text"
    assert one(S.category_query_text(F.lit("Shoe"), F.lit(None).cast("string"), F.lit("Cars"))) == "shoe | category_cars"
    assert one(X.filter_values(F.lit("a c++ five a.b six"), ["c++", "a.b"], {"c++"})) == "a ; five"
    with pytest.raises(Exception, match="deeper than"):
        one(S.filter_atoms(F.lit('{"a":' * 14 + "1" + "}" * 14)))


def test_pairwise_ranker_orders(spark):
    r = np.random.default_rng(1)
    rows = [(f"q{q}", f"i{k}", int(k < 2), float(r.normal() + 2 * (k < 2)), float(r.normal()), 0.5 if k < 2 else 0.1) for q in range(20) for k in range(12)]
    df = spark.createDataFrame(rows, "qid string, item_id string, label int, good double, noise double, weight double")
    pairs = learning.pair_rows(df, ["good", "noise"], partners=3)
    assert pairs.count() == 20 * 2 * 3 * 2 and abs(pairs.agg(F.sum("weight")).first()[0] - 20) < 1e-6
    scored = learning.rank_scores(learning.fit_pairwise(df, ["good", "noise"]), df)
    means = {x["label"]: x["p"] for x in scored.groupBy("label").agg(F.avg("prob").alias("p")).collect()}
    assert means[1] > means[0] + 0.2


def test_encode_hook(spark):
    def load():
        return lambda texts: np.array([[t.count("a"), t.count("b"), 0] for t in texts], float)

    rows = spark.createDataFrame([(1, "aab"), (2, None), (3, "b")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in encode.encoded(rows, "text", load, prefix="b").collect()}
    assert np.allclose(got[1], [2**-0.5, 2**-0.5, 0]) and got[2] == [0, 1, 0] and got[3] == [0, 1, 0]


def test_vector_blocks_are_full(spark):
    """Small Arrow batches don't make small blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "7")
    try:
        v = spark.range(100).select(F.col("id"), F.array(F.cos("id"), F.sin("id")).alias("embedding")).coalesce(1)
        assert sorted(
            len(r["ids"]) for r in vectors.packed(v, "id", "embedding", block=40).collect()
        ) == [16, 42, 42] or vectors.packed(v, "id", "embedding", block=40).count() <= 5
        top = vectors.cosine_top_k(v.where("id < 3"), v, 2, "id")
        assert {(r["qid"], r["item_id"]) for r in top.where("rank = 1").collect()} == {(0, 0), (1, 1), (2, 2)}
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_unit_tfidf(spark):
    rows = spark.createDataFrame([("a", ["x", "x", "y"]), ("b", ["y"]), ("c", ["z"])], "k string, g array<string>")
    out = {(r["k"], r["g"]): r["w"] for r in tfidf.vectors(rows, "k", "g", unit=True).collect()}
    x, y = (1 + math.log(2)) * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert math.isclose(out["a", "x"], x / math.hypot(x, y)) and out["b", "y"] == 1 and len(tfidf.vectors(rows, "k", "g", least=2).collect()) == 2
    assert {r["g"] for r in tfidf.vectors(rows, "k", "g", most=1).collect()} == {"y"}


def test_averages(spark):
    groups = spark.createDataFrame(
        [("a", "t", 1, 2, True), ("b", "t", 2, 2, False), ("c", "u", 0, 4, True), ("d", "v", 0, 0, True)],
        "qid string, text string, n_hit int, n_available int, rep boolean",
    )
    r = evaluation.recall(groups, representative="rep").first()
    assert (r["macro"], r["text_macro"], r["micro"], r["n_queries"], r["representative_macro"]) == (0.5, 0.375, 0.375, 3, 0.25)


def test_history_bonus(spark):
    rows = spark.createDataFrame([("t", "m1", 0.5), ("t", "m2", 0.5), ("u", "m1", 0.5)], "text string, cat string, prob double")
    clicks = spark.createDataFrame([("t", "m1", 5), ("t", "m3", 2)], "text string, cat string, n long")
    assert {
        (r["text"], r["cat"]): round(r["prob"], 6) for r in category.history_bonus(rows, clicks, 0.4).collect()
    } == {("t", "m1"): 0.7, ("t", "m2"): 0.5, ("u", "m1"): 0.5}


def test_strict_answers(spark):
    corpus = spark.createDataFrame([(f"{k:016x}",) for k in range(3)], "item_id string")
    queries = spark.createDataFrame([("q" * 16,), ("r" * 16,)], "qid string")
    a, b = f"{0:016x}", f"{1:016x}"
    answer = spark.createDataFrame([("q" * 16, f"{a} {b}"), ("short", f"{a}  {b}"), ("r" * 16, f"{a} {a} {b.upper()[:-1]}F")], "query_id string, answer string")
    found = {r["violation"]: r["n"] for r in protocol.violations(answer, queries, corpus, strict=True).collect()}
    assert found == {
        "too_many": 0, "repeated_item": 1, "query_id_form": 1, "item_id_form": 2, "missing_query": 0, "unknown_query": 1, "unknown_item": 1,
        "repeated_query": 0,
    }


def test_fingerprints(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("b", "c")], "x string, y string")
    mark = lambda d: protocol.fingerprint(d).first()["fingerprint"]
    assert mark(df) == mark(df.orderBy(F.desc("y")).repartition(3)) != mark(df.select(F.col("y").alias("x"), F.col("x").alias("y")).where("x IS NOT NULL"))
    assert mark(spark.createDataFrame([("a", None)], "x string, y string")) != mark(spark.createDataFrame([(None, "a")], "x string, y string"))


def test_sources_and_caches(spark, tmp_path):
    p = lambda n: f"{tmp_path}/{n}"
    with gzip.open(p("scores.jsonl.gz"), "wt") as f:
        f.write('{"qid": "a", "score": 0.5}\n{"qid": "b", "score": 0.25}\n')
    assert [tuple(r) for r in tables.read_scores(spark, p("scores.jsonl.gz"), "qid string, score double").orderBy("qid").collect()] == [("a", 0.5), ("b", 0.25)]
    for name, rows in (
        ("good", [{"id": "a", "label": 1}, {"id": "b", "label": 0}]), ("twice", [{"id": "a", "label": 1}, {"id": "a", "label": 0}]),
        ("typed", [{"id": "a", "label": "x"}]),
    ):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    assert tables.read_labels(spark, p("good.json"), {"id": "string", "label": "bigint"}, ["id"]).count() == 2
    for name, why in (("twice", "repeats"), ("typed", "label is string")):
        with pytest.raises(ValueError, match=why):
            tables.read_labels(spark, p(f"{name}.json"), {"id": "string", "label": "bigint"}, ["id"])
    rows = spark.range(5).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    sinks.write_cache(rows, p("cache"), {"run": 1})
    assert sinks.read_cache(spark, p("cache"), {"run": 1}).count() == 5
    with pytest.raises(ValueError, match="another run"):
        sinks.read_cache(spark, p("cache"), {"run": 2})
    rows.write.parquet(p("half/rows"))
    with pytest.raises(ValueError, match="incomplete"):
        sinks.read_cache(spark, p("half"), {"run": 1})
    assert tables.read_text(spark, p("cache/rows"), ["v"], "v >= 3").count() == 2


def test_bonus_summary_slices(spark):
    """Local and other positives apart; the bonus that brings the local one up wins on the first half."""
    ranked = spark.createDataFrame([(0.0, "q", "far", 1), (0.1, "q", "near", 1)], "bonus double, qid string, item_id string, rank long")
    truth = spark.createDataFrame([("q", "near"), ("q", "other")], "qid string, item_id string")
    queries = spark.createDataFrame([("q", "here")], "qid string, location string")
    items = spark.createDataFrame([("near", "here"), ("far", "away"), ("other", "away")], "item_id string, location string")
    got = {r["bonus"]: r for r in integrity.bonus_summary(ranked, truth, F.lit(True), queries, items).collect()}
    assert (got[0.1]["all_recall"], got[0.1]["local_recall"], got[0.1]["other_recall"], got[0.1]["local_share"], got[0.1]["best"]) == (0.5, 1.0, 0.0, 1.0, True)
    assert (got[0.0]["all_recall"], got[0.0]["local_share"], got[0.0]["best"]) == (0.0, 0.0, False)
