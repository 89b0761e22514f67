"""The commands end to end on small tables."""

import json
import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from quillrank import cli
from quillrank.config import Options
from quillrank.operators import category_model, features, provenance
from quillrank.run import Run, asked


def value(spark, path, part, name):
    return next(r["value"] for r in json.loads(spark.read.text(path).first()[0]) if (r["part"], r["name"]) == (part, name))


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """30 items in three categories and four places, clicks of texts that name their items, vectors."""
    top = tmp_path_factory.mktemp("shop")
    p = lambda n: f"{top}/{n}"
    items = [
        (
            f"{k:016x}", f"thing number{k} word{k % 3}", f"kind k{k % 4}", f"more about word{k % 5} and thing{k}", "c", f"p{k % 4}",
            f"m{k % 3}", str(10 * k), "4.5",
        ) for k in range(30)
    ]
    names = "item_id string, title string, params string, description string, category string, location string, microcat string, price string, rating string"
    spark.createDataFrame(items, names).write.parquet(p("items"))
    spark.createDataFrame([("q" * 16, "number3 word0", "p3"), ("r" * 16, "thing4", "")], "qid string, text string, location string").write.parquet(p("queries"))
    clicks = [(f"number{k} thing", f"{k:016x}", f"p{(k + d) % 4}") for k in range(30) for d in range(2)]
    spark.createDataFrame(clicks, "text string, item_id string, location string").write.parquet(p("clicks"))
    angle = lambda k: [math.cos(k), math.sin(k)]
    spark.createDataFrame([(f"{k:016x}", angle(0.1 * k)) for k in range(30)], "item_id string, embedding array<double>").write.parquet(p("iv"))
    spark.createDataFrame(
        [(f"number{k} thing", angle(0.1 * k)) for k in range(30)] + [("number3 word0", angle(0.3)), ("thing4", angle(0.4))],
        "text string, embedding array<double>",
    ).write.parquet(p("qv"))
    return p


def test_commands(spark, shop, capsys):
    p = shop
    common = ["--items", p("items"), "--queries", p("queries"), "--clicks", p("clicks")]
    cli.main(["profile", *common, "--output", p("profile")])
    told = {r["name"]: r["value"] for r in json.loads(spark.read.text(p("profile")).first()[0])}
    assert told["items_rows"] == 30 and told["clicks_texts"] == 30 and told["clicks_repeated"] == 0 and told["clicked_items_in_corpus"] == 1
    cli.main(["predict", *common, "--output", p("answer"), "--location-bonus", "0.1"])
    cli.main(["validate", *common, "--answer", p("answer"), "--strict"])
    assert set(json.loads(capsys.readouterr().out.strip().splitlines()[-1]).values()) == {0}
    cli.main(["evaluate", *common, "--output", p("report"), "--max-queries", "6"])
    assert 0.5 < value(spark, p("report"), "final", "macro") <= 1 and value(spark, p("report"), "final", "n_queries") == 6
    cli.main(
        [
            "prepare-ranker", *common, "--output", p("rows"), "--negatives", "8", "--split", "queries", "--geo-depth", "5", "--geo-history",
            "1", "--geo-leave-out",
        ]
    )
    rows = spark.read.parquet(p("rows"))
    assert [c for c in rows.columns if c in features.V4] == features.V4 and rows.where("label = 0").groupBy("qid").count().where("count > 8").isEmpty()
    assert {t for n, t in rows.dtypes if n in features.V4} == {"float"} and rows.groupBy("qid").agg(F.sum("weight").alias("w")).where("abs(w - 2) > 1e-5").isEmpty()
    for estimator in ("boosted", "pairwise"):
        cli.main(["fit-ranker", "--rows", p("rows"), "--iterations", "3", "--output", p(estimator), "--estimator", estimator])
        cli.main(
            [
                "predict", *common, "--model", p(estimator), "--output", p(f"answer-{estimator}"), "--geo-depth", "5", "--geo-history", "1",
                "--exact-bonus", "0.2",
            ]
        )
        assert spark.read.csv(p(f"answer-{estimator}"), header=True).count() == 2
    with pytest.raises(ValueError, match="geo_depth"):
        cli.main(["predict", *common, "--model", p("boosted"), "--output", p("other")])
    saved = provenance.read(spark, p("boosted-about"))
    assert saved["fitted"] == provenance.fitted_fingerprint(PipelineModel.load(p("boosted")))


def test_hybrid_with_every_channel(spark, shop):
    p = shop
    common = [
        "--items", p("items"), "--queries", p("queries"), "--clicks", p("clicks"), "--item-vectors", p("iv"), "--query-vectors", p("qv"),
        "--method", "hybrid", "--split", "queries",
    ]
    cli.main(["fit-category", *common[:6], "--output", p("categories")])
    model = category_model.CategoryModel.load(spark, p("categories"))
    said = model.predict(spark.createDataFrame([("number3 thing",), ("something else",)], "text string"))
    model.assert_unseen(said)
    by = {r["text"]: r["by"] for r in said.select("text", "by").distinct().collect()}
    assert by["number3 thing"] >= 0 and by["something else"] == -1  # a fitted text goes to the fold that left it out
    sums = said.groupBy("text").agg(F.sum("prob").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-6 for r in sums)
    with pytest.raises(ValueError, match="has seen it"):
        model.assert_unseen(said.withColumn("by", F.lit(-1)))
    every = [*common, "--stem-title", "0.5", "--geo-depth", "4", "--geo-history", "1", "--geo-related", "--category-model", p("categories"), "--depth", "6"]
    cli.main(["evaluate", *every, "--category-depth", "5", "--sweep-location-bonus", "--output", p("hybrid-report")])
    names = {r["name"] for r in json.loads(spark.read.text(p("hybrid-report")).first()[0]) if r["part"] == "channel"}
    assert {"title", "title_stem", "title_geo", "dense", "micro_combined", "title_geo_related"} <= names
    assert value(spark, p("hybrid-report"), "bonus 0.05", "all_recall") > 0 and value(spark, p("hybrid-report"), "geo", "extra") >= 0
    cli.main(["prepare-ranker", *every, "--category-depth", "5", "--version", "8", "--output", p("rows8")])
    rows = spark.read.parquet(p("rows8"))
    assert [
        c for c in rows.columns if c in features.V8
    ] == features.V8 and rows.where("full_dense_known = 0").isEmpty() and not rows.where("present_microcategory_channel = 1").isEmpty()
    cli.main(["predict", *every, "--supplemental", "--output", p("supplemental")])
    assert spark.read.csv(p("supplemental"), header=True).count() == 2


def test_keys_of_clicks(spark):
    clicks = spark.createDataFrame([("A  b", "x", "1"), ("a b", "x", "2"), ("a b", "y", "3")], "text string, location string, item_id string")
    queries, truth = asked(clicks)
    assert queries.count() == 2 and truth.count() == 3 and truth.select("qid").distinct().count() == 2


def test_options_without_meaning():
    bad = (
        {
            "method": "dense", "location_bonus": 0.1,
        }, {"sweep": True, "channel_quota": 1}, {"method": "x"}, {"fraction": 0.0}, {"method": "dense", "geo_depth": 3}, {"geo_related": True}, {"method": "bm25", "category_depth": 3},
        {"supplemental": True, "category_depth": 3}, {"split": "pairs", "supplemental": True}, {"version": 3}, {"method": "bm25", "version": 8}, {
            "lexical_weight": 0.0, "dense_weight": 0.0,
        }, {"negatives": -1},
    )
    for b in bad:
        with pytest.raises(ValueError):
            Options(**b)


def test_dense_and_hybrid(spark, tmp_path):
    """An item that shares no word with the query is found by its vector; queries without text find nothing by vectors."""
    p = lambda n: f"{tmp_path}/{n}"
    items = [(f"i{k}", f"thing number{k}", "", f"more about thing{k}", "c", "") for k in range(12)]
    spark.createDataFrame(items, "item_id string, title string, params string, description string, category string, location string").write.parquet(p("items"))
    spark.createDataFrame([("q1", "Number3", ""), ("q2", "", "")], "qid string, text string, location string").write.parquet(p("queries"))
    spark.createDataFrame([("number3", f"i{k}") for k in (3, 7)], "text string, item_id string").write.parquet(p("clicks"))
    angle = lambda k: [math.cos(k), math.sin(k)]
    spark.createDataFrame([(f"i{k}", angle(0.1 * k)) for k in range(12)], "item_id string, embedding array<double>").write.parquet(p("iv"))
    spark.createDataFrame([("number3", angle(0.72)), ("other", angle(0.0))], "text string, embedding array<double>").write.parquet(p("qv"))
    near = [f"i{k}" for k in sorted(range(12), key=lambda k: -math.cos(0.1 * k - 0.72))]
    tables = ["--items", p("items"), "--queries", p("queries"), "--clicks", p("clicks"), "--split", "all"]
    vectors = ["--item-vectors", p("iv"), "--query-vectors", p("qv")]
    score = {i: 1 / (60 + r) for r, i in enumerate(near, 1)}
    score["i3"] += 2 / 3.5 / 61
    for method, expected in (("dense", near), ("hybrid", sorted(near, key=lambda i: -score[i]))):
        cli.main(["predict", *tables, *vectors, "--method", method, "--output", p(method)])
        answers = {r["query_id"]: r["answer"].split() for r in spark.read.csv(p(method), header=True).collect()}
        assert answers == {"q1": expected}
        cli.main(["evaluate", *tables, *vectors, "--method", method, "--output", p(f"report-{method}")])
        assert value(spark, p(f"report-{method}"), "final", "macro") == 1
        read = lambda n: spark.read.parquet(p(n))
        truth = read("clicks").withColumn("qid", F.lit("q1"))
        rows = Run(read("items"), Options(method, negatives=20), embedded=(read("qv"), read("iv"))).training_rows(read("queries"), truth)
        assert rows.count() == 12 and rows.where("present_dense = 1 AND score_dense > 0").count() == 12 and rows.where("label = 1").count() == 2
    with pytest.raises(SystemExit):
        cli.main(["predict", *tables, "--method", "dense", "--output", p("none")])
    with pytest.raises(ValueError, match="1 queries have no vector"):
        cli.ranked(
            spark.read.parquet(p("items")), spark.createDataFrame([("q", "unseen", "")], "qid string, text string, location string"),
            Options("dense"), (spark.read.parquet(p("qv")), spark.read.parquet(p("iv"))),
        )
