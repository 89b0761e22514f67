"""Commands over Parquet tables: profile, evaluate, predict, validate, prepare-ranker, fit-ranker, fit-category.

Tables (missing columns count as empty):
items (item_id, title, params, description, category, location, microcat,
price, rating, reviews, phone_hidden, message_forbidden), queries (qid, text,
location, filters, category, delivery), clicks (the queries' fields and
item_id), answers (query_id, answer), feature rows.  The methods dense and
hybrid need vectors of all items (item_id, embedding) and of all queries with
text (text, embedding).
"""

from __future__ import annotations

import argparse
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Options
from .functions import scalar as S
from .functions import text as X
from .operators import category, category_model, evaluation, features, fusion, learning, protocol, provenance
from .run import Run, asked, filled
from .sources import sinks, tables

COMMANDS = ("profile", "evaluate", "predict", "validate", "prepare-ranker", "fit-ranker", "fit-category")
#: Options of a run that the command line sets, with their types.
FLAGS = {
    "method": str, "split": str, "fraction": float, "seed": int, "depth": int, "rank_constant": int, "channel_quota": int, "location_bonus": float, "stem_title": float, "stem_params": float,
    "geo_depth": int, "geo_places": int, "geo_history": int, "geo_weight": float, "lexical_weight": float, "dense_weight": float, "category_depth": int, "category_weight": float,
    "version": int, "negatives": int, "exact_bonus": float, "max_queries": int,
}
SWITCHES = ("sweep", "geo_related", "geo_leave_out", "supplemental")
#: Bonuses of a sweep, besides the run's own.
BONUSES = [*(i / 1000 for i in range(41)), 0.05, 0.1]


def split_rows(clicks: DataFrame, mode: str, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Fit and validation clicks: by query text, by pair of a whole query and an item, or all for validation."""
    return protocol.split(filled(clicks, protocol.KEY), mode, fraction, seed)


def retrieved(items: DataFrame, queries: DataFrame, o: Options, embedded: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return Run(items, o, embedded=embedded).channels(queries)


def ranked(items: DataFrame, queries: DataFrame, o: Options, embedded: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Channels and final ranking; ``embedded``: vectors of queries and items."""
    return Run(items, o, embedded=embedded).ranked(queries)


def feature_rows(items: DataFrame, queries: DataFrame, truth: DataFrame, o: Options, embedded: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return Run(items, o, embedded=embedded).training_rows(queries, truth)


def profile(spark: SparkSession, given: dict[str, str]) -> DataFrame:
    """(name, value): rows and columns of the tables, and what clicks and queries have in common."""
    out = []
    for r in tables.inventory(spark, given).collect():  # a row for each table
        out += [(f"{r['name']}_rows", float(r["n_rows"])), (f"{r['name']}_columns", float(r["n_columns"]))]
    read = {n: spark.read.parquet(p) for n, p in given.items()}
    if "clicks" in read:
        c = filled(read["clicks"], protocol.KEY).withColumn("__key", protocol.query_key())
        text = X.normalize(F.col("text"))
        row = c.agg(
            F.count("*").alias("pairs"), F.count_distinct(text).alias("texts"), F.count_distinct("__key").alias("keys"),
            F.count_distinct("__key", "item_id").alias("different_pairs"), F.count_distinct("item_id").alias("items"),
        ).first()
        out += [(f"clicks_{k}", float(v)) for k, v in row.asDict().items()] + [("clicks_repeated", float(row["pairs"] - row["different_pairs"]))]
        if "items" in read:
            both = c.select("item_id").distinct().join(read["items"].select("item_id").distinct(), "item_id", "left_semi").count()
            out.append(("clicked_items_in_corpus", both / max(1, row["items"])))
        if "queries" in read:
            q = read["queries"].select(text.alias("t")).distinct()
            seen = q.join(c.select(text.alias("t")).distinct(), "t", "left_semi").count()
            out.append(("query_texts_clicked_before", seen / max(1, q.count())))
    return spark.createDataFrame(out, "name string, value double")


def report(run: Run, queries: DataFrame, truth: DataFrame) -> list[DataFrame]:
    """(part, name, value) tables of an evaluation: recall in its averages, of the pool, of every channel, with and without quotas, and the geographic channels' part."""
    o, items = run.options, run.items
    channels = run.channels(queries)
    scores = run.scores(channels, queries)
    texts = queries.select("qid", X.normalize(F.col("text")).alias("text"))
    pairs = truth.select("qid", "item_id").distinct()
    pool = fusion.pool(channels).select("qid", "item_id", F.lit(1).alias("rank"))
    named = {
        "final": fusion.fuse(scores, o.limit, o.channel_quota), "without_quota": fusion.fuse(scores, o.limit),
        "quota_10": fusion.fuse(scores, o.limit, 10), "pool": pool,
    }
    out = []
    chosen = protocol.representatives(texts, "text", "qid", "representative").select("qid", F.lit(True).alias("rep"))
    for name, top in named.items():
        groups = evaluation.hits(top, pairs, items.select("item_id"), o.limit).join(texts, "qid").join(chosen, "qid", "left").na.fill(False, ["rep"])
        row = evaluation.recall(groups, representative="rep")
        out.append(
            row.select(
                F.lit(name).alias("part"),
                F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns))),
            )
        )
    for name in [r["channel"] for r in channels.select("channel").distinct().orderBy("channel").collect()]:  # the channels' names
        groups = evaluation.hits(channels.where(F.col("channel") == name), pairs, items.select("item_id"), o.limit).join(texts, "qid")
        out.append(evaluation.recall(groups).select(F.lit("channel").alias("part"), F.lit(name).alias("name"), F.col("macro").alias("value")))
    if o.geo_depth:
        own = F.col("channel").contains("_geo")
        gain = evaluation.contribution(channels.where(~own), channels.where(own), pairs, items)
        out.append(
            gain.select(
                F.lit("geo").alias("part"),
                F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in gain.columns))),
            )
        )
    if o.sweep:
        grid = run.bonus_sweep(channels, queries, pairs, sorted({*BONUSES, o.location_bonus}))
        columns = [c for c in grid.columns if c != "bonus"]
        out.append(
            grid.select(
                F.concat(F.lit("bonus "), F.col("bonus").cast("string")).alias("part"),
                F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))),
            )
        )
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillrank")
    p.add_argument("command", choices=COMMANDS)
    for name in (
        "items", "queries", "clicks", "rows", "answer", "model", "output", "item-vectors", "query-vectors", "category-model",
        "allowed-texts", "filter-keys",
    ):
        p.add_argument(f"--{name}")
    for name, kind in FLAGS.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=kind)
    for name in SWITCHES:
        p.add_argument(f"--{name.replace('_', '-')}", action="store_true")
    p.add_argument("--sweep-location-bonus", dest="sweep", action="store_true")
    p.add_argument("--no-category-prior", dest="category_prior", action="store_false")
    p.add_argument("--estimator", choices=["boosted", "pairwise"], default="boosted")
    p.add_argument("--iterations", type=int, default=50)
    p.add_argument("--folds", type=int, choices=[0, 3, 5], default=3)
    p.add_argument("--strict", action="store_true", help="validate the forms of ids too")
    return p


def options(a: argparse.Namespace) -> Options:
    given = {n: getattr(a, n) for n in FLAGS if getattr(a, n) is not None} | {n: getattr(a, n) for n in SWITCHES}
    return Options(**{"method": "bm25"} | given | {"category_prior": a.category_prior})


def main(argv: list[str] | None = None) -> None:
    p = parser()
    a = p.parse_args(argv)
    o = options(a)
    if o.method != "bm25" and a.command in ("evaluate", "predict", "prepare-ranker") and not (a.item_vectors and a.query_vectors):
        p.error(f"--method {o.method} needs --item-vectors and --query-vectors")
    spark = SparkSession.builder.appName(f"quillrank {a.command}").getOrCreate()
    read = spark.read.parquet
    embedded = (read(a.query_vectors), read(a.item_vectors)) if a.query_vectors and a.item_vectors else None
    categories = category_model.CategoryModel.load(spark, a.category_model) if a.category_model else None
    keys = json.loads(a.filter_keys) if a.filter_keys else {}

    def made(clicks: DataFrame | None) -> Run:
        return Run(read(a.items), o, clicks, embedded, categories, keys)

    if a.command == "profile":
        sinks.write_report(profile(spark, {n: v for n in ("items", "queries", "clicks") if (v := getattr(a, n))}), a.output)
    elif a.command == "validate":
        found = {
            r["violation"]: r["n"] for r in protocol.violations(tables.read_answers(spark, a.answer), read(a.queries), read(a.items), strict=a.strict).collect()
        }
        print(json.dumps(found))
        if any(found.values()):
            raise SystemExit(1)
    elif a.command == "predict":
        run = made(read(a.clicks) if a.clicks else None)
        channels, top = run.ranked(read(a.queries))
        if a.model:
            provenance.require_same(provenance.read(spark, f"{a.model}-about"), provenance.identity(run.items, o.identity()))
            top = run.reranked(channels, read(a.queries), PipelineModel.load(a.model))
        sinks.write_answers(protocol.answers(top), a.output)
    elif a.command in ("evaluate", "prepare-ranker"):
        clicks = read(a.clicks).join(read(a.items).select("item_id"), "item_id", "left_semi")
        fit, valid = split_rows(clicks, o.split, o.fraction, o.seed)
        used = valid if a.command == "evaluate" else fit
        if a.allowed_texts:
            used = protocol.allowed(used, read(a.allowed_texts))
        queries, truth = asked(used)
        if o.max_queries:
            kept = protocol.sample(queries, "qid", str(o.seed), o.max_queries).select("qid")
            queries, truth = queries.join(kept, "qid", "left_semi"), truth.join(kept, "qid", "left_semi")
        run = made(fit)
        if a.command == "prepare-ranker":
            rows = run.training_rows(queries, truth)
            sinks.write_features(rows, a.output)
            provenance.write(spark, f"{a.output}-about", provenance.identity(run.items, o.identity()))
        else:
            parts = report(run, queries, truth)
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            sinks.write_report(out, a.output)
    elif a.command == "fit-ranker":
        rows, names = read(a.rows), features.schema(o.version)
        if missing := [n for n in names if n not in rows.columns]:
            raise ValueError(f"these rows lack features of version {o.version}: {', '.join(missing)}")
        model = learning.fit_pairwise(rows, names) if a.estimator == "pairwise" else learning.fit_ranker(rows, names, a.iterations)
        model.write().save(a.output)
        about = provenance.read(spark, f"{a.rows}-about")
        provenance.write(spark, f"{a.output}-about", about | {"fitted": provenance.fitted_fingerprint(model)})
    else:
        clicks = filled(read(a.clicks), protocol.KEY)
        if a.allowed_texts:
            clicks = protocol.allowed(clicks, read(a.allowed_texts))
        items = read(a.items).select("item_id", F.col("microcat").alias("cat"))
        texts = S.category_query_text(F.col("text"), F.col("filters"), F.col("category"))
        rows = clicks.join(items, "item_id").select(X.normalize(texts).alias("text"), F.sha2(protocol.query_key(), 256).alias("context"), "cat")
        model = category_model.fit(category.fit_weights(rows.where("coalesce(cat, '') NOT IN ('', '0')")), category_model.Settings(folds=a.folds, seed=o.seed))
        model.save(a.output)


if __name__ == "__main__":
    main()
