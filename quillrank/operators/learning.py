"""Learned operators on Spark ML: training samples, boosted ranker and its prefixes, pairwise ranker."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S


def training_sample(rows: DataFrame, baseline: DataFrame, channels: DataFrame, limit: int = 64, seed: str = "42", heads: int = 20) -> DataFrame:
    """``rows`` (qid, item_id, label, ...) cut to all positives and up to ``limit`` others of each query, with ``hard``.

    Half of the others are hard: a quarter the first of the search's own
    ranking (``baseline``: qid, item_id, rank), then the channels' heads in
    turn, rank by rank; where those don't suffice, further ones of the
    baseline.  The rest is drawn by a hash.  Queries without a positive stay out.
    """
    budget = limit // 2
    turns = channels.where(F.col("rank") <= heads).groupBy("qid", "item_id").agg(F.min(F.struct("rank", "ch_ord")).alias("turn"))
    own = rows.join(baseline.select("qid", "item_id", F.col("rank").alias("__base")), ["qid", "item_id"], "left").join(turns, ["qid", "item_id"], "left")
    by = Window.partitionBy("qid", "label")
    own = own.withColumn("__first", F.row_number().over(by.orderBy(F.asc_nulls_last("__base"), "item_id")))
    early = F.col("__base").isNotNull() & (F.col("__first") <= budget // 2)
    kind = F.when(early, 1).when(F.col("turn").isNotNull(), 2).when(F.col("__base").isNotNull(), 3).otherwise(4)
    order = [F.col("__kind"), F.when(F.col("__kind") == 2, F.col("turn")), F.col("__base"), F.col("item_id")]
    own = own.withColumn("__kind", kind).withColumn("__place", F.row_number().over(by.orderBy(*order)))
    own = own.withColumn("hard", (F.col("label") == 0) & (F.col("__kind") < 4) & (F.col("__place") <= budget))
    draw = S.digest(F.lit(seed), F.col("qid").cast("string"), F.col("item_id").cast("string"))
    own = own.withColumn("__turn", F.row_number().over(by.orderBy(F.desc("hard"), draw, "item_id")))
    own = own.withColumn("__some", F.max("label").over(Window.partitionBy("qid")))
    kept = own.where((F.col("__some") == 1) & ((F.col("label") == 1) | (F.col("__turn") <= limit)))
    return kept.drop("turn", *(c for c in kept.columns if c.startswith("__")))


def fit_ranker(rows: DataFrame, features: list[str], iterations: int = 20, depth: int = 4, subset: str = "all", seed: int = 42) -> PipelineModel:
    """Gradient-boosted trees on weighted rows (label, weight); depth bounds the leaves."""
    assemble = VectorAssembler(inputCols=features, outputCol="x")
    trees = GBTClassifier(
        featuresCol="x", labelCol="label", weightCol="weight", maxIter=iterations, maxDepth=depth, stepSize=0.1,
        featureSubsetStrategy=subset, seed=seed,
    )
    return Pipeline(stages=[assemble, trees]).fit(rows)


def pair_rows(rows: DataFrame, features: list[str], partners: int = 8, seed: str = "pairs") -> DataFrame:
    """Differences of a positive's features to those of other rows of its query, both ways round: label, weight, x.

    Each positive meets ``partners`` negatives, those after it in a ring by
    hash, so pairs grow with the rows and not with their square; a query's
    pairs weigh 1 in all.
    """
    draw = S.digest(F.lit(seed), F.col("qid").cast("string"), F.col("item_id").cast("string"))
    by = Window.partitionBy("qid", "label")
    own = rows.withColumn("__n", F.row_number().over(by.orderBy(draw, "item_id")) - 1).withColumn("__size", F.count("*").over(by))
    vector = F.array(*(F.col(f).cast("double") for f in features)).alias("v")
    turns = F.explode(F.sequence(F.lit(0), F.lit(partners - 1)))
    good = own.where("label = 1").select("qid", "__n", vector, turns.alias("k"))
    bad = own.where("label = 0").select("qid", F.col("__n").alias("at"), F.col("__size").alias("size"), vector.alias("u"))
    sizes = bad.select("qid", "size").distinct()
    met = good.join(sizes, "qid").where("k < size").withColumn(
        "at", (F.col("__n") * partners + F.col("k")) % F.col("size"),
    ).join(bad.drop("size"), ["qid", "at"])
    way = F.explode(F.array(F.lit(1), F.lit(-1))).alias("way")
    each = met.select("qid", "v", "u", way)
    weight = 1.0 / F.count("*").over(Window.partitionBy("qid"))
    return each.select(
        ((F.col("way") + 1) / 2).alias("label"), weight.alias("weight"),
        array_to_vector(F.zip_with("v", "u", lambda a, b: (a - b) * F.col("way"))).alias("x"),
    )


def fit_pairwise(rows: DataFrame, features: list[str], partners: int = 8, iterations: int = 50, regularisation: float = 1e-3) -> PipelineModel:
    """A linear ranker learned from pairs: logistic regression without intercept on differences; its score orders a query's items.

    Stands in for pairwise boosted trees, which Spark lacks.
    """
    lr = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", fitIntercept=False, maxIter=iterations, regParam=regularisation)
    model = lr.fit(pair_rows(rows, features, partners))
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="x"), model])


def rank_scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def prefix_scores(model: PipelineModel, rows: DataFrame, stages: list[int]) -> DataFrame:
    """Probabilities of the first n trees for each n of ``stages``, as columns p<n>."""
    trees: GBTClassificationModel = model.stages[-1]
    if any(n < 1 or n > len(trees.trees) for n in stages):
        raise ValueError(f"stages must lie between 1 and {len(trees.trees)}")
    out = model.stages[0].transform(rows)
    total, kept = F.lit(0.0), []
    for i, (tree, w) in enumerate(zip(trees.trees[: max(stages)], trees.treeWeights, strict=False), 1):
        out = tree.setFeaturesCol("x").setPredictionCol(f"__t{i}").transform(out)
        total = total + F.col(f"__t{i}") * w
        if i in stages:
            kept.append((F.lit(1.0) / (1 + F.exp(-2 * total))).alias(f"p{i}"))
    return out.select(*rows.columns, *kept)
