"""A category model over query texts: TF-IDF of words and characters, weighted logistic regression, models that leave folds out.

A text that a model was fitted on is only ever scored by the model of the fold
that excluded it; all other texts go to the model of all folds.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import storage
from ..functions import scalar as S
from ..functions import text as X
from ..shipping import ship
from . import integrity
from .stemming import stem


@dataclass(frozen=True)
class Settings:
    folds: int = 3
    seed: int = 42
    least: int = 2
    words: int = 20_000
    characters: int = 50_000
    iterations: int = 15
    regularisation: float = 1e-4


class _Grams:
    """Grams of normalised texts: n-grams of stems, one or two, and of characters within words padded by spaces, two to four."""

    def __init__(self, token: str, gone: str) -> None:
        self.find, self.gone = re.compile(token).findall, re.compile(gone) if gone else None
        self.stem, self.characters = lru_cache(100_000)(stem), lru_cache(100_000)(self._characters)

    @staticmethod
    def _characters(word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]

    def of(self, text: str) -> tuple[list[str], list[str]]:
        """All occurrences of both kinds."""
        cut = self.find(self.gone.sub(" ", text) if self.gone and not text.isascii() else text)
        stems = list(map(self.stem, cut))
        return stems + [f"{a} {b}" for a, b in zip(stems, stems[1:], strict=False)], list(chain.from_iterable(map(self.characters, filter(None, text.split(" ")))))


def _dealt(texts: DataFrame) -> DataFrame:
    """Texts dealt out for all cores: they are few bytes with much work each, and adaptive execution would leave them to one task."""
    return texts.repartition(3 * texts.sparkSession.sparkContext.defaultParallelism, "text")


#: Counts that a task holds before it hands them on.
HELD = 500_000


def _frequencies(texts: DataFrame) -> DataFrame:
    """(fold, kind, g, df): texts of each fold with a gram, counted where they are read; stored."""
    ship(texts.sparkSession)
    patterns = X.token_pattern(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, size = _Grams(*patterns), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for (fold, kind), n in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold] * len(n), pa.int32()), pa.array([kind] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())],
                    ["fold", "kind", "g", "df"],
                )

        for batch in batches:
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                for kind, every in zip(("words", "characters"), grams.of(text), strict=True):
                    own = held.setdefault((fold, kind), Counter())
                    size -= len(own)
                    own.update(set(every))
                    size += len(own)
                if size >= HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    each = texts.select("text", F.col("fold").cast("int").alias("fold")).mapInArrow(run, "fold int, kind string, g string, df long")
    return storage.stored(each.groupBy("fold", "kind", "g").agg(F.sum("df").alias("df")), "category-grams")


def _vocabulary(frequencies: DataFrame, documents: int, s: Settings) -> DataFrame:
    """(kind, g, id, idf): the most frequent grams of each kind in at least ``least`` texts; as many as the settings say at most."""
    df = frequencies.groupBy("kind", "g").agg(F.sum("df").alias("df")).where(F.col("df") >= s.least)
    own = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("df"), "g"))
    head = lambda kind, most: df.where(F.col("kind") == kind).orderBy(F.desc("df"), "g").limit(most)
    kept = head("words", s.words).unionByName(head("characters", s.characters)).withColumn("own", own)  # as many as the settings say
    number = F.when(F.col("kind") == "words", F.col("own") - 1).otherwise(s.words + F.col("own") - 1).cast("int")
    return storage.stored(
        kept.select("kind", "g", number.alias("id"), (F.ln((1 + F.lit(documents)) / (1 + F.col("df"))) + 1).alias("idf")),
        "category-vocabulary",
    )


def _vectors(rows: DataFrame, vocabulary: DataFrame, s: Settings) -> DataFrame:
    """``rows`` (text, ...) with ``x``: both blocks at length 1 side by side, made where a text is read; a text without known grams has zeros."""
    spark = rows.sparkSession
    ship(spark)
    size, patterns = s.words + s.characters, X.token_pattern(spark)
    known: dict[str, dict[str, int]] = {"words": {}, "characters": {}}
    idf = np.zeros(size)
    for r in vocabulary.collect():  # as many as the settings say
        known[r["kind"]][r["g"]] = r["id"]
        idf[r["id"]] = r["idf"]
    sent = spark.sparkContext.broadcast((known, idf))
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, idf), grams = sent.value, _Grams(*patterns)
        get = [known[k].get for k in ("words", "characters")]

        def vector(text: str) -> dict[str, object]:
            ids, values = [], []
            for of, every in zip(get, grams.of(text), strict=True):
                own, tf = np.unique(np.array([i for i in map(of, every) if i is not None], np.int32), return_counts=True)
                w = (1 + np.log(tf)) * idf[own]
                ids.append(own)
                values.append(w / np.sqrt(np.sum(w * w)) if len(w) else w)
            return {"type": 0, "size": size, "indices": np.concatenate(ids), "values": np.concatenate(values)}

        kind = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                x = pa.array([vector(t) for t in part.column("text").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), x], [*names, "x"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("x", VectorUDT())]))


#: Vectors made at once.
ROWS = 512


@dataclass
class TextModel:
    """One fitted model: grams with their weights, classes, and the regression; a single class needs none."""

    vocabulary: DataFrame
    classes: list[str]
    regression: LogisticRegressionModel | None

    def probabilities(self, texts: DataFrame, s: Settings) -> DataFrame:
        """(text, cat, prob) of every class for distinct normalised texts."""
        if self.regression is None:
            return texts.select("text", F.lit(self.classes[0]).alias("cat"), F.lit(1.0).alias("prob"))
        scored = self.regression.transform(_vectors(texts.select("text"), self.vocabulary, s))
        names = F.array(*map(F.lit, self.classes))
        each = scored.select("text", F.posexplode(vector_to_array("probability")).alias("k", "prob"))
        return each.select("text", F.get(names, F.col("k")).alias("cat"), "prob")


def _fit(examples: DataFrame, frequencies: DataFrame, s: Settings) -> TextModel:
    vocabulary = _vocabulary(frequencies, examples.select("text").distinct().count(), s)
    classes = [r["cat"] for r in examples.select("cat").distinct().orderBy("cat").collect()]  # the categories
    if len(classes) < 2:
        return TextModel(vocabulary, classes, None)
    number = F.create_map(*(F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))))
    rows = _vectors(examples.select("text", F.element_at(number, F.col("cat")).alias("y"), "weight"), vocabulary, s).select("x", "y", "weight")
    lr = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=s.iterations, regParam=s.regularisation, family="multinomial")
    return TextModel(vocabulary, classes, lr.fit(rows))


@dataclass
class CategoryModel:
    """The model of all texts (key -1), one for each fold that leaves it out, and the texts they were fitted on."""

    models: dict[int, TextModel]
    fitted: DataFrame  # text, fold
    settings: Settings
    fingerprint: str

    def predict(self, texts: DataFrame) -> DataFrame:
        """(text, cat, prob, by) of distinct texts (column text), normalised; ``by`` is the model that was asked."""
        asked = storage.stored(
            _dealt(
                texts.select(X.normalize(F.col("text")).alias("text")).distinct().join(self.fitted, "text", "left").select(
                    "text", F.coalesce("fold", F.lit(-1)).alias("by"),
                )
            ),
            "category-asked",
        )
        out = None
        for k, model in self.models.items():
            one = model.probabilities(asked.where(F.col("by") == k).select("text"), self.settings).withColumn("by", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out

    def assert_unseen(self, predictions: DataFrame) -> None:
        """A fitted text must have been scored by its own fold's model."""
        wrong = predictions.join(self.fitted, "text", "left").where(F.col("by") != F.coalesce("fold", F.lit(-1)))
        if not wrong.isEmpty():
            raise ValueError("a fitted text was scored by a model that has seen it")

    def save(self, path: str) -> None:
        """Everything under one folder; an existing one is never overwritten."""
        spark = self.fitted.sparkSession
        for k, m in self.models.items():
            m.vocabulary.write.mode("errorifexists").parquet(f"{path}/{k}/vocabulary")
            if m.regression is not None:
                m.regression.save(f"{path}/{k}/regression")
        self.fitted.write.mode("errorifexists").parquet(f"{path}/fitted")
        about = {
            "settings": vars(self.settings), "classes": {str(k): m.classes for k, m in self.models.items()},
            "constant": [k for k, m in self.models.items() if m.regression is None], "fingerprint": self.fingerprint,
        }
        spark.createDataFrame([(json.dumps(about, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CategoryModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        models = {}
        for k, classes in about["classes"].items():
            regression = None if int(k) in about["constant"] else LogisticRegressionModel.load(f"{path}/{k}/regression")
            models[int(k)] = TextModel(spark.read.parquet(f"{path}/{k}/vocabulary"), classes, regression)
        return CategoryModel(models, spark.read.parquet(f"{path}/fitted"), Settings(**about["settings"]), about["fingerprint"])


def fit(examples: DataFrame, s: Settings = Settings()) -> CategoryModel:
    """Models from (text, cat, weight): of all texts, and with ``folds`` of two or more one without each fold; every text lies in one fold."""
    rows = examples.where("coalesce(cat, '') NOT IN ('', '0')").select(
        X.normalize(F.col("text")).alias("text"), F.col("cat").cast("string").alias("cat"), "weight",
    )
    fold: Column = S.fold(F.col("text"), s.folds, s.seed) if s.folds > 1 else F.lit(-1)
    rows = storage.stored(_dealt(rows.withColumn("fold", fold)), "category-examples")
    if rows.isEmpty():
        raise ValueError("there are no examples with a category")
    fitted = storage.stored(_dealt(rows.select("text", "fold").distinct()), "category-texts")
    frequencies = _frequencies(fitted)
    models = {-1: _fit(rows, frequencies, s)}
    for k in range(s.folds if s.folds > 1 else 0):
        rest = rows.where(F.col("fold") != k)
        if not rest.isEmpty():
            models[k] = _fit(rest, frequencies.where(F.col("fold") != k), s)
    held = [k for k in models if k >= 0]
    if s.folds > 1 and not fitted.where(~F.col("fold").isin(held)).isEmpty():
        raise ValueError("a fold has all examples, so no model can leave it out")
    mark = integrity.counts_fingerprint(rows.groupBy("text", "cat").agg(F.count("*").alias("n")), ["text", "cat"], "n").first()["digest"]
    return CategoryModel(models, fitted, s, mark)
