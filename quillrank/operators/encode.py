"""Embedding of texts by a model that the caller brings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..shipping import ship


def encoded(rows: DataFrame, text: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], prefix: str = "", batch: int = 64) -> DataFrame:
    """``rows`` with ``embedding``, the unit vector of prefix and text.

    ``load`` runs once in each worker and returns a function from an array of
    texts to an array of vectors.  Null counts as empty; zero vectors stay zero.
    """
    ship(rows.sparkSession)

    def made() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def run(texts: np.ndarray) -> np.ndarray:
            v = np.asarray(model(np.asarray(texts, object)), np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            return v / np.where(norm > 0, norm, 1)

        return run

    udf = predict_batch_udf(made, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return rows.withColumn("embedding", udf(X.prefixed(prefix, F.coalesce(F.col(text), F.lit("")))))
