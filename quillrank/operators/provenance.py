"""What a fitted model belongs to: its corpus, its settings, its own state.  A mismatch stops scoring."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession

from . import protocol


def identity(items: DataFrame, settings: dict) -> dict:
    """The corpus's fingerprint and the settings that decide candidates and features."""
    return {"corpus": protocol.fingerprint(items).first()["fingerprint"], "settings": settings}


def write(spark: SparkSession, path: str, about: dict) -> None:
    """A JSON document; an existing one is never overwritten."""
    spark.createDataFrame([(json.dumps(about, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def require_same(saved: dict, current: dict) -> None:
    """An error that names every field in which two identities differ."""
    flat = lambda d: {k: json.dumps(v, sort_keys=True) for k, v in ({"corpus": d.get("corpus")} | d.get("settings", {})).items()}
    a, b = flat(saved), flat(current)
    if wrong := sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k)):
        raise ValueError(f"the model belongs to another run: {', '.join(wrong)} differ")


def fitted_fingerprint(model: Transformer) -> str:
    """sha256 of a fitted model's parameters and learned state; the names Spark gives its parts don't count."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    parts = []
    for s in stages:
        params = {p.name: str(s.getOrDefault(p)) for p in s.params if s.isDefined(p) and not p.name.endswith("Col") or p.name == "inputCols" and s.isDefined(p)}
        state = []
        if hasattr(s, "trees"):
            state = [[w, t.toDebugString.split("\n", 1)[1]] for t, w in zip(s.trees, s.treeWeights, strict=True)]
        elif hasattr(s, "coefficientMatrix"):
            state = [s.coefficientMatrix.toArray().tolist(), s.interceptVector.toArray().tolist()]
        parts.append([type(s).__name__, params, state])
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
