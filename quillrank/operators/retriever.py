"""What can be searched: anything that answers queries with channels of the long table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bm25, hybrid, vectors
from .blocks import Search


class Retriever(Protocol):
    def channels(self, queries: DataFrame) -> DataFrame:
        """(qid, channel, ch_ord, weight, item_id, rank, raw_score) for queries (qid, text, location, ...)."""
        ...


@dataclass
class Lexical:
    """Fields, stems among them, from a stored index of counts; geographic channels where there are destinations."""

    items: DataFrame
    index: DataFrame
    plan: hybrid.Plan
    fields: tuple[bm25.Field, ...] = bm25.FIELDS
    stems: tuple[str, ...] = ()
    destinations: DataFrame | None = None

    def search(self, queries: DataFrame, text: str = "text") -> Search:
        plain = tuple(f for f, _ in self.plan.fields if f not in self.stems)
        terms = bm25.stem_queries(bm25.query_terms(queries, text=text), plain, self.stems)
        about = self.items.select("item_id", F.col("location").alias("place"), F.col("microcat").alias("cat"))
        return Search(self.index, terms, self.fields, about)

    def channels(self, queries: DataFrame) -> DataFrame:
        places = self.destinations if self.destinations is not None else queries.select("qid", F.lit("").alias("place")).limit(0)
        found = self.search(queries).best(self.plan.depth, self.destinations, self.plan.geo_depth)
        return hybrid.lexical_channels(found, places, self.items, self.plan)


@dataclass
class Dense:
    """The nearest items by vectors (query_vectors: text, embedding; item_vectors: item_id, embedding)."""

    items: DataFrame
    query_vectors: DataFrame
    item_vectors: DataFrame
    depth: int = 50
    order: int = 10
    weight: float = 1.0

    def channels(self, queries: DataFrame) -> DataFrame:
        return vectors.channel(queries, self.items, self.query_vectors, self.item_vectors, self.depth, self.order, self.weight)


@dataclass
class Together:
    """Several retrievers' channels in one table."""

    parts: list[Retriever]

    def channels(self, queries: DataFrame) -> DataFrame:
        columns = ["qid", "channel", "ch_ord", "weight", "item_id", "rank", "raw_score"]
        out = self.parts[0].channels(queries).select(*columns)
        for p in self.parts[1:]:
            out = out.unionByName(p.channels(queries).select(*columns))
        return out
