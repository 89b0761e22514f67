"""A run over a shop's tables: retrieval by the options, features, training rows and rankings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .config import Options
from .functions import scalar as S
from .functions import text as X
from .operators import bm25, category, category_model, evaluation, features, fusion, geo, hybrid, learning, retriever, vectors

_QUERY = ("text", "location", "filters", "category", "delivery")
_ITEM = ("title", "params", "description", "category", "location", "microcat", "price", "rating", "reviews", "phone_hidden", "message_forbidden")


def filled(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The frame with these columns as strings; missing ones and nulls are empty."""
    have = set(df.columns)
    return df.select(
        *(c for c in df.columns if c not in names),
        *((F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")).alias(n) for n in names)
    )


def asked(clicks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries of a click log, one for each key of its five fields, and the truth (qid, text, item_id)."""
    rows = filled(clicks, _QUERY)
    keyed = rows.withColumn("qid", S.digest(*(X.normalize(F.col(c)) for c in _QUERY)))
    queries = keyed.groupBy("qid").agg(F.min(F.struct(*_QUERY)).alias("q")).select("qid", "q.*")
    return queries, keyed.select("qid", "text", "item_id").distinct()


@dataclass
class Run:
    """Items, the clicks it may learn from, vectors and a category model; answers queries (qid and the query's fields)."""

    items: DataFrame
    options: Options
    clicks: DataFrame | None = None
    embedded: tuple[DataFrame, DataFrame] | None = None  # (text, embedding), (item_id, embedding)
    categories: category_model.CategoryModel | None = None
    filter_keys: dict[str, bool] = field(default_factory=dict)  # key of a filter: whether its values say what an item is

    def __post_init__(self) -> None:
        o = self.options
        self.items = filled(self.items, _ITEM)
        if o.method != "bm25" and self.embedded is None:
            raise ValueError(f"the method {o.method} needs vectors of items and queries")
        if (o.category_depth or o.supplemental or o.version >= 7) and self.categories is None:
            raise ValueError("category channels and versions 7 and 8 need a category model")
        if o.geo_depth and self.clicks is None:
            raise ValueError("geographic channels need clicks")

    @cached_property
    def plan(self) -> hybrid.Plan:
        o = self.options
        fields = [(f.name, f.weight) for f in bm25.FIELDS] + [(n, w) for n, w in (("title_stem", o.stem_title), ("params_stem", o.stem_params)) if w]
        lexical = o.lexical_weight if o.method == "hybrid" else sum(w for _, w in fields)
        return hybrid.Plan(
            tuple(fields), o.depth, o.geo_depth, o.geo_weight, lexical, o.dense_weight if o.method == "hybrid" else 1.0, o.rank_constant,
            o.channel_quota, o.location_bonus,
        )

    @cached_property
    def stems(self) -> dict[str, str]:
        """Fields of stems, and the fields they come from."""
        return {n: n.removesuffix("_stem") for n, _ in self.plan.fields if n.endswith("_stem")}

    @cached_property
    def fields(self) -> tuple[bm25.Field, ...]:
        own = {f.name: f for f in bm25.FIELDS}
        return bm25.FIELDS + tuple(bm25.Field(n, own[s].k1, own[s].b, dict(self.plan.fields)[n]) for n, s in self.stems.items())

    @cached_property
    def index(self) -> DataFrame:
        """Counts of the fields and stems, stored."""
        return bm25.counted(self.items, self.fields, self.stems)

    @cached_property
    def counts(self) -> DataFrame:
        return storage.stored(geo.associations(self.history), "associations")

    @cached_property
    def own_counts(self) -> DataFrame:
        return storage.stored(geo.associations(self.history.withColumn("text", X.normalize(F.col("text"))), by_text=True), "associations")

    @cached_property
    def history(self) -> DataFrame:
        """The clicks with the places searched and found, and the found items' categories."""
        if self.clicks is None:
            raise ValueError("this needs clicks")
        own = filled(self.clicks, _QUERY).select("text", F.col("location").alias("search_loc"), "item_id")
        return own.join(self.items.select("item_id", F.col("location").alias("item_loc"), F.col("microcat").alias("cat")), "item_id")

    def counts_for(self, queries: DataFrame) -> DataFrame:
        if not self.options.geo_leave_out:
            return self.counts
        return geo.without_own_text(queries, self.counts, self.own_counts)

    def destinations(self, queries: DataFrame, with_related: bool = False) -> DataFrame:
        o = self.options
        return geo.destinations(queries, self.items, self.counts_for(queries), o.geo_history, o.geo_places, with_related)

    def predicted(self, queries: DataFrame) -> DataFrame:
        """(qid, cat, prob): whole distributions, a fitted text's from the model that left it out."""
        texts = queries.select("qid", S.category_query_text(F.col("text"), F.col("filters"), F.col("category")).alias("text"))
        said = self.categories.predict(texts)
        self.categories.assert_unseen(said)
        return storage.stored(texts.withColumn("text", X.normalize(F.col("text"))).join(said, "text").select("qid", "cat", "prob"), "predicted")

    def _lexical(self) -> retriever.Lexical:
        return retriever.Lexical(self.items, self.index, self.plan, self.fields, tuple(self.stems))

    def valued(self, queries: DataFrame) -> DataFrame:
        """Queries with text and the values of their filters, as category and supplemental routes search."""
        keys = self.filter_keys
        values = X.filter_values(F.col("filters"), list(keys), {k for k, v in keys.items() if v}) if keys else X.normalize(F.col("filters"))
        return queries.withColumn("__valued", F.concat_ws(" ", "text", values))

    def dense(self, queries: DataFrame, depth: int) -> DataFrame:
        out = vectors.channel(queries, self.items, *self.embedded, depth, order=2 * len(self.plan.fields), weight=self.plan.dense)
        return out

    def channels(self, queries: DataFrame) -> DataFrame:
        """The long table of all channels that the options ask for, stored."""
        o, queries = self.options, filled(queries, _QUERY)
        columns = ["qid", "channel", "ch_ord", "weight", "item_id", "rank", "raw_score"]
        parts = []
        if o.method != "dense" and self.plan.lexical > 0:
            own = self._lexical()
            if o.geo_depth:
                own.destinations = storage.stored(self.destinations(queries), "destinations")
            parts.append(own.channels(queries))
        if o.method != "bm25" and self.plan.dense > 0:
            parts.append(self.dense(queries, o.depth))
        out = parts[0].select(*columns)
        for p in parts[1:]:
            out = out.unionByName(p.select(*columns))
        out = storage.stored(out, "channels")
        if o.category_depth or o.supplemental:
            scored = self._lexical().search(self.valued(queries), "__valued")
            route = category.channel(scored, self.predicted(queries), self.items, queries, hybrid.CAPACITY, bonus=o.location_bonus)
            if o.supplemental:
                top = bm25.top_k(scored.best(hybrid.CAPACITY, only=("title", "params")), hybrid.CAPACITY, ["field", "qid"]).select(
                    "qid", F.concat(F.lit("supplemental_"), "field", F.lit("_values")).alias("channel"), F.col("doc").alias("item_id"),
                    "rank", F.col("score").alias("raw_score"),
                )
                deep = self.dense(queries, hybrid.CAPACITY).select("qid", F.lit("supplemental_dense_current").alias("channel"), "item_id", "rank", "raw_score")
                routes = storage.stored(
                    top.unionByName(route.select("qid", F.lit("micro_combined").alias("channel"), "item_id", "rank", "raw_score")).unionByName(deep),
                    "routes",
                )
                more = hybrid.supplemental_channels(routes, out)
            else:
                more = hybrid.novel_channel(route, out, "micro_combined", 15, o.category_depth, weight=o.category_weight)
            out = storage.stored(out.unionByName(more.select(*columns)), "channels")
        if o.geo_related and o.method != "dense":
            exact = self.destinations(queries).where("exact").select("qid")
            places = self.destinations(queries, with_related=True).where("not exact").join(exact, "qid", "left_semi").select("qid", "place")
            more = hybrid.related_channels(self._lexical().search(queries).best(0, places, self.plan.geo_depth), places, self.items, out, self.plan)
            out = storage.stored(out.unionByName(more.select(*columns)), "channels")
        return out

    def scores(self, channels: DataFrame, queries: DataFrame) -> DataFrame:
        return hybrid.fused(channels, filled(queries, _QUERY), self.items, self.plan)

    def ranked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Channels and the final ranking of the search itself."""
        channels = self.channels(queries)
        return channels, fusion.fuse(self.scores(channels, queries), self.options.limit, self.options.channel_quota)

    def signals(self, channels: DataFrame, queries: DataFrame) -> features.Signals:
        o, s = self.options, features.Signals()
        if o.geo_depth:
            s.destinations = self.destinations(queries)
        if self.clicks is not None:
            if o.category_prior:
                texts = queries.select("qid", X.normalize(F.col("text")).alias("text"))
                shares = category.text_shares(self.history)
                s.token_prior = category.prior_scores(texts.select("text").distinct(), shares, leave_out=o.geo_leave_out).join(texts, "text")
            places = self.items.select(F.col("location").alias("item_loc"))
            if o.geo_leave_out:
                s.history = geo.click_features(self.counts_for(queries), places, o.geo_history, by="qid")
            else:
                own = geo.click_features(self.counts, places, o.geo_history)
                s.history = own.join(queries.select("qid", F.col("location").alias("search_loc")), "search_loc").drop("search_loc")
        if o.version >= 7:
            s.classifier = self.predicted(queries)
        if o.version in (6, 8):
            s.full_dense = self.pool_cosines(channels, queries)
        return s

    def pool_cosines(self, channels: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, item_id, score): exact cosine of every pool item whose query has text."""
        normal = X.normalize(F.col("text"))
        known = self.embedded[0].groupBy(normal.alias("nt")).agg(F.min("embedding").alias("embedding"))
        q = queries.select(F.col("qid").alias("own"), normal.alias("nt")).join(known, "nt").select("own", "embedding")
        return vectors.score_pool(channels.select("qid", "item_id").distinct(), q, self.embedded[1].withColumnRenamed("item_id", "own"), key="own")

    def features(self, channels: DataFrame, queries: DataFrame, only: DataFrame | None = None) -> DataFrame:
        queries = filled(queries, _QUERY)
        scores = self.scores(channels, queries)
        top = fusion.fuse(scores, 50, self.options.channel_quota)
        return features.rows(
            channels, scores, top, queries, self.items, self.options.version, self.signals(channels, queries), self.options.rank_constant,
            only,
        )

    def training_rows(self, queries: DataFrame, truth: DataFrame) -> DataFrame:
        """Features, label and weight of sampled pool rows, with what identifies their groups."""
        o, queries = self.options, filled(queries, _QUERY)
        channels = self.channels(queries)
        pool = fusion.pool(channels)
        labelled = pool.join(truth.select("qid", "item_id", F.lit(1).alias("label")).distinct(), ["qid", "item_id"], "left").na.fill(0, ["label"])
        baseline = fusion.fuse(self.scores(channels, queries), 50, o.channel_quota)
        sample = storage.stored(
            evaluation.row_weights(
                learning.training_sample(labelled, baseline, channels, o.negatives, str(o.seed))
            ).select("qid", "item_id", "label", F.col("weight").cast("float").alias("weight")),
            "sample",
        )
        rows = self.features(channels, queries, only=sample)
        about = queries.select(
            "qid", X.normalize(F.col("text")).alias("query_text"),
            F.to_json(F.array(*(X.normalize(F.col(c)) for c in _QUERY))).alias("query_key_json"),
        )
        sizes = truth.groupBy("qid").agg(F.count_distinct("item_id").cast("int").alias("relevant_count"))
        return rows.join(sample, ["qid", "item_id"]).join(about, "qid").join(sizes, "qid").withColumn("group_id", F.sha2("query_key_json", 256))

    def reranked(self, channels: DataFrame, queries: DataFrame, model) -> DataFrame:
        """The pool by a fitted ranker's probability, raised by the text's own clicks in an item's category; ties as the search had them."""
        o, queries = self.options, filled(queries, _QUERY)
        scored = learning.rank_scores(model, self.features(channels, queries))
        if o.exact_bonus and self.clicks is not None:
            clicks = self.history.where("cat NOT IN ('', '0')").groupBy(X.normalize(F.col("text")).alias("text"), "cat").agg(F.count("*").alias("n"))
            named = scored.join(queries.select("qid", X.normalize(F.col("text")).alias("text")), "qid").join(
                self.items.select("item_id", F.col("microcat").alias("cat")), "item_id",
            )
            scored = category.history_bonus(named, clicks, o.exact_bonus)
        return evaluation.rerank(scored.withColumn("pool_rank", -F.col("pool_rank")), o.limit)

    def bonus_sweep(self, channels: DataFrame, queries: DataFrame, truth: DataFrame, bonuses: list[float]) -> DataFrame:
        """Recall of rankings with several bonuses of the query's own place, from one retrieval."""
        from .operators import integrity

        queries = filled(queries, _QUERY)
        scores = fusion.fused_scores(channels, self.options.rank_constant)
        joined = scores.join(queries.select("qid", F.col("location").alias("here")), "qid").join(
            self.items.select("item_id", F.col("location").alias("at")), "item_id",
        )
        grid = fusion.bonus_grid(joined, bonuses, (F.col("at") == F.col("here")) & (F.col("here") != ""), self.options.limit)
        first = S.hash_fraction(F.col("qid"), self.options.seed) < 0.5
        return integrity.bonus_summary(grid, truth.select("qid", "item_id").distinct(), first, queries, self.items)
