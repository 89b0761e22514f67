"""Options of a run, with the combinations that have no meaning refused."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Options:
    method: str = "hybrid"
    split: str = "queries"
    fraction: float = 0.2
    seed: int = 42
    depth: int = 50
    limit: int = 50
    rank_constant: int = 60
    channel_quota: int = 0
    location_bonus: float = 0.0
    sweep: bool = False
    stem_title: float = 0.0
    stem_params: float = 0.0
    geo_depth: int = 0
    geo_places: int = 3
    geo_history: int = 20
    geo_weight: float = 0.25
    geo_related: bool = False
    geo_leave_out: bool = False
    lexical_weight: float = 1.0
    dense_weight: float = 1.0
    dense_geo: float = 0.0
    category_depth: int = 0
    category_weight: float = 0.0
    supplemental: bool = False
    version: int = 4
    negatives: int = 64
    category_prior: bool = True
    exact_bonus: float = 0.0
    max_queries: int = 0

    def __post_init__(self) -> None:
        def need(ok: bool, text: str) -> None:
            if not ok:
                raise ValueError(text)

        need(self.method in ("bm25", "dense", "hybrid"), "method is bm25, dense or hybrid")
        need(self.split in ("pairs", "queries", "all"), "split is pairs, queries or all")
        need(self.method != "dense" or not self.location_bonus, "a dense run has no location bonus")
        need(self.method != "dense" or not self.geo_depth, "a dense run has no geographic channels")
        need(not self.sweep or (self.method == "hybrid" and not self.channel_quota), "a sweep needs the hybrid method and no quota")
        need(not self.geo_related or self.geo_depth > 0, "related places need geographic channels")
        need(self.method == "hybrid" or not (self.category_depth or self.supplemental), "category and supplemental channels belong to the hybrid method")
        need(not (self.supplemental and self.category_depth), "supplemental channels hold the category route already")
        need(not (self.category_depth or self.supplemental) or self.split != "pairs", "category channels need a split by queries or all")
        need(self.version in (4, 5, 6, 7, 8), "feature versions are 4 to 8")
        need(self.version < 7 or self.method == "hybrid", "versions 7 and 8 need the hybrid method")
        need(self.version not in (6, 8) or self.method != "bm25", "versions 6 and 8 need vectors")
        need(
            0 < self.fraction < 1 and self.depth > 0 and self.limit > 0 and self.rank_constant >= 0 and self.channel_quota >= 0,
            "fraction lies between 0 and 1; depth and limit are positive",
        )
        need(
            min(
                self.stem_title, self.stem_params, self.geo_depth, self.geo_weight, self.lexical_weight, self.dense_weight, self.negatives,
                self.max_queries, self.exact_bonus,
            ) >= 0,
            "weights, depths and numbers aren't negative",
        )
        need(self.lexical_weight + self.dense_weight > 0, "some channel must count")

    def identity(self) -> dict:
        """What decides candidates and features, for the check that a model is used where it belongs."""
        free = {"split", "fraction", "sweep", "max_queries", "negatives", "limit", "exact_bonus", "geo_leave_out"}
        return {k: v for k, v in asdict(self).items() if k not in free}
