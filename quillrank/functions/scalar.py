"""Hashing, numbers, JSON and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

EARTH_KM = 6371.0088


def digest(*parts: Column) -> Column:
    """sha256 of the canonical JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def salted_digest(salt: str, value: Column) -> Column:
    return digest(F.lit(salt), value)


def values_digest(values: Column) -> Column:
    """Aggregate: sha256 of the canonical JSON array of the distinct values, sorted; for sets of bounded size."""
    return F.sha2(F.to_json(F.array_sort(F.collect_set(values))), 256)


def _seeded(seed: int, key: Column) -> Column:
    """First 64 bits of sha256 of the JSON array [seed, key], as a decimal."""
    json = F.concat(F.lit(f"[{seed},"), F.substring(F.to_json(F.array(key)), 2, 2**31 - 1))
    return F.conv(F.substring(F.sha2(json, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fraction(key: Column, seed: int) -> Column:
    return _seeded(seed, key).cast("double") / F.lit(2.0**64)


def held_out(key: Column, fraction: float, seed: int = 42) -> Column:
    return hash_fraction(key, seed) < fraction


def fold(key: Column, folds: int, seed: int = 42) -> Column:
    return (_seeded(seed, key) % folds).cast("int")


def number(c: Column) -> Column:
    """Any value as a finite number; what is none becomes 0."""
    d = c.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def reciprocal_rank(rank: Column, constant: int) -> Column:
    return F.lit(1.0) / (rank + constant)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(
        F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2,
    ) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def distance_kernel(km: Column, scale: float = 40.0, floor: float = 1e-7) -> Column:
    """Exponential decay with a floor; the floor also where a place is unknown."""
    return F.coalesce(F.greatest(F.exp(-km / scale), F.lit(floor)), F.lit(floor))


def clipped(p: Column, low: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(1 - low))


def logit_mix(p: Column, q: Column, alpha: float, floor: float = 1e-4) -> Column:
    """Log odds of p plus alpha times the log of q."""
    c = clipped(p)
    return F.ln(c / (1 - c)) + alpha * F.ln(F.greatest(q, F.lit(floor)))


def log_loss(y: Column, p: Column) -> Column:
    c = clipped(p)
    return -(y * F.ln(c) + (1 - y) * F.log1p(-c))


def entropy(p: Column) -> Column:
    """Entropy of a distribution (array), as a share of the largest possible; 0 for fewer than two classes."""
    total = F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x * F.ln(x))
    return F.when(F.size(p) > 1, total / F.ln(F.size(p).cast("double"))).otherwise(0.0)


def top_mass(p: Column, n: int) -> Column:
    return F.aggregate(F.slice(F.sort_array(p, asc=False), 1, n), F.lit(0.0), lambda s, x: s + x)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


#: Levels of objects and lists that ``filter_atoms`` walks; deeper filters are an error, not a loss.
DEPTH = 12


def _atoms(tree: Column) -> Column:
    """Sorted distinct "filter_<path> <value>" atoms of a variant."""
    none = F.array().cast("array<struct<path:string,value:variant>>")
    pair = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    kind = lambda x: F.schema_of_variant(x)

    def step(s: Column) -> Column:
        """A node's children, a list's with the list's own path; a leaf stays."""
        path, value = s["path"], s["value"]
        inner = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        named = lambda e: pair(F.concat_ws("_", F.nullif(path, F.lit("")), F.replace(X.normalize(e["key"]), F.lit(" "), F.lit("_"))), e["value"])
        listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e: pair(path, e))
        children = F.when(kind(value).startswith("OBJECT"), F.transform(inner, named)).when(kind(value).startswith("ARRAY"), listed).otherwise(F.array(s))
        return F.coalesce(children, none)

    nodes = F.when(tree.isNull(), none).otherwise(F.array(pair(F.lit(""), tree)))
    for _ in range(DEPTH):
        nodes = F.flatten(F.transform(nodes, step))
    deep = F.exists(nodes, lambda s: kind(s["value"]).startswith("OBJECT<") | kind(s["value"]).startswith("ARRAY"))
    texts = F.transform(nodes, lambda s: F.struct(s["path"].alias("path"), X.normalize(F.try_variant_get(s["value"], "$", "string")).alias("text")))
    atoms = F.transform(F.filter(texts, lambda s: s["text"] != ""), lambda s: F.concat(F.lit("filter_"), s["path"], F.lit(" "), s["text"]))
    return F.when(
        deep, F.raise_error(F.lit(f"filters are nested deeper than {DEPTH} levels")).cast("array<string>"),
    ).otherwise(F.array_sort(F.array_distinct(atoms)))


def filter_atoms(json: Column) -> Column:
    """Sorted distinct "filter_<path> <value>" atoms of JSON filters of any shape.

    Keys are normalised, their spaces and the steps of a path become "_";
    values are normalised text (numbers and booleans as JSON writes them);
    lists are sets, objects within them too; nulls and empty values are left
    out.  What is no JSON gives no atoms.
    """
    return _atoms(F.try_parse_json(json))


def category_query_text(text: Column, filters: Column, category: Column) -> Column:
    """Text, filter atoms and "category_<c>" joined by " | ", as a category model reads a query.

    Filters that are no JSON count as one value without a path; the category is
    left out where empty or "0".
    """
    c, raw = X.normalize(category), F.coalesce(filters, F.lit(""))
    plain = X.normalize(raw)
    atoms = F.when(raw == "", F.array().cast("array<string>")).when(
        F.try_parse_json(raw).isNull(),
        F.when(plain != "", F.array(F.concat(F.lit("filter_ "), plain))).otherwise(F.array().cast("array<string>")),
    ).otherwise(filter_atoms(raw))
    tail = F.when((c != "") & (c != "0"), F.array(F.concat(F.lit("category_"), c))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(X.normalize(text)), atoms, tail), " | ")
