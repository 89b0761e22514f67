"""Catalogues, partitions, answers, validation, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage
from ..functions import scalar as S
from ..functions import text as X


def sources(train: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """(key, source): overlap, train_only or benchmark_only."""
    t, b = train.select(key).distinct().withColumn("t", F.lit(True)), benchmark.select(key).distinct().withColumn("b", F.lit(True))
    joined = t.join(b, key, "full_outer")
    return joined.select(key, F.when(F.col("t").isNull(), "benchmark_only").when(F.col("b").isNull(), "train_only").otherwise("overlap").alias("source"))


def catalog(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """One row per key: of the first source that has it, its first row."""
    union = parts[0].withColumn("src", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        union = union.unionByName(p.withColumn("src", F.lit(i)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("src", order))
    return union.withColumn("rn", rank).where("rn = 1").drop("rn")


def sample(keys: DataFrame, key: str, salt: str, n: int) -> DataFrame:
    """The n keys of least salted hash; the same keys for the same salt, however the table is stored."""
    return keys.select(key).distinct().withColumn("h", S.salted_digest(salt, F.col(key))).orderBy("h", key).limit(n)


def partitions(keys: DataFrame, key: str, salt: str, sizes: dict[str, int], rest: str) -> DataFrame:
    """Keys dealt by hash order into partitions of fixed sizes and the rest.

    Only the fixed sizes are taken in order (a bounded number of keys); the
    rest is told apart by the last hash taken.
    """
    hashed = keys.select(key).distinct().withColumn("h", S.salted_digest(salt, F.col(key)))
    names, bounds, total = list(sizes), [], 0
    for n in names:
        total += sizes[n]
        bounds.append(total)
    head = [(r["h"], r[key]) for r in hashed.orderBy("h", key).limit(total).collect()]
    out, last = F.lit(rest), [head[min(b, len(head)) - 1] for b in bounds if head]
    for n, (h, k) in reversed(list(zip(names, last, strict=False))):
        out = F.when((F.col("h") < h) | ((F.col("h") == h) & (F.col(key) <= k)), n).otherwise(out)
    return hashed.withColumn("partition", out)


def cold(
    clicks: DataFrame, items: DataFrame, historic: DataFrame, salt: str, sizes: dict[str, int], rest: str, catalog_size: int,
) -> tuple[DataFrame, DataFrame]:
    """A protocol over texts that were never seen: the catalogue (item_id) and a manifest (text, partition, key, item_ids), both by salted hashes.

    Texts of ``historic`` leave; the others are dealt into partitions of fixed
    sizes and the rest.  The catalogue holds every item that a remaining text
    clicked, and of the others those of least hash, ``catalog_size`` in all
    (more only where more are clicked).  Each text is represented by the key of
    least hash; its items are all that its keys clicked.  ``clicks``: text, key,
    item_id.
    """
    fresh = clicks.withColumn("text", X.normalize(F.col("text"))).join(
        historic.select(X.normalize(F.col("text")).alias("text")).distinct(), "text", "left_anti",
    )
    dealt = partitions(fresh.select("text"), "text", salt, sizes, rest).select("text", "partition")
    known = fresh.join(items.select("item_id").distinct(), "item_id", "left_semi")
    clicked = known.select("item_id").distinct()
    others = items.select("item_id").distinct().join(clicked, "item_id", "left_anti").withColumn("h", S.salted_digest(salt, F.col("item_id").cast("string")))
    room = max(0, catalog_size - clicked.count())
    catalogue = clicked.unionByName(others.orderBy("h", "item_id").limit(room).select("item_id"))
    first = representatives(known.select("text", "key").distinct(), "text", "key", salt).select("text", "key")
    found = known.groupBy("text").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))  # the clicks of one text
    return catalogue, dealt.join(first, "text").join(found, "text").select("text", "partition", "key", "item_ids")


def representatives(rows: DataFrame, text: str, key: str, salt: str) -> DataFrame:
    """One row of each text: that of least salted hash of its key."""
    hashed = rows.withColumn("h", S.salted_digest(salt, F.col(key).cast("string")))
    rank = F.row_number().over(Window.partitionBy(text).orderBy("h", key))
    return hashed.withColumn("rn", rank).where("rn = 1").drop("rn")


def is_item_id(c: Column) -> Column:
    """Sixteen lower-case hexadecimal digits, nothing else."""
    return c.rlike("\\A[0-9a-f]{16}\\z")


def is_query_id(c: Column) -> Column:
    return F.length(c) == 16


def answers(ranked: DataFrame) -> DataFrame:
    """(query_id, answer): ids joined by spaces in rank order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"].cast("string"))
    return ranked.groupBy(F.col("qid").alias("query_id")).agg(F.concat_ws(" ", ids).alias("answer"))


def violations(answer: DataFrame, queries: DataFrame, corpus: DataFrame, most: int = 50, strict: bool = False) -> DataFrame:
    """How many rows break each rule of an answer file; all zero for a valid one.

    With ``strict`` also the forms of ids: query ids of 16 characters, item ids
    of 16 lower-case hexadecimal digits, single spaces between them.  The
    answer is worked out once.
    """
    answer = storage.stored(answer.select("query_id", "answer"), "answer")
    ids = answer.withColumn("ids", F.filter(F.split("answer", " "), lambda x: x != ""))
    known = queries.select(F.col("qid").alias("query_id")).distinct()
    rules = {"too_many": F.size("ids") > most, "repeated_item": F.size("ids") != F.size(F.array_distinct("ids"))}
    if strict:
        rules |= {
            "query_id_form": ~is_query_id(F.col("query_id").cast("string")),
            "item_id_form": F.exists("ids", lambda x: ~is_item_id(x)) | (F.col("answer") != F.array_join("ids", " ")),
        }
    flagged = ids.agg(*(F.count_if(r).alias(n) for n, r in rules.items()))
    told = flagged.select(F.inline(F.array(*(F.struct(F.lit(n).alias("violation"), F.col(n).alias("n")) for n in rules))))
    items = ids.select(F.explode("ids").alias("id")).join(corpus.select(F.col("item_id").cast("string").alias("id")).distinct(), "id", "left_anti")
    found = {
        "missing_query": known.join(answer, "query_id", "left_anti"), "unknown_query": answer.join(known, "query_id", "left_anti"),
        "unknown_item": items, "repeated_query": answer.groupBy("query_id").count().where("count > 1"),
    }
    for name, rows in found.items():
        told = told.unionByName(rows.agg(F.lit(name).alias("violation"), F.count("*").alias("n")))
    return told


def allowed(rows: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose normalised text is on a list; an empty list is an error."""
    if texts.isEmpty():
        raise ValueError("the list of allowed texts is empty")
    listed = texts.select(X.normalize(F.col(text)).alias("__t")).distinct()
    return rows.join(listed, X.normalize(F.col(text)) == F.col("__t"), "left_semi")


#: The fields that make a query's key, in order.
KEY = ("text", "location", "delivery", "filters", "category")


def query_key(columns: tuple[str, ...] = KEY) -> Column:
    """A query's identity: the canonical JSON array of its normalised fields."""
    return F.to_json(F.array(*(X.normalize(F.col(c).cast("string")) for c in columns)))


def split(clicks: DataFrame, mode: str, fraction: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Fit and validation clicks by a hash: of the query's text, of the pair of a whole query key and the item, or all for validation."""
    if mode == "all":
        return clicks.where(F.lit(False)), clicks
    if mode == "queries":
        held = S.held_out(X.normalize(F.col("text")), fraction, seed)
    else:
        nested = F.concat(F.lit(f"[{seed},["), query_key(), F.lit(","), F.expr("substring(to_json(array(cast(item_id AS string))), 2)"), F.lit("]"))
        number = F.conv(F.substring(F.sha2(nested, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
        held = number / F.lit(2.0**64) < fraction
    return clicks.where(~held), clicks.where(held)


def audit_rows(pool: DataFrame, truth: DataFrame, strata: DataFrame, partitions: DataFrame) -> DataFrame:
    """Every pool row with its label, its query's flags and its text's partition, as an audit reads them.

    ``strata``: qid, text, flags; ``partitions``: text (normalised), partition.
    """
    labelled = pool.join(truth.select("qid", "item_id", F.lit(1).alias("label")), ["qid", "item_id"], "left").na.fill(0, ["label"])
    own = strata.withColumn("text", X.normalize(F.col("text"))).join(partitions.select("text", "partition"), "text")
    return labelled.join(own, "qid")


def popular_fill(ranked: DataFrame, queries: DataFrame, clicks: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Rankings filled up to ``limit`` with the most clicked items of the corpus that a query hasn't got, ties by id."""
    counts = clicks.join(items.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "item_id").limit(2 * limit)  # enough for any query: at most ``limit`` are taken already
    sizes = queries.select("qid").distinct().join(
        ranked.groupBy("qid").agg(F.count("*").alias("had")), "qid", "left",
    ).withColumn("had", F.coalesce("had", F.lit(0))).where(F.col("had") < limit)
    offered = sizes.crossJoin(F.broadcast(top)).join(ranked.select("qid", "item_id"), ["qid", "item_id"], "left_anti")
    offered = offered.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "item_id"))).where(F.col("had") + F.col("k") <= limit)
    return ranked.select("qid", "item_id", "rank").unionByName(offered.select("qid", "item_id", (F.col("had") + F.col("k")).cast("long").alias("rank")))


def islands(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, islands, n): in how many runs each group's rows lie in the given order; 1 for a contiguous group.

    The order is dealt into ranges; a range's first row is compared with the
    last of the range before it, so no task sees the whole table.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    before = F.lag(group).over(Window.partitionBy("part").orderBy("pos"))
    marked = ordered.withColumn("new", F.when(before == F.col(group), 0).otherwise(1))
    ends = marked.groupBy("part").agg(F.min_by(group, "pos").alias("head"), F.max_by(group, "pos").alias("tail"))  # a row for each range
    seam = ends.withColumn(
        "last", F.lag("tail").over(Window.orderBy("part")),
    ).where("head = last").groupBy(F.col("head").alias(group)).agg(F.count("*").alias("joined"))
    runs = marked.groupBy(group).agg(F.sum("new").alias("runs"), F.count("*").alias("n"))
    return runs.join(F.broadcast(seam), group, "left").select(group, (F.col("runs") - F.coalesce("joined", F.lit(0))).alias("islands"), "n")


def fingerprint(rows: DataFrame, buckets: int = 4096) -> DataFrame:
    """Order-free digest of a table: rows' digests are sorted in buckets by their front, the buckets' digests give the last.

    A null differs from any text.  A task holds one bucket's digests, 64 bytes
    a row; take more buckets for a table of billions (the digest depends on
    their number).
    """
    each = rows.select(F.sha2(F.to_json(F.array(*(F.col(f"`{c}`").cast("string") for c in rows.columns))), 256).alias("h"))
    dealt = each.withColumn("b", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets)
    parts = dealt.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return parts.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("b").cast("string"), 12, "0"), "d"))), "\n"), 256).alias("fingerprint"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
