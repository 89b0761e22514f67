"""Connected components of an edge table, without bringing nodes or edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): comp is the least node of its component.

    Each round hooks every node to its least neighbour, jumps pointers until
    they rest, and contracts the edges; the number of rounds grows with the
    logarithm of the number of nodes.
    """
    spark = edges.sparkSession
    labels = None
    left = common.stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = common.stored(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("moved")),
            "hooks",
        )
        while True:
            onto = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            jumped = common.stored(
                hooked.select("node", "comp").join(onto, "comp").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")),
                "hooks",
            )
            common.release(hooked)
            hooked = jumped
            if jumped.where("moved").isEmpty():
                break
        ends = [hooked.select(F.col("node").alias(c), F.col("comp").alias("r" + c)) for c in "ab"]
        moved = left.join(ends[0], "a").join(ends[1], "b").where("ra <> rb")
        after = common.stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        common.release(left)
        left = after
        if labels is None:
            labels = hooked
        else:
            onto = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            named = common.stored(labels.select("node", "comp").join(onto, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels")
            common.release(labels, hooked)
            labels = named
    common.release(left)
    if labels is None:
        return spark.createDataFrame([], "node long, comp long")
    out = labels.select("node", "comp")
    out.stored_at = labels.stored_at
    return out
