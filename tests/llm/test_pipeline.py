"""The pipeline's stages against brute force on a small corpus."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    source = "/root/testdata/sf0.001"
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{top}/{t}.parquet")
    docs = spark.read.parquet(f"{source}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", None, None, 0)], docs.schema)
    docs.unionByName(odd).withColumn("score", F.lit("kept")).write.parquet(f"{top}/documents.parquet")
    return top


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and docs.where("score <> 'kept'").isEmpty()
        if name == "quality_classifier":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}  # those it may learn from; the table has few
            assert len(bad & set(after)) <= 0.1 * len(bad) and len(set(before) - set(after) - bad) <= 0.2 * len(before)
        elif name == "line_dedup":
            key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).encode().lower()
            seen = collections.Counter(k for t in before.values() for k in {key(x) for x in (t or "").split("\n")})
            assert after == {i: "\n".join(x for x in (t or "").split("\n") if not key(x) or seen[key(x)] < 10) for i, t in before.items()}
            assert docs.where("n_chars <> length(text)").isEmpty()
        elif name == "minhash_near_dedup":
            assert after == {i: before[i] for i, c in components(before).items() if i == c}
        elif name == "benchmark_decontamination":
            word = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
            windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [word(r["text"])] for i in range(len(w) - 9)}
            dirty = {i for i, t in before.items() if any(tuple(w[k : k + 10]) in windows for w in [word(t)] for k in range(len(w) - 9))}
            assert set(after) == set(before) - dirty
    pieces = P.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == set(after)
    sums = {r["doc_id"]: (r["n"], r["t"]) for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert all(n == t for n, t in sums.values())


def components(texts):
    """The smallest id of each text's component, by comparing all pairs of shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_stages_of_empty_tables(spark, sf, tmp_path):
    """No documents give none; without labels and benchmark items nothing is rejected."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert P.keep_quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert P.drop_contaminated(spark, docs, str(tmp_path)).count() == docs.count()


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_near_duplicates_of_repeated_ids(spark, sf):
    """A copy doesn't take another text of its id with it, and of equal rows one stays."""
    text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    rows = [(1, text(1), "a.b"), (2, text(1), "x"), (2, text(2), "x"), (3, text(3), "x"), (3, text(3), "x"), (4, text(4), "x"), (5, "", "x"), (5, None, "x"), (6, text(2), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string")
    kept = P.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([rows[k] for k in (0, 2, 3, 5, 6, 7)], key=repr)
