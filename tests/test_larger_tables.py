"""Steps that grow with the tables: what they make stays as many rows as blocks or answers, with the same results."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillrank.functions import text as X
from quillrank.operators import blocks, bm25, category_model, vectors
from quillrank.operators.stemming import stem
from quillrank.plans import learning_queries, roles


def test_index_is_a_row_a_block_with_the_tokens_of_the_jvm(spark):
    """Every letter and digit, those that only one of the two Unicode versions knows, white space and separators."""
    odd = [chr(i) for i in (*range(0x20, 0x3000), 0x10570, 0x1E030, 0x2EBF0, 0x1F600, 0x20000)]
    texts = [("".join(odd[i : i + 40]) + " Ёлка ёлка A_b\x1cc") for i in range(0, len(odd), 30)] + ["", None]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, t string")
    field = bm25.Field("t", 1.0, 0.5, 1.0)
    index = bm25.counted(items, (field,))
    assert index.count() <= items.rdd.getNumPartitions()
    pattern, gone = X.token_pattern(spark)
    want = {r["item_id"]: r["t"] for r in items.select("item_id", X.tokens(X.normalize(F.col("t"))).alias("t")).collect()}
    for r in items.select("item_id", X.folded(F.col("t")).alias("t")).collect():
        assert re.findall(pattern, re.sub(gone, " ", r["t"]) if gone else r["t"]) == want[r["item_id"]]
    assert sum(r["n"] for r in index.collect()) == len(texts) and sum(r["totals"][0] for r in index.collect()) == sum(map(len, want.values()))


def test_truth_is_found_where_texts_are_read(spark):
    """Texts of one to eight words inside others, at word edges and within words, over odd white space; nothing but answers leaves the reading."""
    rng = random.Random(3)
    words = lambda n: [rng.choice(["ab", "b", "ba", "Ёж", "c"]) for _ in range(n)]
    items = [(f"i{k}", rng.choice([" ", " ", "\n\x1c", "  "]).join(words(rng.randrange(40)))) for k in range(300)] + [("null", None)]
    asked = [(k, " ".join(words(1 + k % 8))) for k in range(60)] + [(99, ""), (98, " ")]
    q = spark.createDataFrame(asked, "qid long, text string")
    d = spark.createDataFrame(items, "item_id string, description string")
    found = roles.contained(q, d)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()))
    normal = lambda t: " ".join((t or "").lower().replace("ё", "е").split())
    want = sorted((k, i) for k, t in asked for i, u in items if normal(t) and normal(t) in normal(u))
    assert got == want and len({k for k, _ in got if k % 8 == 3}) > 1


def test_truth_of_more_queries_goes_by_shuffles(spark, monkeypatch):
    q = spark.createDataFrame([(1, "b c d"), (2, "x b c d y"), (3, "d")], "qid long, text string")
    d = spark.createDataFrame([(7, "A b  c d y"), (8, "x B c D y"), (9, "")], "item_id long, description string")
    few = sorted(map(tuple, roles.contained(q, d).collect()))
    monkeypatch.setattr(roles, "FEW", 1)
    assert sorted(map(tuple, roles.contained(q, d).collect())) == few == [(1, 7), (1, 8), (2, 8), (3, 7), (3, 8)]


def test_category_vectors_are_made_where_texts_are_read(spark):
    """Frequencies, and vectors of counted grams of both kinds, as the built-in expressions cut them; no gram is shuffled for a vector."""
    s = category_model.Settings(words=50, characters=400)
    said = ["красивая лампа для дома", "красивый дом", "b-a b лампа", "", "ё", "x 12 x 12"]
    texts = spark.createDataFrame([(t, k % 2) for k, t in enumerate(said)], "text string, fold int")
    cut = texts.select("text", X.tokens(F.col("text")).alias("t"), X.char_ngrams(F.col("text"), 2, 4).alias("characters")).collect()
    grams = {}
    for r in cut:
        stems = [stem(t) for t in r["t"]]
        grams[r["text"]] = {"words": stems + [f"{a} {b}" for a, b in zip(stems, stems[1:])], "characters": r["characters"]}
    frequencies = category_model._frequencies(texts)
    got = {(r["kind"], r["g"]): r["df"] for r in frequencies.groupBy("kind", "g").agg(F.sum("df").alias("df")).collect()}
    assert got == dict(Counter((k, g) for own in grams.values() for k in own for g in set(own[k])))
    vocabulary = category_model._vocabulary(frequencies, len(said), s)
    ids = {(r["kind"], r["g"]): (r["id"], r["idf"]) for r in vocabulary.collect()}
    assert set(ids) == {g for g, n in got.items() if n >= 2}
    vectors = category_model._vectors(texts, vocabulary, s)
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    for r in vectors.collect():
        want = {}
        for kind, own in grams[r["text"]].items():
            w = {ids[kind, g][0]: (1 + math.log(n)) * ids[kind, g][1] for g, n in Counter(own).items() if (kind, g) in ids}
            want |= {i: v / math.sqrt(sum(x * x for x in w.values())) for i, v in w.items()}
        assert {int(i): round(v, 9) for i, v in zip(r["x"].indices, r["x"].values)} == {i: round(v, 9) for i, v in want.items()}


def test_vectors_of_the_corpus_are_packed_once_however_queries_are_dealt(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    c = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = c.where("vec_id % 7 = 0").repartition(5)
    best = vectors.cosine_top_k(q, c, 4)
    assert "CartesianProduct" not in best._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, best.collect()))
    monkeypatch.setattr(vectors, "BLOCK", 10)
    assert got == sorted(map(tuple, vectors.cosine_top_k(q, c, 4).collect())) and len(got) == 43 * 4


def test_tokens_are_cut_as_arrays_of_bytes_as_the_jvm_cuts_them(spark):
    odd = [chr(i) for i in (*range(0x20, 0x3000), 0x10570, 0x1E030, 0x2EBF0, 0x1F600, 0x20000)]
    texts = [("".join(odd[i : i + 40]) + " Ёлка ёлка A_b\x1cc") for i in range(0, len(odd), 30)] + ["", "ab", "", "ab", "é", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.folded(F.col("t")).alias("t"), X.tokens(X.normalize(F.col("t"))).alias("w")).orderBy("i").collect()
    word = np.unpackbits(np.frombuffer(X.token_points(spark), np.uint8)).astype(bool)
    own = pa.array(["x", *(r["t"] for r in rows)])
    got = bm25.Tokens([own.slice(1, 100), own.slice(101)], word)
    terms, code = got.coded()
    assert got.counts.tolist() == [len(r["w"]) for r in rows]
    assert terms.take(pa.array(code)).to_pylist() == [w for r in rows for w in r["w"]]
    packed = pa.scalar(bm25.packed_terms(terms), pa.binary())
    assert bm25.unpacked_terms(packed).to_pylist() == terms.to_pylist() and not len(bm25.unpacked_terms(pa.scalar(b"", pa.binary())))


def test_a_block_of_the_index_has_a_file_of_its_own(spark, monkeypatch):
    """So a task never reads more than one at once; before, all of a task's blocks were one batch."""
    monkeypatch.setattr(bm25, "TEXT", 1)
    items = spark.range(1000).select(F.col("id").alias("item_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("t")).coalesce(1)
    index = bm25.counted(items, (bm25.Field("t", 1.0, 0.5, 1.0),))
    assert index.count() == len(index.inputFiles()) == 4
    assert sum(r["n"] for r in index.collect()) == 1000


def test_best_of_many_blocks_stay_few_rows(spark):
    rng = np.random.default_rng(3)
    for kind in (int, str):
        best, every = blocks._Best(4, 5), {q: [] for q in range(4)}
        for _ in range(40):
            docs = np.sort(np.array([kind(d) for d in rng.integers(10**6, 10**7, 30)], object if kind is str else np.int64))
            docs, near = np.unique(docs), None
            near = np.where(rng.random((3, len(docs))) < 0.4, rng.integers(1, 9, (3, len(docs))) / 4, -np.inf)
            q = rng.permutation(4)[:3]
            best.meet(near, q, docs)
            for row, own in zip(near, q, strict=True):
                every[int(own)] += [(-s, d) for s, d in zip(row.tolist(), docs.tolist(), strict=True) if s > 0]
            assert best.size <= 2 * 4 * 5
        q, doc, score = best.taken()
        assert [(a, -s, d) for a, s, d in zip(q.tolist(), score.tolist(), doc.tolist(), strict=True)] == [(a, *x) for a in range(4) for x in sorted(every[a])[:5]]
        assert best.taken() is None


def test_rows_of_a_ranker_are_made_once(spark):
    """Fitting reads its rows many times; each time only stored ones."""
    for df in learning_queries._rows(spark, "/root/testdata/sf0.001"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Window" not in plan


def test_words_of_odd_white_space_find_the_truth():
    """Runs are found in an array of texts, whole or a part of one, and never over the edge of two."""
    texts = pa.array(["z", "a\u2003b\x1cc  d e", "", "x a b c", "d e y", "a b c d e"])
    runs = roles._Runs(["a b c d e", "b"])
    assert runs.found(texts.slice(1)) == ([0, 0, 1, 1, 1], [0, 4, 0, 2, 4])
