"""The queries opN_<name> over the smallest tables: against their SQL, or against brute force over the contract."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from quillrank.llm import common, kernel, language_model, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got = c.execute(queries.ORACLES[name])
    names = [d[0] for d in got.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(df.select(*names).collect()) == sorted(map(tuple, got.fetchall()))


def test_secrets(spark, texts):
    """Base spans by the patterns alone; all spans in order, the base ones among them."""
    out = by_id(queries.op1_crf_secret_scan(spark, SF))
    assert set(out) == set(texts)
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for i, t in texts.items():
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        kinds = collections.Counter(k for _, k, _ in spans)
        r = out[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds[0], kinds[1], kinds[2])
        base = ",".join(s for *_, s in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert ",".join(s for s in every if not s.startswith("crf")) == base
        starts = [int(s.split(":")[1]) for s in every]
        assert starts == sorted(starts)


def test_shards(spark, texts):
    """Groups of equal texts stay together unless they outweigh a shard; bytes are near equal, slots gapless."""
    out = by_id(queries.op2_best_fit_sharding(spark, SF))
    size = {i: len(t.encode()) + 8 for i, t in texts.items()}
    shards, slots, groups, weight = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set), collections.Counter()
    for i, r in out.items():
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size[i], zlib.crc32(texts[i].encode()), "bytes", None)
        shards[r["shard"]] += size[i]
        slots[r["shard"]].append(r["slot"])
        groups[texts[i]].add(r["shard"])
        weight[texts[i]] += size[i]
    mean = sum(size.values()) / 24
    assert set(shards) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in groups.items() if weight[t] <= mean)
    assert max(shards.values()) <= 1.1 * max(mean, max(w for w in weight.values() if w <= mean))


def test_language_model(spark, texts):
    """Counts and base scores by the contract; the network's classes are probabilities, and its score is what one reading token by token gives."""
    out = by_id(queries.op3_gru_language_model(spark, SF))
    low = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
    counts = collections.Counter(w for i, t in texts.items() if crc(i) % 5 != 1 for w in [*low(t), None])
    total, floor = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    for i, t in texts.items():
        own = [*low(t), None]
        base = sum(np.log10((counts[w] + 0.5) / floor) for w in own)
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 5 == 1, len(own), sum(counts[w] > 0 for w in own), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base) and r["score"] <= 0
    held = [i for i in texts if crc(i) % 5 == 1]
    assert sum(out[i]["score"] for i in held) > sum(out[i]["base_score"] for i in held)  # better than counts on what it hasn't read


def test_language_model_is_a_distribution(spark, texts):
    """Classes sum to 1, words within a class too, for any state; a text's score is a plain loop's over its tokens."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    table = common.stored(language_model.counted(docs, "text"), "lm-test")
    lex, class_b, word_b = language_model.lexicon(table)
    net = language_model.fit(docs, lex, class_b, word_b, "doc_id", "text")
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, count = language_model.HIDDEN, {int(r["key"]): r["n"] for r in table.collect()}
    looks = {int(np.array(r["key"]).view(np.uint64)): r["look"] for r in table.collect()}
    mass = collections.Counter()
    words_of = collections.defaultdict(int)
    for key, look in looks.items():
        at, there = lex._find(lex.output_keys, np.array([key], np.uint64))
        if not there[0]:
            mass[look] += count[int(np.array(key, np.uint64).view(np.int64))] + 0.5
            words_of[look] += 1
    for look, m in mass.items():  # the words of a look share its mass, with one more place for an unseen word
        assert abs(m + 0.5 - lex.mass[look]) < 1e-3 * m
    got = by_id(language_model.score(docs, F.lit(True)))
    for i in sorted(texts)[:12]:
        raw = np.frombuffer(texts[i].encode(), np.uint8)
        hashes, kinds, flow, _ = language_model.tokens(raw, np.array([0, len(raw)]))
        h, score = np.zeros(n, np.float64), 0.0
        for f in flow:
            key = language_model.END if f < 0 else hashes[f]
            one = int(lex.ids(np.array([key], np.uint64), np.array([0 if f < 0 else kinds[f]]))[0])
            a = h @ net.class_w + net.class_b
            p = np.exp(a - a.max())
            p /= p.sum()
            assert abs(p.sum() - 1) < 1e-6
            if one < language_model.VOCABULARY:
                g = one // language_model.PER_CLASS
                own = slice(g * language_model.PER_CLASS, (g + 1) * language_model.PER_CLASS)
                w = net.word_w[own] @ h + net.word_b[own]
                q = np.exp(w - w.max())
                score += np.log10(p[g]) + np.log10(q[one % language_model.PER_CLASS] / q.sum())
            else:
                look = one - language_model.VOCABULARY
                c = count.get(int(np.array(key, np.uint64).view(np.int64)), 0)
                score += np.log10(p[language_model.GROUPS + look]) + np.log10((c + 0.5) / lex.mass[look])
            x = net.inputs[one].astype(np.float64)
            gates = sigmoid(x[: 2 * n] + h @ net.recur[:, : 2 * n])
            m = np.tanh(x[2 * n :] + gates[n:] * (h @ net.recur[:, 2 * n :]))
            h = m + gates[:n] * (h - m)
        assert abs(got[i]["score"] - score) < 2e-3 * abs(score) + 1e-3, i


def test_quality(spark, texts):
    """Scores by a plain loop over words and n-grams, and accuracy on rows that were never trained on."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    table, bias = model.table()
    out = by_id(queries.op4_subword_quality(spark, SF))
    step, spread = 0x01000193, 0x9E3779B1
    for i in sorted(texts)[:25]:
        ids, words = [], texts[i].encode().split()
        for w in words:
            marked = b" " + w + b" "
            code = [int(quality._BYTE[b]) for b in marked]
            for size in quality.SIZES:
                for a in range(len(code) - size + 1):
                    h = code[a]
                    for c in code[a + 1 : a + size]:
                        h = (h * step + c) & 0xFFFFFFFF
                    ids.append(((h * spread) & 0xFFFFFFFF) >> (32 - quality.BITS))
            raw = np.frombuffer(w, np.uint8)
            ids.append(int(kernel.span_hashes(raw, np.array([0]), np.array([len(raw)]), kernel.CODES)[0] >> np.uint64(64 - quality.BITS)))
        ids += [quality.AGAIN for a, b in zip(words, words[1:], strict=False) if a == b]
        odds = bias + (sum(float(table[k]) for k in ids) / len(ids) if ids else 0.0)
        r = out[i]
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-4, i
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (crc(i) % 5 == 0)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [i for i in labels if i in out and crc(i) % 5]
    assert sum(out[i]["predicted"] == labels[i] for i in own) >= 0.95 * len(own)


def test_token_counts(spark, texts):
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in by_id(queries.op7_prefix_token_counts(spark, SF)).items():
        n = len(own.encode(texts[i]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[i].encode()), n, n > 4096)


def test_packing(spark, texts):
    """Every id in one piece, pieces gapless in sequences of at most 2048, little padding; ids are the library's own."""
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(own.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    at, sequences = collections.Counter(), collections.defaultdict(list)
    for r in queries.op8_cutting_stock_packing(spark, SF).orderBy("doc_id", "start").collect():
        body = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(body)
        assert zlib.crc32(body[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at == {i: len(b) for i, b in ids.items()}
    padding = 0
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert padding <= 0.03 * sum(map(len, ids.values()))
