"""Gated recurrent language model with class-factored output (operator 3).

A token is a word (A-Z lower-cased) or the end of a text.  The ``VOCABULARY``
most frequent tokens have outputs of their own, in classes by frequency; every
other word belongs to a class of its look (last byte, first letter beyond
ASCII, length) and is given, within its class, by its count.  A gated
recurrent unit reads the tokens; the probability of the next one is that of
its class times that within the class, each a softmax of the state.

Counts are over all training tokens.  The network starts from counts, is
trained by truncated backpropagation in numpy on ``WARM_DOCUMENTS`` documents
on the driver, so that partitions begin alike, and then on all training
documents, each partition on its own; the partitions' weights are averaged by
their tokens.  Weights, and so scores, depend on how rows fall into partitions
and batches: base scores don't, but the network's part of ``score`` differs a
little where the same rows come in other splits.

Scoring reads every whole text: texts are laid on lanes and read in windows,
and the state is carried from window to window to a text's end.  Counts of the
most frequent words, at most ``HEAD``, are broadcast; rarer words are joined
by their hash.

Null and empty texts are one end token.  Rows with equal ids are scored each,
equal texts in one partition alike.  Words of equal count are ordered by their
hash, so ties give the same outputs again.  A corpus without training rows gives
every token the count 0; an empty table gives no rows.  Columns other than key
and text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel

VOCABULARY, PER_CLASS, HIDDEN, WINDOW = 1024, 32, 16, 32
LOOKS = 3 * 6 * 3
GROUPS = VOCABULARY // PER_CLASS
CLASSES = GROUPS + LOOKS
HEAD = 500_000
#: Lanes that texts are read on, tokens packed at once, windows laid out at once.
LANES, PACK_TOKENS, LAID = 512, 4_000_000, 32
#: Training reads texts in pieces of at most so many tokens.
PIECE = 1024
#: Networks averaged by one task.
MEANS = 1024
WARM_DOCUMENTS, WARM_EPOCHS, WARM_LANES, TRAIN_LANES, RATE, TRAIN_RATE = 200, 3, 32, 128, 0.004, 0.008
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as hashes, their looks, and of each row's tokens the number of the word (-1: the end), with row counts."""
    starts, ends, counts = kernel.words(raw, offsets, kernel.NOT_SPACE)
    hashes, first, number = np.unique(kernel.span_hashes(raw, starts, ends, kernel.LOWER_CODES), return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    last = raw[e - 1] if len(e) else np.zeros(0, np.uint8)
    tail = np.where(last == 46, 1, np.where((last > 127) | ((last > 96) & (last < 123)) | ((last > 64) & (last < 91)), 0, 2))
    odd = np.flatnonzero(raw > 127)
    at = np.searchsorted(odd, s)
    has = at < len(odd)
    has[has] = odd[at[has]] < e[has]
    beyond = np.zeros(len(s), np.int64)
    place = np.minimum(odd[at[has]] + 1, max(0, len(raw) - 1))
    beyond[has] = 1 + raw[place].astype(np.int64) * 7 % 5
    looks = (tail * 6 + beyond) * 3 + np.searchsorted([4, 9], e - s, side="right")
    total = counts + 1
    flow = np.full(int(total.sum()), -1, np.int64)
    keep = np.ones(len(flow), bool)
    keep[np.cumsum(total) - 1] = False
    flow[keep] = number
    return hashes, looks, flow, total


def counted(df: DataFrame, text: str) -> DataFrame:
    """(key, look, n): words of all rows with their counts, the end token among them."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("look", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.buffer_of(batch.column(0))
            keys, looks, sums = [np.array([END])], [np.zeros(1, np.int64)], [np.array([batch.num_rows])]
            for a, b in common.chunks(offsets):
                h, k, flow, _ = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keys.append(h), looks.append(k), sums.append(np.bincount(flow[flow >= 0], minlength=len(h)))
            flat, first, where = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            n = np.bincount(where, np.concatenate(sums), len(flat)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)), pa.array(np.concatenate(looks)[first].astype(np.int32)), pa.array(n)], names=schema.names,
            )

    return common.map_arrow(df.select(common.text_bytes(text)), run, schema).groupBy("key").agg(F.first("look").alias("look"), F.sum("n").alias("n"))


class Lexicon:
    """Counts as a worker needs them: the frequent words, the outputs' words, and the mass of each look's other words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, outputs: np.ndarray, mass: np.ndarray, total: int, distinct: int, complete: bool):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        order = np.argsort(outputs)
        self.output_keys, self.output_ids = outputs[order], order
        self.mass, self.total, self.distinct, self.complete = mass, total, distinct, complete
        self.floor = float(total + 0.5 * (distinct + 1))

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return at, keys[at] == values

    def count(self, hashes: np.ndarray) -> np.ndarray:
        at, found = self._find(self.keys, hashes)
        return np.where(found, self.counts[at] if len(self.counts) else 0, 0)

    def ids(self, hashes: np.ndarray, looks: np.ndarray) -> np.ndarray:
        """Ids of words for the network: its own for a frequent one, else that of its look."""
        at, found = self._find(self.output_keys, hashes)
        return np.where(found, self.output_ids[at] if len(self.output_ids) else 0, VOCABULARY + looks)


def _softmax(x: np.ndarray) -> None:
    """Rows to probabilities, in place; the rows' maxima are only taken where exponents could leave the range of floats."""
    if x.size and (x.max() > 60 or x.min() < -60):
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]


class Network:
    """The weights; inputs are projected by a table, so reading a token is a row of it."""

    NAMES = ("inputs", "recur", "class_w", "class_b", "word_w", "word_b")

    def __init__(self, class_b: np.ndarray, word_b: np.ndarray):
        r, h = np.random.default_rng(23), HIDDEN
        f = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.inputs, self.recur = f(VOCABULARY + LOOKS, 3 * h), f(h, 3 * h)
        self.class_w, self.class_b = f(h, CLASSES) * 0.1, class_b.astype(np.float32)
        self.word_w, self.word_b = f(VOCABULARY, h) * 0.1, word_b.astype(np.float32)
        self.memory: list[tuple[np.ndarray, np.ndarray]] | None = None
        self.step = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            w = getattr(self, n)
            setattr(self, n, flat[at : at + w.size].reshape(w.shape).astype(np.float32))
            at += w.size
        return self

    def states(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States before each token (steps x lanes x HIDDEN) and after the last; ``fresh``: where a text begins."""
        n = HIDDEN
        out = np.empty((*ids.shape, n), np.float32)
        begins = fresh.any(1)
        for t in range(len(ids)):
            if begins[t]:
                h = np.where(fresh[t][:, None], np.float32(0), h)
            out[t] = h
            x, g = self.inputs[ids[t]], h @ self.recur
            p = g[:, 2 * n :]
            gates = x[:, : 2 * n] + g[:, : 2 * n]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:, :n], gates[:, n:]
            m = r * p
            m += x[:, 2 * n :]
            np.tanh(m, out=m)
            if trace is not None:
                trace.append((z, r, p, m, h))
            h = h - m
            h *= z
            h += m
        return out, h

    def log_parts(self, states: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probability of each token's class (and word, if it has an output), with what the gradient needs."""
        group = np.where(ids < VOCABULARY, ids // PER_CLASS, GROUPS + ids - VOCABULARY)
        a = states @ self.class_w + self.class_b
        _softmax(a)
        out = np.log(a[np.arange(len(ids)), group] + 1e-30)
        known = np.flatnonzero(ids < VOCABULARY)
        order = known[np.argsort(group[known], kind="stable")]
        w = np.empty((len(order), PER_CLASS), np.float32)
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
        for k in range(GROUPS):
            if cuts[k] < cuts[k + 1]:
                own = slice(k * PER_CLASS, (k + 1) * PER_CLASS)
                w[cuts[k] : cuts[k + 1]] = states[order[cuts[k] : cuts[k + 1]]] @ self.word_w[own].T + self.word_b[own]
        _softmax(w)
        out[order] += np.log(w[np.arange(len(order)), ids[order] % PER_CLASS] + 1e-30)
        return out, a, w, order, cuts

    def learn(self, ids: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One window of truncated backpropagation and a step of Adam; returns the state to carry and the log likelihood."""
        n, (steps, lanes) = HIDDEN, ids.shape
        trace: list = []
        states, h = self.states(ids, fresh, h, trace)
        flat, flat_ids, weight = states.reshape(-1, n), ids.ravel(), real.ravel().astype(np.float32)
        logs, a, w, order, cuts = self.log_parts(flat, flat_ids)
        group = np.where(flat_ids < VOCABULARY, flat_ids // PER_CLASS, GROUPS + flat_ids - VOCABULARY)
        a[np.arange(len(a)), group] -= 1
        a *= weight[:, None]
        w[np.arange(len(w)), flat_ids[order] % PER_CLASS] -= 1
        w *= weight[order][:, None]
        back = a @ self.class_w.T
        grads = {
            "class_w": flat.T @ a, "class_b": a.sum(0), "word_w": np.zeros_like(self.word_w), "word_b": np.zeros_like(self.word_b),
            "inputs": np.zeros_like(self.inputs), "recur": np.zeros_like(self.recur),
        }
        for k in range(GROUPS):
            if cuts[k] < cuts[k + 1]:
                own, s = slice(k * PER_CLASS, (k + 1) * PER_CLASS), slice(cuts[k], cuts[k + 1])
                grads["word_w"][own], grads["word_b"][own] = w[s].T @ flat[order[s]], w[s].sum(0)
                back[order[s]] += w[s] @ self.word_w[own]
        back = back.reshape(steps, lanes, n)
        d = np.zeros((lanes, n), np.float32)
        moves = np.empty((steps, lanes, 3 * n), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, p, m, before = trace[t]
            dm = d * (1 - z) * (1 - m * m)
            dz = d * (before - m) * z * (1 - z)
            dr = dm * p * r * (1 - r)
            moves[t, :, :n], moves[t, :, n : 2 * n], moves[t, :, 2 * n :] = dz, dr, dm
            inner = np.concatenate([dz, dr, dm * r], 1)
            grads["recur"] += before.T @ inner
            d = d * z + inner @ self.recur.T + back[t]
            d[fresh[t]] = 0
        by_id = np.argsort(flat_ids, kind="stable")
        own, first = np.unique(flat_ids[by_id], return_index=True)
        grads["inputs"][own] = np.add.reduceat(moves.reshape(-1, 3 * n)[by_id], first, axis=0)
        self._adam(grads, max(1.0, float(weight.sum())), rate)
        return h, float((logs * weight).sum())

    def _adam(self, grads: dict[str, np.ndarray], size: float, rate: float) -> None:
        if self.memory is None:
            self.memory = [(np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in self.NAMES]
        self.step += 1
        scale = np.float32(rate * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
        for n, (m, v) in zip(self.NAMES, self.memory, strict=True):
            g = grads[n].astype(np.float32, copy=False)
            g *= np.float32(1 / size)
            np.clip(g, -1, 1, out=g)
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            np.square(g, out=g)
            g *= np.float32(0.01)
            v *= np.float32(0.99)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-7)
            np.divide(m, g, out=g)
            g *= scale
            getattr(self, n)[...] -= g

    def train(self, flows: list[np.ndarray], epochs: int, rate: float, lanes: int = WARM_LANES) -> int:
        """Read texts (ids, each ending with the end's) on so many parallel lanes; returns the tokens read."""
        if not flows:
            return 0
        r, total = np.random.default_rng(29), 0
        # Long texts are read in pieces, each from a fresh state, so that no lane runs on alone.
        pieces = [f[a : a + PIECE] for f in flows for a in range(0, len(f), PIECE)]
        lanes = min(lanes, len(pieces))
        for epoch in range(epochs):
            shares: list[list[np.ndarray]] = [[] for _ in range(lanes)]
            loads = [(0, k) for k in range(lanes)]
            for i in r.permutation(len(pieces)):
                load, k = heapq.heappop(loads)
                shares[k].append(pieces[i])
                heapq.heappush(loads, (load + len(pieces[i]), k))
            length = max(load for load, _ in loads)
            length = -(-length // WINDOW) * WINDOW
            ids, fresh, real = np.zeros((length, lanes), np.int64), np.zeros((length, lanes), bool), np.zeros((length, lanes), bool)
            for k, s in enumerate(shares):
                flow = np.concatenate(s)
                ids[: len(flow), k], real[: len(flow), k] = flow, True
                fresh[np.cumsum([0] + [len(f) for f in s[:-1]]), k] = True
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, length, WINDOW):
                s = slice(t, t + WINDOW)
                live = real[s].any(0)
                if live.any():
                    h = h.copy()
                    h[live], _ = self.learn(
                        ids[s][:, live], fresh[s][:, live], real[s][:, live], h[live],
                        rate * (1 - 0.7 * (epoch * length + t) / (epochs * length)),
                    )
            total += int(real.sum())
        return total

    def likelihoods(self, flows: list[np.ndarray]) -> np.ndarray:
        """Natural log likelihood of each whole text under classes and outputs; the state is carried across windows."""
        out = np.zeros(len(flows))
        if not flows:
            return out
        lanes = min(LANES, len(flows))
        heap, own = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(flows)), key=lambda i: -len(flows[i])):
            load, k = heapq.heappop(heap)
            own[k].append(i)
            heapq.heappush(heap, (load + len(flows[i]), k))
        own.sort(key=lambda s: -sum(len(flows[i]) for i in s))
        lengths = np.array([sum(len(flows[i]) for i in s) for s in own])
        streams = [np.concatenate([flows[i] for i in s]) for s in own]
        texts = [np.repeat(s, [len(flows[i]) for i in s]) for s in own]
        begins = [np.concatenate([[0], np.cumsum([len(flows[i]) for i in s])])[:-1] for s in own]
        h = np.zeros((lanes, HIDDEN), np.float32)
        for top in range(0, int(lengths[0]), WINDOW * LAID):
            live = int(np.searchsorted(-lengths, -top, side="left"))
            size = min(WINDOW * LAID, -(-(int(lengths[0]) - top) // WINDOW) * WINDOW)
            ids, text, fresh = np.zeros((size, live), np.int64), np.full((size, live), -1), np.zeros((size, live), bool)
            for k in range(live):
                part = streams[k][top : top + size]
                ids[: len(part), k], text[: len(part), k] = part, texts[k][top : top + size]
                lo, hi = np.searchsorted(begins[k], [top, top + size])
                fresh[begins[k][lo:hi] - top, k] = True
            for t in range(0, size, WINDOW):
                live = int(np.searchsorted(-lengths, -(top + t), side="left"))
                s = slice(t, t + WINDOW)
                states, h = self.states(ids[s, :live], fresh[s, :live], h[:live])
                logs = self.log_parts(states.reshape(-1, HIDDEN), ids[s, :live].ravel())[0]
                at = text[s, :live].ravel()
                out += np.bincount(at[at >= 0], logs[at >= 0], len(flows))
        return out


def lexicon(table: DataFrame) -> tuple[Lexicon, np.ndarray, np.ndarray]:
    """The broadcast part of the counts, with the output biases that make the untrained network the counts' model."""
    sums = {r["look"]: (r["n"], r["v"]) for r in table.where(F.col("key") != int(END.view(np.int64))).groupBy("look").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # LOOKS rows
    end = table.where(F.col("key") == int(END.view(np.int64))).select("n").first()
    ends = int(end[0]) if end else 0
    total, distinct = sum(n for n, _ in sums.values()) + ends, sum(v for _, v in sums.values()) + (ends > 0)
    # The head is every word above a count, the least (to an eighth of an octave) at which it has at most HEAD words.
    octave = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["o"]: r["v"] for r in table.groupBy(octave.alias("o")).agg(F.count("*").alias("v")).collect()}  # at most 8 for each doubling
    least, held = max(sizes, default=0) + 1, 0
    for o in sorted(sizes, reverse=True):
        held += sizes[o]
        if held > HEAD:
            break
        least = o
    head = table.where((octave >= least) | (F.col("key") == int(END.view(np.int64)))).toArrow()  # the end always: rows don't join it later
    keys, looks, counts = head["key"].to_numpy().astype(np.int64).view(np.uint64), head["look"].to_numpy().astype(np.int64), head["n"].to_numpy().astype(np.int64)
    order = np.lexsort((keys.view(np.int64), -counts))
    keys, looks, counts = keys[order], looks[order], counts[order]
    words = np.flatnonzero(keys != END)[: VOCABULARY - 1]
    mass = np.array([sums.get(k, (0, 0))[0] + 0.5 * sums.get(k, (0, 0))[1] + 0.5 for k in range(LOOKS)])
    np.subtract.at(mass, looks[words], counts[words] + 0.5)
    outputs, own = np.concatenate([keys[words], [END]]), np.concatenate([counts[words], [ends]]) + 0.5
    word_b, group_mass = np.full(VOCABULARY, -30.0), np.full(GROUPS, 1e-9)
    for k in range(0, len(own), PER_CLASS):
        part = own[k : k + PER_CLASS]
        word_b[k : k + len(part)], group_mass[k // PER_CLASS] = np.log(part / part.sum()), part.sum()
    every = np.concatenate([group_mass, mass])
    return Lexicon(keys, counts, outputs, mass, int(total), int(distinct), len(keys) == distinct), np.log(every / every.sum()), word_b


def _flows(raw: np.ndarray, offsets: np.ndarray, own: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: ids and word numbers of the tokens, row counts, the words' hashes and counts."""
    end = int(own.ids(np.array([END]), np.zeros(1, np.int64))[0])
    for a, b in common.chunks(offsets):
        hashes, looks, flow, total = tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ids = np.append(own.ids(hashes, looks), end)
        yield ids[flow].astype(np.int16), flow, total, hashes, own.count(hashes)


def fit(train: DataFrame, own: Lexicon, class_b: np.ndarray, word_b: np.ndarray, key: str, text: str) -> Network:
    spark = train.sparkSession
    held = spark.sparkContext.broadcast((own, class_b, word_b))
    network = Network(class_b, word_b)
    flows = []
    for t in common.sampled_texts(train, key, text, WARM_DOCUMENTS):
        flows += [i.astype(np.int64) for i, *_ in _flows(np.frombuffer(t, np.uint8), np.array([0, len(t)]), own)]
    if not flows:
        return network
    network.train(flows, WARM_EPOCHS, RATE)
    start = spark.sparkContext.broadcast(network.flat())
    block = 4096
    schema = T.StructType(
        [
            T.StructField("block", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("tokens", T.LongType()),
            T.StructField("weights", T.ArrayType(T.FloatType())),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, cb, wb = held.value
        mine = Network(cb, wb).load(start.value)
        seen = 0
        for batch in batches:
            found = []
            for ids, _, total, _, _ in _flows(*common.buffer_of(batch.column(0)), lex):
                found += [f.astype(np.int64) for f in np.split(ids, np.cumsum(total)[:-1])]
            seen += mine.train(found, 1, TRAIN_RATE, TRAIN_LANES)
        if seen:
            flat = mine.flat()
            parts = [flat[i : i + block] for i in range(0, len(flat), block)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(parts)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int64()),
                    pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float32())),
                ],
                names=schema.names,
            )

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        share = rows["tokens"].to_numpy(np.float64)
        weights = (np.stack(rows["weights"].to_list()).astype(np.float64) * (share / share.sum())[:, None]).sum(0)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "tokens": [int(share.sum())], "weights": [weights.astype(np.float32)]})

    # Means of at most MEANS partitions' weights, then of those means: no task holds a network for every partition.
    parts = common.map_arrow(train.select(common.text_bytes(text)), run, schema)
    means = parts.groupBy("block", F.floor(F.col("part") / MEANS).alias("g")).applyInPandas(mean, "block int, tokens long, weights array<float>")
    rows = means.groupBy("block").applyInPandas(mean, "block int, tokens long, weights array<float>").collect()  # one network's weights
    if rows:
        network.load(np.concatenate([np.array(r["weights"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]))
    return network


def score(df: DataFrame, training: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, n_tokens, n_known, train_tokens, base_score, score; ``training`` says which rows teach."""
    spark = df.sparkSession
    train = df.where(training)
    table = common.stored(counted(train, text), "lm-counts")
    own, class_b, word_b = lexicon(table)
    network = fit(train, own, class_b, word_b, key, text)
    held, weights = spark.sparkContext.broadcast((own, class_b, word_b)), spark.sparkContext.broadcast(network.flat())
    fields = [
        ("part", T.LongType()), ("row", T.LongType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()),
        ("model", T.DoubleType()), ("rare", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([df.schema[key]] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, cb, wb = held.value
        net = Network(cb, wb).load(weights.value)
        context = TaskContext.get()
        part, row = (context.partitionId() if context else 0), 0
        keys: list = []
        flows: list[np.ndarray] = []
        out: list[list] = [[] for _ in range(6)]
        waiting = 0
        log_mass = np.log10(np.concatenate([np.full(VOCABULARY, 1.0), lex.mass]))

        def flush() -> pa.RecordBatch:
            nonlocal row, waiting
            model = net.likelihoods(flows) / np.log(10) + np.array(out[3])
            n = len(flows)
            arrays = [
                pa.concat_arrays(keys), pa.array(np.full(n, part)), pa.array(np.arange(row, row + n)), pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(model, pa.float64()),
                pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int64())),
            ]
            row, waiting = row + n, 0
            keys.clear(), flows.clear()
            for o in out:
                o.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            keys.append(batch.column(0))
            for ids, flow, total, hashes, counts in _flows(*common.buffer_of(batch.column(1)), lex):
                ends = lex.count(np.array([END]))
                c = np.append(counts, ends)[flow]
                base = np.log10((c + 0.5) / lex.floor)
                rare = (c == 0) & (not lex.complete)  # not among the broadcast counts: joined later
                base[rare] = 0
                # Within the class of its look a word has its share of the class's mass.
                inner = np.where(ids >= VOCABULARY, np.where(rare, 0, np.log10(c + 0.5)) - log_mass[ids], 0)
                at = np.concatenate([[0], np.cumsum(total)[:-1]])
                for o, v in zip(
                    out, (total, np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(inner, at)),
                    strict=False,
                ):
                    o.extend(v.tolist())
                flows.extend(np.split(ids.astype(np.int64), at[1:]))
                for words in np.split(np.where(rare, flow, -1), at[1:]) if not lex.complete else [None] * len(total):
                    if words is None:
                        out[4].append([]), out[5].append([])
                        continue
                    w, n = np.unique(words[words >= 0], return_counts=True)
                    out[4].append(hashes[w].view(np.int64)), out[5].append(n)
                waiting += int(total.sum())
            if waiting > PACK_TOKENS:
                yield flush()
        if flows:
            yield flush()

    rows = common.stored(common.map_arrow(df.select(key, common.text_bytes(text)), run, schema), "lm-rows")
    names = [key, "n_tokens", "n_known", F.lit(own.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score")]
    if own.complete:
        return rows.select(names)
    pairs = rows.where(F.size("rare") > 0).select("part", "row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "part", "row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"),
    )
    known = pairs.join(table.select(F.col("key"), "n"), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    log = F.log10(F.col("n") + 0.5)
    sums = known.groupBy("part", "row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * log).alias("logs"),
        F.sum("times").alias("times_all"),
    )
    full = rows.drop("rare", "times").join(sums, ["part", "row"], "left")
    logs, times = F.coalesce("logs", F.lit(0.0)), F.coalesce("times_all", F.lit(0))
    return full.withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn(
        "base", F.col("base") + logs - times * float(np.log10(own.floor)),
    ).withColumn("model", F.col("model") + logs).select(names)
