"""Secret scan: fixed patterns, and a linear-chain conditional random field for what they miss (operator 1).

Tokens are runs of word-like bytes.  Each is tagged as beginning a secret,
inside one, or outside, from hashed features: its shape (kinds of characters,
length, changes of kind), itself, its front, the words on both sides, what
stands between it and the word before, and features of the whole file.
Emissions are sums of table entries, transitions a 3 x 3 table; tags are
decoded by Viterbi.

Decoding is exact but short: where "outside" leads by more than any change of
the neighbouring transitions could make good, every best path is outside, so
Viterbi runs only over the stretches between such tokens.

The field is trained in numpy, by its conditional likelihood, on made lines
with and without secrets (seeded) and on at most ``SAMPLE`` documents (the
first by a hash of the id), where the patterns' spans are the truth.  All rows
and whole texts are scanned.

Pattern spans always stay; a span of the field is added (kind ``crf``) where it
touches none of them.  Null and empty texts have no spans; repeated rows get
equal spans, an empty table gives no rows, and of equally likely tags "outside"
wins, then "begin".  Offsets are code points, ends exclusive.  A column called
secrets (in any case) is replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel

#: The patterns of the base rules.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

SAMPLE, LINES, EPOCHS, RATE, LONGEST = 150, 3000, 6, 0.3, 64
#: Odds (as a logarithm) by which "outside" must lead: unseen kinds of secrets are worth a few false alarms.
LEAN = 1.0
O, B, I = 0, 1, 2
_HASH = 15

TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
TOKEN[[43, 45, 46, 47, 61, 95]] = True  # + - . / = _
HEX = np.zeros(256, bool)
HEX[48:58] = HEX[97:103] = True
_KIND = np.zeros(256, np.uint8)  # digit, upper, lower, mark
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 1, 2, 3, 3
_KIND[[43, 45, 46, 47, 61, 95]] = 4
_GAP = np.zeros(256, np.int64)  # what may stand between words, as bits
for _bits, _bytes in ((1, b"="), (2, b":"), (4, b"\"'`"), (8, b"\n\r"), (16, b"@"), (32, b",;|#")):
    for _b in _bytes:
        _GAP[_b] = _bits
#: Rows of the emission table for each kind of feature.
_SIZES = {"shape": 16 * 8 * 8, "own": 1 << _HASH, "front": 1 << _HASH, "before": 1 << _HASH, "after": 1 << _HASH, "gap": 64 * 8, "file": 64 * 16}
_BASE = dict(zip(_SIZES, np.concatenate([[0], np.cumsum(list(_SIZES.values()))]).tolist(), strict=False))
_ROWS = sum(_SIZES.values())


def _bucket(x: np.ndarray, edges: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


def encoded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of tokens, how many each row has, and their feature rows (tokens x kinds of feature)."""
    starts, ends, counts = kernel.words(raw, offsets, TOKEN)
    n = len(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    kind = _KIND[raw]
    lengths = ends - starts
    amount = []
    for k in (1, 2, 3, 4):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        amount.append(sums[ends] - sums[starts])
    turns = np.zeros(len(raw) + 1, np.int64)
    if len(raw):
        turns[1:-1] = np.cumsum(kind[1:] != kind[:-1])
        turns[-1] = turns[-2]
    changes = turns[np.maximum(ends - 1, 0)] - turns[starts] if n else np.zeros(0, np.int64)
    present = sum((amount[k] > 0).astype(np.int64) << k for k in range(4))
    size = _bucket(lengths, (4, 8, 12, 16, 20, 28, 40))
    shape = (present * 8 + size) * 8 + _bucket(changes, (1, 2, 3, 5, 8, 12, 20))
    words = kernel.span_hashes(raw, starts, ends, kernel.LOWER_CODES) >> np.uint64(64 - _HASH)
    front = kernel.span_hashes(raw, starts, np.minimum(ends, starts + 4), kernel.CODES) >> np.uint64(64 - _HASH)
    words, front = words.astype(np.int64), front.astype(np.int64)
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        before[1:] = np.where(first[1:], 0, words[:-1])
        after[:-1] = np.where(first[1:], 0, words[1:])
    gap = np.zeros(n, np.int64)
    for back in (1, 2, 3):  # the three bytes before a token, as far as they are in its row
        at = starts - back
        inside = at >= offsets[owner] if n else np.zeros(0, bool)
        byte = raw[np.maximum(at, 0)] if n else np.zeros(0, np.uint8)
        inside &= ~TOKEN[byte]
        gap |= np.where(inside, _GAP[byte], 0)
    rows = len(counts)
    sizes = np.maximum(1, np.diff(offsets))
    odd = np.concatenate([[0], np.cumsum(_GAP[raw] & 39 > 0)])
    digit = np.concatenate([[0], np.cumsum(kind == 1)])
    code = _bucket((odd[offsets[1:]] - odd[offsets[:-1]]) * 1000 // sizes, (2, 8, 20, 40, 60, 90, 140)) if rows else np.zeros(0, np.int64)
    digits = _bucket((digit[offsets[1:]] - digit[offsets[:-1]]) * 1000 // sizes, (1, 5, 15, 40, 80, 150, 300)) if rows else np.zeros(0, np.int64)
    file = (code * 8 + digits)[owner] * 16 + present
    columns = (shape, words, front, before, after, gap * 8 + size, file)
    return starts, ends, counts, np.stack([c + b for c, b in zip(columns, _BASE.values(), strict=False)], 1) if n else np.zeros((0, len(columns)), np.int64)


class Field:
    """Emission and transition weights of the conditional random field."""

    def __init__(self) -> None:
        self.emission = np.zeros((_ROWS, 3), np.float32)
        self.transition = np.zeros((3, 3), np.float32)
        self.start = np.zeros(3, np.float32)

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]]) -> Field:
        """Maximise the likelihood of the tags; sequences of at most ``LONGEST`` tokens, sums of gradients scaled as AdaGrad does."""
        random = np.random.default_rng(3)
        seen = [np.full_like(w, 1e-6) for w in (self.emission, self.transition, self.start)]
        for _ in range(EPOCHS):
            order = random.permutation(len(sequences))
            for at in range(0, len(order), 64):
                batch = [sequences[i] for i in order[at : at + 64]]
                for w, s, g in zip((self.emission, self.transition, self.start), seen, self._gradient(batch), strict=True):
                    if isinstance(g, tuple):
                        rows, inverse = np.unique(g[0], return_inverse=True)
                        total = np.stack([np.bincount(inverse, g[1][:, y], len(rows)) for y in range(3)], 1)
                        s[rows] += total**2
                        w[rows] += RATE * (total - 1e-3 * w[rows]) / np.sqrt(s[rows])
                    else:
                        s += g**2
                        w += RATE * g / np.sqrt(s)
        return self

    def _gradient(self, batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
        n, longest = len(batch), max(len(t) for _, t in batch)
        features = np.zeros((n, longest, len(_SIZES)), np.int64)
        tags, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
        for i, (f, t) in enumerate(batch):
            features[i, : len(t)], tags[i, : len(t)], mask[i, : len(t)] = f, t, True
        e = self.emission[features].sum(2).astype(np.float64)
        t = self.transition.astype(np.float64)

        def total(x: np.ndarray) -> np.ndarray:
            top = x.max(1, keepdims=True)
            return np.log(np.exp(x - top).sum(1)) + top[:, 0]

        ahead, back = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        ahead[:, 0] = self.start + e[:, 0]
        for k in range(1, longest):
            step = total(ahead[:, k - 1, :, None] + t) + e[:, k]
            ahead[:, k] = np.where(mask[:, k, None], step, ahead[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = total(np.swapaxes(t[None] + (e[:, k + 1] + back[:, k + 1])[:, None, :], 1, 2))
            back[:, k] = np.where(mask[:, k + 1, None], step, back[:, k])
        z = total(ahead[:, -1])
        p = np.exp(ahead + back - z[:, None, None]) * mask[:, :, None]
        truth = np.eye(3)[tags] * mask[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + t + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        both = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        lean = (truth - p)[mask]
        flat = features[mask]
        return (flat.ravel(), np.repeat(lean, flat.shape[1], 0)), (both - pair).sum((0, 1)), (truth - p)[:, 0].sum(0)

    def tags(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best tags of each row's tokens."""
        n = len(features)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        e = self.emission[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            e += self.emission[features[:, k]]
        first = np.zeros(n, bool)
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1][counts > 0]
        first[begin] = True
        # The most that tag y instead of "outside" may gain from both neighbouring transitions.
        enter = np.vstack([self.transition, self.start])
        gain = [float((enter[:, y] - enter[:, O]).max() + max(0.0, (self.transition[y] - self.transition[O]).max())) for y in (B, I)]
        sure = (e[:, O] > e[:, B] + gain[0]) & (e[:, O] > e[:, I] + gain[1])
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return out
        cut = np.flatnonzero((np.diff(open_) != 1) | first[open_[1:]]) + 1
        t = self.transition.tolist()
        for stretch in np.split(open_, cut):
            a, b = int(stretch[0]), int(stretch[-1]) + 1
            before = self.start if first[a] else self.transition[O]
            score = (before + e[a]).tolist()
            trace = []
            for x in e[a + 1 : b].tolist():
                best = [max((score[i] + t[i][y], -i) for i in range(3)) for y in range(3)]
                trace.append([-k for _, k in best])
                score = [best[y][0] + x[y] for y in range(3)]
            if b < n and not first[b]:
                score = [score[y] + t[y][O] for y in range(3)]
            y = max(range(3), key=lambda k: (score[k], -k))
            out[b - 1] = y
            for k in range(b - 2, a - 1, -1):
                y = trace[k - a][y]
                out[k] = y
        return out


def base_spans(body: bytes, raw: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, of the fixed patterns."""
    spans = []
    low = body.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(body) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in body:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(body) if m.end() - m.start() >= LEAST_ACCESS]
    starts, ends, _ = kernel.words(raw, np.array([0, len(raw)]), HEX)
    long = ends - starts >= LEAST_HEX
    spans += [(int(s), int(e), 2) for s, e in zip(starts[long], ends[long], strict=True)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def tagged(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of tokens from secrets' spans: the tokens that lie in one."""
    tags = np.zeros(len(starts), np.int64)
    for s, e in spans:
        own = np.flatnonzero((starts < e) & (ends > s))
        tags[own] = I
        tags[own[:1]] = B
    return tags


def made_lines() -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Seeded lines of prose, logs and code, with the spans of the secrets in them."""
    r = np.random.default_rng(5)
    pick = lambda x: x[int(r.integers(len(x)))]
    chars = lambda a, n: "".join(pick(a) for _ in range(n))
    low, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    full = low + upper + digit
    parts = [
        "th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io",
        "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ment", "tion", "ung", "keit", "ción", "eau",
    ]
    word = lambda: "".join(pick(parts) for _ in range(int(r.integers(1, 5))))
    secret = [
        lambda: chars(full, int(r.integers(14, 44))),
        lambda: chars(upper + digit, int(r.integers(20, 44))),
        lambda: chars(digit + upper[:6], pick([24, 32, 40, 64])),
        lambda: pick(["xoxb-", "xoxp-"]) + chars(digit, 11) + "-" + chars(full, 24),
        lambda: chars(full + "+/", int(r.integers(22, 60))) + pick(["", "=", "=="]),
        lambda: "ghp_" + chars(full, 36),
        lambda: pick(["sk_live_", "sk-", "pk_test_", "xoxb-", "glpat-", "npm_"]) + chars(full, int(r.integers(20, 36))),
        lambda: "eyJ" + chars(full, 18) + ".eyJ" + chars(full, 30) + "." + chars(full + "-_", 43),
        lambda: "AIza" + chars(full + "-_", 35),
        lambda: chars(low, 3) + pick("!@$%&") + chars(full, int(r.integers(6, 12))) + pick("!@$%&") + chars(digit, 3),
    ]
    key = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "credential", "private_key", "client_secret", "access_key", "bearer"]
    scheme = ["postgres", "postgresql", "mysql", "mongodb", "redis", "amqp", "https", "ftp"]
    plain = [
        lambda: f"{pick(scheme)}://{word()}.{word()}:{chars(digit, 4)}/{word()}",
        lambda: f"{word()}: {word().capitalize()}{word()} {chars(digit, int(r.integers(1, 6)))}:{chars(digit, 2)}",
        lambda: " ".join(word() for _ in range(int(r.integers(4, 14)))).capitalize() + pick([".", "!", ",", "###", " |"]),
        lambda: f"{word()} = {pick([word(), chars(digit, 4), 'None', 'true', word() + '_' + word()])};",
        lambda: f"https://{word()}.{pick(['com', 'org', 'net'])}/{word()}/{word()}-{word()}-{word()}.html",
        lambda: f"{chars(digit, 4)}-{chars(digit, 2)}-{chars(digit, 2)} {chars(digit, 2)}:{chars(digit, 2)} {word()} {chars(digit, 3)}.{chars(digit, 2)}.{chars(digit, 3)}.{chars(digit, 1)}",
        lambda: f"version {chars(digit, 1)}.{chars(digit, 2)}.{chars(digit, 1)} {word()}@{word()}.org {word().upper()}_{word().upper()}_{word().upper()}",
        lambda: f"{word()}{word()}{word()}{word()} {word().upper()}{word().upper()}!! {word()}### {word()}$$$ {chars(digit, int(r.integers(4, 17)))}",
        lambda: f"{pick(key)} {word()} {word()} the {pick(key)} of {word()}",
        lambda: f"{pick(key)}: {pick(['none', 'null', 'changeme', '', 'yes', word()])}",
        lambda: f"+{chars(digit, 2)} {chars(digit, 3)} {chars(digit, 7)} {chars(digit, 4)}-{chars(digit, 4)}-{chars(digit, 4)}-{chars(digit, 4)}",
    ]
    out = []
    for i in range(LINES):
        if i % 2:
            out.append((pick(plain)().encode(), []))
            continue
        s = pick(secret)()
        head = pick(
            [
                f"{pick(key)} = \"", f"{pick(key)}: ", f"{pick(key).upper()}=", f"Authorization: Bearer ", f"{pick(scheme)}://{word()}:",
                f"{pick(scheme)}://{word()}:", f"{word()} {word()} {pick(key)} is ", f"--{pick(key)} ", f"{word()} {word()} ",
            ]
        )
        tail = f"@{word()}.{word()}:{chars(digit, 4)}/{word()}" if "://" in head else pick(["\"", "", "'", f" {word()} {word()}"])
        lead = pick(plain)() + " " if i % 4 == 0 else ""
        a = len((lead + head).encode())
        out.append(((lead + head + s + tail).encode(), [(a, a + len(s.encode()))]))
    return out


def train(texts: list[bytes]) -> Field:
    sequences = []
    for body, spans in made_lines() + [(t, None) for t in texts]:
        raw = np.frombuffer(body, np.uint8)
        starts, ends, _, features = encoded(raw, np.array([0, len(raw)]))
        if spans is None:
            spans = [(s, e) for s, e, _ in base_spans(body, raw)]
            spans = [(s + (m.start(2) if (m := ASSIGN.match(body[s:e])) else 0), e) for s, e in spans]
        tags = tagged(starts, ends, spans)
        sequences += [(features[a : a + LONGEST], tags[a : a + LONGEST]) for a in range(0, len(tags), LONGEST)]
    field = Field().fit(sequences)
    field.emission[: _SIZES["shape"], O] -= LEAN  # a token has one shape
    return field


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``df`` with secrets: an array of (kind, start, end) by start, then kind."""
    field = df.sparkSession.sparkContext.broadcast(train(common.sampled_texts(df, key, text, sample)))
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(texts: pa.Array) -> list[pa.Array]:
        raw, offsets = common.buffer_of(texts)
        found: list[list[dict]] = []
        for a, b in common.chunks(offsets):
            found += spans_of(field.value, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return [pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return common.with_columns(df, common.text_bytes(text), [T.StructField("secrets", T.ArrayType(item))], run)


def spans_of(field: Field, raw: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    starts, ends, counts, features = encoded(raw, offsets)
    tags = field.tags(features, counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    data, out = raw.tobytes(), []
    marked = np.flatnonzero(tags)
    rows = np.searchsorted(first, marked, side="right") - 1
    for i in range(len(counts)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        spans = base_spans(data[a:b], raw[a:b])
        base = list(spans)
        open_: list[int] | None = None
        lo, hi = np.searchsorted(rows, [i, i + 1])
        added, last = [], -2
        for k in marked[lo:hi].tolist():
            if tags[k] == B or open_ is None or k != last + 1:
                open_ = [int(starts[k]) - a, int(ends[k]) - a]
                added.append(open_)
            else:
                open_[1] = int(ends[k]) - a
            last = k
        spans += [(s, e, 3) for s, e in added if not any(s < y and e > x for x, y, _ in base)]
        spans.sort(key=lambda s: (s[0], s[2]))
        out.append([{"kind": KINDS[k], "start": int(lead[a + s] - lead[a]), "end": int(lead[a + e] - lead[a])} for s, e, k in spans])
    return out
