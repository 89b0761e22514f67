"""Exact token counts at every prefix of a text (operator 7).

The tokenizer merges the adjacent pair of best score first.  For such merges
the encoding of a prefix ends with one certain piece, and what stands before
that piece is the encoding of the shorter prefix.  So a dynamic program over
prefixes finds, for each end, the one piece that is whole by itself and stands
next to the shorter prefix's last piece unchanged; the count is that prefix's
count plus one.  One table per text then answers how many tokens any prefix
has, where to cut for a budget, and how many tokens the whole text has,
without encoding again.

A text is cut where no piece can lie across: at a space after something else,
between letters and punctuation that no piece holds side by side.  Segments
repeat, so their tables are kept (a bounded number of them)
as changes of the count per code point, and a text's table is the running sum
of its segments' bytes.

Nulls count as empty texts; an empty text has no tokens.  Repeated rows each
get their own result.  Very long texts are counted whole.  An empty table gives
no rows.  Columns named like the results (in any case) are replaced, all others
stay, whatever their names.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_SPACE = "▁"
#: Segments whose tables a worker keeps before it starts anew.
KEPT_SEGMENTS = 1_000_000
#: What may be cut from letters, if the model has no piece with both side by side.
_PUNCTUATION = "\n\t!\"#$%&()*+,./:;<=>?@[\\]^`{|}~"


class PrefixCounter:
    """Prefix token counts of a sentencepiece BPE model with byte fallback and a dummy space in front."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = model.encode
        size = model.get_piece_size()
        odd = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        skip = set(odd)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(size) if i not in skip}
        worst = min(self.score.values())
        runs = {p for p in self.score if len(p) > 1 and not p.strip(_SPACE)}
        if any(_SPACE in p.lstrip(_SPACE) or p.startswith(_SPACE * 2) for p in self.score if p not in runs):
            raise ValueError("a piece holds spaces inside or more than one in front; the cuts before spaces wouldn't be exact")
        if any(self.score[p] != worst for p in runs) or any(s == worst for p, s in self.score.items() if p not in runs and p != _SPACE):
            raise ValueError("runs of spaces are expected to merge after everything else")
        self.runs = runs
        self.period = max(map(len, runs), default=1)
        self.run_counts = [0]
        self.trie: dict = {}
        for p in self.score:
            if p not in runs:
                node = self.trie
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p
        joined = {p[i : i + 2] for p in self.score if len(p) > 1 for i in range(len(p) - 1)}
        letters = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        is_letter = re.compile(f"[{letters}]").match
        mixed = {c for pair in joined for c, d in (pair, pair[::-1]) if is_letter(d)}
        cut = re.escape("".join(c for c in _PUNCTUATION if c not in mixed))
        #: A segment: spaces, then letters up to cut punctuation, or such punctuation up to letters, or else all up to the next space.
        self.segments = re.compile(f" *+(?:[{letters}]++(?=[{cut} ]|$)|[{cut}]++(?=[{letters} ]|$)|[^ ]++)| +" if cut else " *+[^ ]++| +", re.S).findall
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short string, by merging; used to tell whether pieces stay apart."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def run(self, n: int) -> int:
        """Tokens of ``n`` spaces that nothing else absorbs."""
        while len(self.run_counts) <= min(n, 4 * self.period):
            self.run_counts.append(len(self._merged_run(len(self.run_counts))))
        if n < len(self.run_counts):
            return self.run_counts[n]
        turns = (n - 3 * self.period) // self.period
        return self.run_counts[n - turns * self.period] + turns

    def _merged_run(self, n: int) -> list[str]:
        parts: list[str | None] = [_SPACE] * n
        after = list(range(1, n + 1))
        heap = [i for i in range(n - 1)]
        heapq.heapify(heap)
        while heap:  # equal scores: the leftmost pair first
            i = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] not in self.runs:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            heapq.heappush(heap, i)
            if before := [k for k in range(max(0, i - self.period), i) if parts[k] is not None]:
                heapq.heappush(heap, before[-1])
        return [p for p in parts if p is not None]

    def chain(self, word: str) -> tuple[list[int], list[bool]]:
        """For each prefix of a word: its tokens, and whether its first token is a bare space."""
        n = len(word)
        count, last, bare = [0] * (n + 1), [""] * (n + 1), [False] * (n + 1)
        whole, pairs, trie = self.whole, self.pairs, self.trie
        for end in range(1, n + 1):
            node, at = trie, end
            while at:
                node = node.get(word[at - 1])
                if node is None:
                    break
                at -= 1
                piece = node.get("")
                if piece is None:
                    continue
                ok = whole.get(piece)
                if ok is None:
                    ok = whole[piece] = len(self.merged(piece)) == 1
                if not ok:
                    continue
                if at and (before := last[at]):
                    ok = pairs.get((before, piece))
                    if ok is None:
                        if len(pairs) > 2_000_000:
                            pairs.clear()
                        ok = pairs[before, piece] = self.merged(before + piece) == [before, piece]
                    if not ok:
                        continue
                count[end], last[end] = count[at] + 1, piece
                bare[end] = bare[at] if at else piece == _SPACE
                break
            else:
                node = None
            if not last[end]:  # in no piece: its bytes; nothing merges with it
                at = end - 1
                count[end] = count[at] + len(word[at].encode())
                bare[end] = bare[at]
        return count, bare

    def table(self, segment: str) -> bytes:
        """Changes of the token count at each code point of a segment, as signed bytes."""
        word = segment.lstrip(" ")
        k = len(segment) - len(word)
        counts = [self.run(i) for i in range(k + 1)] if k != 1 else [0, 1]
        if not k:
            counts = self.chain(word)[0]
        elif word:
            inner, bare = self.chain(_SPACE + word)
            if k == 1:
                counts = inner
            else:
                alone, absorbed = self.run(k) - 1, self.run(k - 1)
                counts += [c + (alone if b else absorbed) for c, b in zip(inner[2:], bare[2:], strict=True)]
        return np.diff(np.array(counts)).astype(np.int8).tobytes()

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:p] for each p from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int32)
        tables = self.tables
        found = self.segments(" " + text.replace(_SPACE, " "))
        try:
            changes = b"".join(map(tables.__getitem__, found))
        except KeyError:
            if len(tables) > KEPT_SEGMENTS:
                tables.clear()
            for s in set(found):
                if s not in tables:
                    tables[s] = self.table(s)
            changes = b"".join(map(tables.__getitem__, found))
        counts = np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int32)
        counts[0] = 0  # before the first code point there is nothing, not even the dummy space
        return counts


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per worker and model."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(df: DataFrame, model: str, limit: int, text: str = "text", keep_prefixes: bool = False) -> DataFrame:
    """``df`` with n_bytes, n_tokens, over_limit and fit_chars (code points of the longest prefix within ``limit`` tokens).

    With ``keep_prefixes`` also prefix_counts: the exact count of every prefix, for later questions.
    """
    new = [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()),
        T.StructField("fit_chars", T.LongType()),
    ]
    if keep_prefixes:
        new.append(T.StructField("prefix_counts", T.ArrayType(T.IntegerType())))

    def run(texts: pa.Array) -> list[pa.Array]:
        own = counter(model)
        sizes, tokens, fits, tables = [], [], [], []
        for t in texts:
            t = t.as_py() or ""
            counts = own.prefix_counts(t)
            total = int(counts[-1])
            sizes.append(len(t.encode()))
            tokens.append(total)
            fits.append(len(t) if total <= limit else int(np.flatnonzero(counts <= limit)[-1]))
            if keep_prefixes:
                tables.append(counts)
        out = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fits, pa.int64())]
        return out + ([pa.array(tables, pa.list_(pa.int32()))] if keep_prefixes else [])

    return common.with_columns(df, common.quoted(text), new, run)


def tokens_of_prefix(prefix_counts: F.Column, chars: F.Column) -> F.Column:
    """Tokens of the first ``chars`` code points, from a stored table."""
    return F.element_at(prefix_counts, F.least(F.greatest(chars, F.lit(0)), F.size(prefix_counts) - 1).cast("int") + 1)
