"""Text expressions: normalisation, tokens, templates.  All are built-in column expressions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Unicode white space and the ASCII separators.
_WHITE = "(?U)[\\s\\x1c-\\x1f]+"
_TOKEN = "([\\p{L}\\p{N}_]+)"


def normalize(c: Column) -> Column:
    """Lower case, ё as е, white space collapsed; null as empty."""
    return F.trim(F.regexp_replace(folded(c), _WHITE, " "))


def folded(c: Column) -> Column:
    """Lower case, ё as е; null as empty.  It has the tokens of ``normalize``, as white space parts them either way."""
    return F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))


def tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(_TOKEN), F.lit(1))


def token_pattern(spark: SparkSession) -> tuple[str, str]:
    """Python's pattern of a token, and one of characters that have to leave a text before it is used ("" for none).

    Python's letters and digits are those of its own Unicode version; here they are made those of the JVM, so that both cut the same tokens.
    """
    if not _PATTERN:
        every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
        word = re.compile(r"\w")
        of = {own: "".join(c for c in every if bool(word.match(c)) is own and (own or unicodedata.category(c) == "Cn")) for own in (True, False)}
        cut = lambda own, pattern: spark.range(1).select(F.regexp_replace(F.lit(of[own]), pattern, "")).first()[0]
        _PATTERN.append((f"[\\w{_ranges(cut(False, '[^' + _TOKEN[2:-3] + ']'))}]+", f"[{_ranges(gone)}]" if (gone := cut(True, _TOKEN[1:-2])) else ""))
    return _PATTERN[0]


_PATTERN: list[tuple[str, str]] = []


def token_points(spark: SparkSession) -> bytes:
    """A bit for each code point: whether the JVM's tokens have it."""
    if not _POINTS:
        every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
        held = spark.range(1).select(F.regexp_replace(F.lit(every), "[^" + _TOKEN[2:-3] + "]+", "")).first()[0]
        out = np.zeros(0x110000, bool)
        out[np.frombuffer(held.encode("utf-32-le"), "<u4")] = True
        _POINTS.append(np.packbits(out).tobytes())
    return _POINTS[0]


_POINTS: list[bytes] = []


def _ranges(chars: str) -> str:
    """Sorted characters as ranges of a character class."""
    at = [ord(c) for c in chars]
    first = [i for i in range(len(at)) if not i or at[i] != at[i - 1] + 1]
    last = [i for i in range(len(at)) if i + 1 == len(at) or at[i + 1] != at[i] + 1]
    return "".join(f"{re.escape(chr(at[a]))}-{re.escape(chr(at[b]))}" for a, b in zip(first, last, strict=True))


def long_tokens(normal: Column) -> Column:
    """Tokens of two characters or more."""
    return F.filter(tokens(normal), lambda t: F.length(t) >= 2)


def _neighbours(grams: Column, t: Column, n: int) -> Column:
    """Grams of n tokens from those of n - 1: each with the token after it, side by side, so that ``t`` is evaluated once."""
    size = F.greatest(F.size(t) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(grams, F.lit(1), size), F.slice(t, F.lit(n), size), lambda g, x: F.concat(g, F.lit(" "), x))


def bigrams(t: Column) -> Column:
    """Distinct pairs of neighbouring tokens, joined by a space."""
    return F.array_distinct(_neighbours(t, t, 2))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words of the normalised text."""
    if n < 0:
        raise ValueError("a number of words can't be negative")
    return F.array_join(F.slice(F.split(normalize(c), " "), 1, n), " ") if n else F.lit("")


def item_text(title: Column, category: Column, params: Column, description: Column) -> Column:
    """Labelled document for an encoder: title, category, 40 words of parameters, 48 of the description."""
    return F.concat(
        F.lit("товар: "), normalize(title), F.lit(" категория: "), normalize(category), F.lit(" параметры: "), first_words(params, 40),
        F.lit(" описание: "), first_words(description, 48),
    )


def query_text(text: Column, filters: Column, category: Column) -> Column:
    """Labelled query; filters and category are left out where empty, the category also where "0"."""
    f, c = normalize(filters), normalize(category)
    return F.concat_ws(
        " ", F.concat(F.lit("запрос: "), normalize(text)), F.when(f != "", F.concat(F.lit("фильтры: "), f)),
        F.when((c != "") & (c != "0"), F.concat(F.lit("категория: "), c)),
    )


def query_format(text: Column, filters: Column, values: Column, category: Column, style: str) -> Column:
    """A query for an encoder: "current" is ``query_text``, "plain" the text alone, "values" text and filter values, "no_category" all but the category."""
    styles = {
        "current": lambda: query_text(text, filters, category),
        "no_category": lambda: query_text(text, filters, F.lit("")),
        "plain": lambda: normalize(text),
        "values": lambda: _joined(" | ", normalize(text), normalize(values)),
    }
    return styles[style]()


def _joined(by: str, *parts: Column) -> Column:
    """Parts joined, empty ones left out."""
    return F.concat_ws(by, *(F.nullif(p, F.lit("")) for p in parts))


def compact_text(title: Column, values: Column, description: Column) -> Column:
    """Title, 40 words of values and 48 of the description joined by full stops; empty parts are left out."""
    return _joined(". ", normalize(title), first_words(values, 40), first_words(description, 48))


def title_description(title: Column, description: Column) -> Column:
    """Title and the first 400 characters of the raw description."""
    return _joined(". ", normalize(title), normalize(F.substring(F.coalesce(description, F.lit("")), 1, 400)))


def prefixed(prefix: str, c: Column) -> Column:
    """An encoder's input with its prompt."""
    return F.concat(F.lit(prefix), c)


def filter_values(c: Column, keys: list[str], semantic: set[str]) -> Column:
    """Leading free text and the values of semantic keys of a linear "key value key value" text.

    Keys are literal, whatever characters they have; longer ones win; repeated
    values count once; without any key the text stays.
    """
    n = normalize(c)
    exact = [re.sub(r"([^\w\s])", r"\\\1", k) for k in sorted(keys, key=lambda k: (-len(k), k))]
    pattern = "(?<!\\S)(" + "|".join(exact) + ")(?=\\s|$)"
    parts = F.split(F.regexp_replace(n, pattern, "\u0001$1\u0002"), "\u0001")
    head = F.trim(F.element_at(parts, 1))
    named = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("\u0002"))), lambda p: F.split(p, "\u0002"))
    chosen = F.filter(named, lambda p: F.element_at(p, 1).isin(*sorted(semantic)))
    values = F.concat(F.array(head), F.transform(chosen, lambda p: F.trim(F.element_at(p, 2))))
    return F.when(F.size(parts) == 1, n).otherwise(F.array_join(F.array_distinct(F.filter(values, lambda v: v != "")), " ; "))


def rating_floor(c: Column) -> Column:
    """The number after "рейтинг пользователя", comma as point; null without one."""
    found = F.regexp_extract(c, "рейтинг пользователя\\s*(\\d+(?:[.,]\\d+)?)", 1)
    return F.try_to_number(F.nullif(F.replace(found, F.lit(","), F.lit(".")), F.lit("")), F.lit("999999999D999999")).cast("double")


def content_spans(parts: list[tuple[str, Column]], by: str = " ") -> Column:
    """Spans (name, start, end) of the named parts of a text in which they are joined by ``by``, in code points; empty parts are left out."""
    out = F.array().cast("array<struct<name:string,start:int,end:int>>")
    at = F.lit(0)
    for name, part in parts:
        here = F.length(part)
        begin = at + F.when((at > 0) & (here > 0), len(by)).otherwise(0)
        span = F.struct(F.lit(name).alias("name"), begin.cast("int").alias("start"), (begin + here).cast("int").alias("end"))
        out = F.concat(out, F.when(here > 0, F.array(span)).otherwise(F.array().cast("array<struct<name:string,start:int,end:int>>")))
        at = F.when(here > 0, begin + here).otherwise(at)
    return out


def contains_phrase(haystack: Column, phrase: Column) -> Column:
    return (phrase != "") & F.contains(haystack, phrase)


def word_ngrams(t: Column, low: int, high: int) -> Column:
    """Word n-grams, all occurrences."""
    grams, out = t, []
    for n in range(1, high + 1):
        grams = _neighbours(grams, t, n) if n > 1 else t
        if n >= low:
            out.append(grams)
    return F.concat(*out)


def char_ngrams(normal: Column, low: int, high: int) -> Column:
    """Character n-grams within words padded by a space on both sides; a word shorter than n is given whole, once."""
    padded = F.transform(F.filter(F.split(normal, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    none = F.array().cast("array<string>")

    def grams(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substr(w, i, F.lit(n)))).otherwise(none)

    def of(w: Column) -> Column:
        short = F.when(F.length(w) < high, F.array(w)).otherwise(none)  # once, not once for every larger n
        return F.concat(*(grams(w, n) for n in range(low, high + 1)), F.when(F.length(w) < low, short).otherwise(none))

    return F.flatten(F.transform(padded, of))
