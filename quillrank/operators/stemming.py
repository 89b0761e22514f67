"""Stems of Russian words; each distinct word goes through Python once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Endings of Russian words, by part of speech, as the published Snowball algorithm lists them.
_GERUND_AFTER_A, _GERUND = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_ADJECTIVE = (
    "ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого", "ему", "ому", "их", "ых", "ую",
    "юю", "ая", "яя", "ою", "ею",
)
_PARTICIPLE_AFTER_A, _PARTICIPLE = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB_AFTER_A = ("ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно")
_VERB = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ило", "ыло", "ено", "ят", "ует",
    "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
)
_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й", "иям", "ям", "ием", "ем", "ам",
    "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия", "ья", "я",
)
_VOWELS = set("аеиоуыэюя")


def _without(word: str, start: int, endings: tuple[str, ...], after: str = "") -> str | None:
    """The word without its longest such ending within the region, or None; with ``after``, only behind one of these letters."""
    for e in sorted(endings, key=len, reverse=True):
        at = len(word) - len(e)
        if word.endswith(e) and at >= start and (not after or (at > start and word[at - 1] in after)):
            return word[:at]
    return None


def stem(word: str) -> str:
    """Stem of a lower-case Russian word by the published Snowball steps; other words stay."""
    if not word or any(not ("а" <= c <= "я") for c in word):
        return word
    first = next((i for i, c in enumerate(word) if c in _VOWELS), None)
    if first is None:
        return word
    rv, r2, was = first + 1, len(word), None
    turns = [i + 1 for i in range(1, len(word)) if word[i] not in _VOWELS and word[i - 1] in _VOWELS]
    if turns:
        later = [i for i in turns if i >= turns[0] + 2]
        r2 = later[0] if later else len(word)
    for group, after in ((_GERUND, ""), (_GERUND_AFTER_A, "ая")):
        if (was := _without(word, rv, group, after)) is not None:
            word = was
            break
    else:
        word = _without(word, rv, _REFLEXIVE) or word
        adjective = _without(word, rv, _ADJECTIVE)
        if adjective is not None:
            word = adjective
            word = _without(word, rv, _PARTICIPLE) or _without(word, rv, _PARTICIPLE_AFTER_A, "ая") or word
        else:
            options = [w for w in (_without(word, rv, _VERB), _without(word, rv, _VERB_AFTER_A, "ая")) if w is not None]
            if options:
                word = min(options, key=len)
            else:
                word = _without(word, rv, _NOUN) or word
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    word = _without(word, r2, ("ость", "ост")) or word
    if word.endswith("нн") and len(word) > rv:
        return word[:-1]
    shorter = _without(word, rv, ("ейше", "ейш"))
    if shorter is not None:
        word = shorter
        return word[:-1] if word.endswith("нн") else word
    return word[:-1] if word.endswith("ь") and len(word) > rv else word


def stemmed_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms: each word goes through Python once, however often texts hold it."""
    ship(terms.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"term": rows["term"], "stem": [stem(t) for t in rows["term"]]})

    return terms.select(F.col(column).alias("term")).distinct().mapInPandas(run, "term string, stem string")
