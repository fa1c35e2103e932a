"""Tokens, stems and distances of words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, StringType

from veldoc.functions.stemmers import STEMMERS

#: Token patterns by script, bounds of token length, and English stop words.
LATIN = r"[a-zA-Z0-9À-ɏḀ-ỿ]+"
MIN_TOKEN, MAX_TOKEN = 2, 50
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had what when where who which why how".split()
#: Endings of the light stemmer, longest first, and the length that must remain.
LIGHT_ENDINGS = ["ations", "ation", "ingly", "ments", "ness", "ment", "edly", "ing", "ies", "ed", "ly", "es", "s"]
#: Endings by language for the light stemmers, of languages that `stemmers` hasn't.
SUFFIXES = {
    "fr": "issements issement atrices ateurs ations atrice ateur ation ences ence ités ité ives ifs ive if euses eux euse ments ment es s e".split(),
    "it": "azioni azione amenti imenti amento imento mente ità ivi ive ivo iva osi ose oso osa i e o a".split(),
    "pt": "amentos imentos amento imento ações ação mente idades idade ivas ivos iva ivo osas osos osa oso es as os a e o s".split(),
    "fi": "ssa ssä sta stä lla llä lta ltä lle nen ja jä t n a ä".split(),
    "ru": "иями ями ами ией иям ием иях ов ев ей ой ый ий ая яя ое ее ые ие ам ям ах ях ом ем а я о е и ы у ю ь".split(),
    "tr": "lerin ların lerde larda lardan lerden ler lar nin nın de da den dan i ı u ü".split(),
    "ar": "ات ون ين ان ها هم ية ة ي".split(),
}


def tokens(text: Column, pattern: str = LATIN) -> Column:
    """array<struct(term, position)>: lower-cased tokens of 2 to 50 characters without stop words; positions count all."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    placed = F.transform(runs, lambda w, i: F.struct(F.lower(w).alias("term"), i.alias("position")))
    return F.filter(placed, lambda t: (F.length(t["term"]) >= MIN_TOKEN) & (F.length(t["term"]) <= MAX_TOKEN) & ~t["term"].isin(STOP_WORDS))


def query_tokens(text: str, pattern: str = LATIN) -> list[str]:
    """Tokens of a query: stop words and repeats stay."""
    return [w.lower() for w in re.findall(pattern, text) if MIN_TOKEN <= len(w) <= MAX_TOKEN]


def _measure(word: str) -> int:
    return len(re.findall("v+c+", "".join("v" if ch in "aeiou" or (ch == "y" and i and word[i - 1] not in "aeiou") else "c" for i, ch in enumerate(word))))


def _has_vowel(word: str) -> bool:
    return any(ch in "aeiou" or (ch == "y" and i) for i, ch in enumerate(word))


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", word))


def porter(word: str) -> str:
    """The stem of an English word by Porter's published algorithm (1980)."""
    w = word
    if len(w) < 3:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    step2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
    step3 = "icate ic ative - alize al iciti ic ical ic ful - ness -".split()
    for pairs in (step2, step3):
        for end, to in sorted(zip(pairs[::2], pairs[1::2]), key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to.replace("-", "")
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stem_with(word: str, language: str = "en") -> str:
    if language == "en":
        return porter(word)
    if language in STEMMERS:
        return STEMMERS[language](word)
    for end in SUFFIXES.get(language, ()):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def stem(language: str = "en"):
    """A function of a column of words. Apply it to the distinct words, not to every token."""

    @F.pandas_udf(StringType())
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None else stem_with(w, language))

    return stems


def stem_by_language():
    """A function of two columns, language and word: the stem of the word in that language, the word itself in others."""

    @F.pandas_udf(StringType())
    def stems(language: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else stem_with(w, x or "") for x, w in zip(language, words)])

    return stems


def light_stem(word: Column) -> Column:
    """The first ending that leaves three letters goes."""
    out = F.when(F.length(word) < 4, word)
    for end in LIGHT_ENDINGS:
        out = out.when(word.endswith(end) & (F.length(word) - len(end) >= 3), F.left(word, F.length(word) - len(end)))
    return out.otherwise(word)


def damerau(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def edits(most: int = 2):
    """A function of two columns of words; apply it to the vocabulary."""

    @F.pandas_udf(IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([damerau(x, y, most) for x, y in zip(a, b)], dtype="int32")

    return distance
