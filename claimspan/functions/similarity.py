"""Similarity of texts: best window of tokens, and ROUGE-L."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip, tokens

DIGITS = 4


def window_jaccard(snippet: Column, document: Column) -> Column:
    """The best Jaccard similarity of a snippet's tokens with a window of a document's (arrays), before rounding.

    A window holds max(2 n, n + 5) tokens for a snippet of n, so a snippet that stands there word for word scores about a half: an
    exact hit must be tested for first."""
    n = F.size(snippet)
    width = F.greatest(2 * n, n + 5)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(document) - width))

    def score(i: Column) -> Column:
        window = F.slice(document, i + 1, width)
        return F.size(F.array_intersect(snippet, window)) / F.size(F.array_union(snippet, window))

    return F.when((n == 0) | (F.size(document) == 0), F.lit(0.0)).otherwise(F.array_max(F.transform(starts, score)))


def snippet_similarity(snippet: Column, document: Column, snippet_tokens: Column | None = None, document_tokens: Column | None = None) -> Column:
    """1 if the document has the snippet word for word (in any case), else the best window's similarity; a blank snippet is 0."""
    bare = strip(snippet)
    s = tokens(bare) if snippet_tokens is None else snippet_tokens
    d = tokens(document) if document_tokens is None else document_tokens
    return F.when(bare == "", F.lit(0.0)).when(F.contains(F.lower(document), F.lower(bare)), F.lit(1.0)).otherwise(F.round(window_jaccard(s, d), DIGITS))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: a row of the table at a time."""

    def row(previous: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            up, left = F.element_at(previous, j + 1), F.element_at(done, -1)
            best = F.when(F.element_at(b, j) == x, F.element_at(previous, j) + 1).otherwise(F.greatest(up, left))
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    last = F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(last, -1))


def rouge_tokens(c: Column) -> Column:
    """Words of letters and digits in lower case."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " +"), lambda w: w != "")


def f_measure(common: Column, system: Column, gold: Column) -> Column:
    """2PR / (P + R) from counts; 0 where nothing is common."""
    return F.when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (system + gold))


def rouge_l(system: Column, gold: Column, stemmed: bool = False) -> Column:
    """ROUGE-L of two texts, before rounding; 0 if either is blank. stemmed: words of over three letters count by their Porter stem.

    lcs_length would copy a row of the table for every word; a bit-parallel row costs a few machine words."""
    return _rouge_l_stemmed(system, gold) if stemmed else _rouge_l(system, gold)


def _score(a: str | None, b: str | None, stemmed: bool) -> float:
    x, y = ([porter_stem(w) if stemmed and len(w) > 3 else w for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in (a, b))
    common = lcs_of(x, y)
    return 2.0 * common / (len(x) + len(y)) if common else 0.0


@F.pandas_udf(T.DoubleType())
def _rouge_l(system: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([_score(a, b, False) for a, b in zip(system, gold)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _rouge_l_stemmed(system: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([_score(a, b, True) for a, b in zip(system, gold)], dtype=float)


def lcs_of(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel over a."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


# The suffix rules of Porter's algorithm (1980) with the extensions of its widespread Python form, each with what replaces it,
# and the words that it takes as they are.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful"}
_IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    """Changes from vowels to consonants."""
    kinds = _consonants(stem)
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))


def _cvc(word: str) -> bool:
    kinds = _consonants(word)
    return kinds == "vc" or kinds[-3:] == "cvc" and word[-1] not in "wxy"


@lru_cache(maxsize=100_000)
def porter_stem(word: str) -> str:
    """Porter's stem of a word in lower case."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _consonants(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and len(w) > 2 and _consonants(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    while w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        w = w[:-1]
    for rules in (_STEP2, _STEP3):
        suffix = max((s for s in rules if w.endswith(s)), key=len, default=None)
        if suffix and _measure(w[: -len(suffix)]) > 0:
            w = w[: -len(suffix)] + rules[suffix]
    suffix = max((s for s in (*_STEP4, "ion") if w.endswith(s)), key=len, default=None)
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
