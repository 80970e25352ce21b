"""Text functions: trigrams, word runs, stems, similarity, clean-up.

Native expressions where the language allows; Arrow-batched functions only for
Unicode normal forms, stems and order-sensitive matching, which it lacks.
"""

from __future__ import annotations

import difflib
import html
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as _T

#: Words too common to search for (fixed values).
STOP_WORDS = (
    "a an and are as at be but by do for from had has have he her his i if in into is it its just me more most my no nor not of off on or our out own "
    "s she so some such t than that the their them then there these they this those to too under until up very was we were what when where which while who will with you your"
).split()

#: What does not count when names are compared: blanks, invisible characters and punctuation of any script, but for signs that stand for a word.
MARKS = r"(?:[^\P{P}&*#%@\\_]|[\p{Z}\p{C}\s])+"


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks in front and one behind.

    A word is a run of letters and digits of any script.
    """
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def has_word_run(text: Column, run: Column) -> Column:
    """Whether the words of ``run`` stand in ``text`` one after the other, bounds of words respected."""
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    return (F.trim(plain(run)) != "") & F.contains(plain(text), plain(run))


def strip_parentheses(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^()]*\)", ""), r"\s{2,}", " "))


def is_japanese(c: Column) -> Column:
    return c.rlike("[ぁ-んァ-ン一-龯]")


def strip_ruby(c: Column) -> Column:
    """Removes readings in full-width brackets."""
    return F.regexp_replace(c, "（[ぁ-んァ-ンー]+）", "")


@F.pandas_udf(_T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def name_form(c: Column) -> Column:
    """Form in which names are compared: NFKC, lower case, without blanks and marks."""
    return F.regexp_replace(F.lower(nfkc(c)), MARKS, "")


@F.pandas_udf(_T.StringType())
def html_unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


@F.pandas_udf(_T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Order-sensitive similarity: twice the matched characters over all characters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _measure(stem: str) -> int:
    form = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall("v+c+", form))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _closed(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    n = len(stem)
    return n > 2 and not _vowel(stem, n - 1) and _vowel(stem, n - 2) and not _vowel(stem, n - 3) and stem[-1] not in "wxy"


#: Endings and what replaces them, tried longest first (fixed values of the published algorithm).
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of an English word by the suffix-stripping algorithm of 1980."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            root = w[: -len(end)]
            if w.endswith(end) and any(_vowel(root, i) for i in range(len(root))):
                if root.endswith(("at", "bl", "iz")):
                    w = root + "e"
                elif len(root) > 1 and root[-1] == root[-2] and not _vowel(root, len(root) - 1) and root[-1] not in "lsz":
                    w = root[:-1]
                else:
                    w = root + "e" if _measure(root) == 1 and _closed(root) else root
                break
    if w.endswith("y") and any(_vowel(w, i) for i in range(len(w) - 1)):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        end = next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = next((e for e in sorted(_STEP4, key=len, reverse=True) if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _closed(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(text: str | None) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in _STOPS]


_STOPS = frozenset(STOP_WORDS)


@F.pandas_udf(_T.ArrayType(_T.StringType()))
def search_tokens(values: pd.Series) -> pd.Series:
    """Stems of a text in order, common words left out."""
    return values.map(stems)


def ratio_bound(a: Column, b: Column) -> Column:
    """What :func:`sequence_ratio` can be at most, by the lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0))
