"""Normalisation of names and addresses as column expressions.

fold() maps Latin letters inside the JVM. Other scripts need transliterate(), an Arrow function; its result is ASCII, so
everything after it is shared.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions import words as W


def _tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def fold(x: Column) -> Column:
    """Latin letters without accents; other characters stay."""
    x = F.translate(F.coalesce(x, F.lit("")), W.LATIN_FROM, W.LATIN_TO)
    for a, b in W.LIGATURES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


@lru_cache(maxsize=1 << 14)
def _letter(c: str) -> str:
    """One character in ASCII, by its Unicode name where it has no decomposition."""
    if c.isascii():
        return c
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    words = unicodedata.name(c, "").split()
    for mark in ("LETTER", "VOWEL", "SIGN"):
        if mark in words:
            rest = [w for w in words[words.index(mark) + 1 :] if w not in ("SIGN", "LETTER", "SMALL", "CAPITAL", "VOCALIC")]
            return rest[0].lower() if rest and rest[0].isascii() and mark != "SIGN" else ""
    return " " if unicodedata.category(c)[0] in "ZPS" else ""


def to_ascii(text: str) -> str:
    """Any script in ASCII: decomposed, marks dropped, letters spelled by their names."""
    if text.isascii():
        return text
    for a, b in W.LIGATURES:
        text = text.replace(a, b)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    if text.isascii():
        return text
    out = []
    for c in text:
        spelled = _letter(c)
        # A vowel sign takes the place of the vowel that a consonant's name ends in.
        if "VOWEL SIGN" in unicodedata.name(c, "") and out and out[-1].endswith("a") and len(out[-1]) > 1:
            out[-1] = out[-1][:-1]
        out.append(spelled)
    return "".join(out)


@F.pandas_udf(T.StringType())
def transliterate(x: pd.Series) -> pd.Series:
    return x.fillna("").map(to_ascii)


def clean(folded: Column) -> Column:
    """Lower case, & spelled out, anything but letters, digits and _ a single space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(folded), F.lit("&"), F.lit(" and ")), "[^a-z0-9_]+", " "))


def name(folded: Column) -> Column:
    return F.array_join(F.filter(_tokens(clean(folded)), lambda t: ~t.isin(W.LEGAL)), " ")


def _long_form(t: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in W.ADDRESS_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, t), t)


def address(folded: Column) -> Column:
    return F.array_join(F.transform(_tokens(clean(folded)), _long_form), " ")


def long_tokens(normal: Column) -> Column:
    """Distinct tokens of three characters and more."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda t: F.length(t) > 2))


def _digit_runs(raw: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"(\p{Nd}+)"), 1)


def digits(raw: Column) -> Column:
    return F.array_distinct(F.filter(_digit_runs(raw), lambda t: F.length(t) >= 2))


def postal(raw: Column) -> Column:
    return F.array_distinct(F.filter(_digit_runs(raw), lambda t: F.length(t).isin(5, 6)))


def house(folded: Column) -> Column:
    """Compound house numbers such as 6-3-10/3."""
    x = F.regexp_replace(F.replace(F.lower(folded), F.lit("#"), F.lit("")), r"\s*([-/])\s*", "$1")
    return F.array_distinct(F.filter(F.regexp_extract_all(x, F.lit("([a-z0-9]+(?:[-/][a-z0-9]+)+)"), 1), lambda t: t.rlike("[0-9]") & (F.length(t) >= 3)))


def prefix(normal: Column, length: int = 4) -> Column:
    return F.substring(F.replace(normal, F.lit(" "), F.lit("")), 1, length)


def sorted_tokens(normal: Column) -> Column:
    return F.array_join(F.array_sort(_tokens(normal)), " ")


def sound(token: Column, table=W.SOUNDS) -> Column:
    """The consonant skeleton of one word."""
    x = F.lower(token)
    for a, b in table:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.substring(x, 1, 1), F.regexp_replace(F.substr(x, F.lit(2)), "[aeiou]", ""))
    return F.regexp_replace(x, r"(.)\1+", "$1")


def name_sound(normal: Column) -> Column:
    """Skeletons of the longer words, sorted and joined without a space."""
    return F.array_join(F.array_sort(F.transform(F.filter(F.split(normal, " "), lambda t: F.length(t) > 2), lambda t: sound(t))), "")


def sound_tokens(normal: Column) -> Column:
    skeletons = F.transform(F.filter(F.split(normal, " "), lambda t: F.length(t) > 2), lambda t: sound(t))
    return F.array_distinct(F.filter(skeletons, lambda t: F.length(t) >= 3))


def trade_name(raw: Column, foldfn=fold) -> Column:
    """The second normal form of names: joiners, M/s and what precedes a trading-as marker removed, noise words dropped."""
    x = F.regexp_replace(F.coalesce(raw, F.lit("")), "[‌‍​﻿]", "")
    x = clean(foldfn(F.regexp_replace(x, r"(?i)^\s*m\s*/\s*s\.?\s+", "")))
    after = F.regexp_replace(x, r"^.*?\b(?:d\s*b\s*a|doing business as)\b", "")
    x = F.when(F.trim(after) != "", after).otherwise(x)
    return F.array_join(F.filter(_tokens(x), lambda t: ~t.isin(sorted({*W.LEGAL, *W.NAME_NOISE}))), " ")


def full_address(folded: Column) -> Column:
    """The second normal form of addresses: noise dropped, and compound house numbers appended as single words."""
    kept = F.transform(F.filter(_tokens(clean(folded)), lambda t: ~t.isin(W.ADDRESS_NOISE)), _long_form)
    houses = F.transform(F.array_sort(house(folded)), lambda h: F.concat(F.lit("h"), F.regexp_replace(h, "[-/]", "x")))
    return F.array_join(F.concat(kept, houses), " ")


def sound_string(normal: Column) -> Column:
    """Skeletons in order, by the second table, without those of legal forms."""
    skeletons = F.transform(_tokens(normal), lambda t: sound(t, W.SOUNDS_SOFT))
    return F.array_join(F.filter(skeletons, lambda t: (t != "") & ~t.isin(W.LEGAL_KEYS)), " ")


def sound_compact(normal: Column) -> Column:
    return F.replace(sound_string(normal), F.lit(" "), F.lit(""))


def bucket(identifier: Column, n: int = 100) -> Column:
    """A stable number below n from an identifier."""
    return (F.conv(F.substring(F.md5(identifier), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def grams(x: Column, pad_words: bool, n: int = 3) -> Column:
    """Character n-grams: of each word padded by a space on both sides, or of the whole string."""
    cut = lambda s: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    if not pad_words:
        return cut(x)
    return F.flatten(F.transform(_tokens(x), lambda w: cut(F.concat(F.lit(" "), w, F.lit(" ")))))
