"""Scalar text functions as Columns."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters without a decomposition that fold to another one all the same.
STROKED = {"đ": "d", "Đ": "D"}
_HANGUL, _LEADS, _VOWELS, _TAILS = 0xAC00, 19, 21, 28


@functools.cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """From the Unicode tables: letters, what each becomes without its marks (marks stand after them and become nothing), and the few
    letters that decompose into several which aren't marks. Hangul syllables go by arithmetic and aren't listed."""
    one, several, gone = dict(STROKED), {}, []
    for ch in map(chr, (*range(0x80, _HANGUL), *range(_HANGUL + _LEADS * _VOWELS * _TAILS, 0xD800), *range(0xE000, 0x30000))):
        bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if not bare:
            gone.append(ch)
        elif len(bare) > 1:
            several[ch] = bare
        elif bare != ch:
            one[ch] = bare
    return "".join([*one, *gone]), "".join(one.values()), several


def _jamo(c: Column) -> Column:
    """Hangul syllables as their letters."""
    at = F.ascii(c) - _HANGUL
    letter = lambda first, n, i: F.get(F.array(*[F.lit(chr(first + k) if first + k != 0x11A7 else "") for k in range(n)]), i.cast("int"))
    parts = (letter(0x1100, _LEADS, F.floor(at / (_VOWELS * _TAILS))), letter(0x1161, _VOWELS, F.floor(at % (_VOWELS * _TAILS) / _TAILS)), letter(0x11A7, _TAILS, at % _TAILS))
    return F.when((at >= 0) & (at < _LEADS * _VOWELS * _TAILS), F.concat(*parts)).otherwise(c)


def unaccented(c: Column) -> Column:
    """Canonical decomposition without combining marks: composed and decomposed spellings give the same letters."""
    letters, plain, several = decompositions()
    spread = functools.reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), several.items(), c)
    c = F.when(c.rlike(f"[{''.join(several)}]"), spread).otherwise(c)
    c = F.when(c.rlike("[\\x{AC00}-\\x{D7A3}]"), F.array_join(F.transform(F.split(c, ""), _jamo), "")).otherwise(c)
    return F.translate(c, letters, plain)


def fold(c: Column) -> Column:
    """No accents, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccented(c)), "[\\s\\p{Z}\\x{85}\\x{1C}-\\x{1F}]+", " "))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded with two spaces before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def digit_tokens(c: Column) -> Column:
    """Distinct numbers with their separators taken out, sorted."""
    found = F.regexp_extract_all(c, F.lit("[0-9][0-9.,]*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.translate(x, ".,", ""))))


def is_caps_heading(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) <= 80)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def strip_thoughts(c: Column) -> Column:
    """Take out a leading thought block; one that never closes leaves nothing."""
    opened = F.ltrim(c).startswith("<thought>")
    closed = F.contains(c, F.lit("</thought>"))
    return F.when(opened & ~closed, "").when(opened, F.trim(F.regexp_replace(c, r"(?s)\A\s*<thought>.*?</thought>", ""))).otherwise(c)


def strip_thinking_and_fence(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), r"\A\s+|\s+\z", "")
    inner = F.regexp_extract(bare, r"(?s)\A```(?:json)?\s*(.*?)\s*```\z", 1)
    return F.when(bare.rlike(r"(?s)\A```(?:json)?\s*.*?\s*```\z"), inner).otherwise(bare)


def sigmoid(c: Column) -> Column:
    return F.round(1 / (1 + F.exp(-c)), 4)


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, for where no tokenizer is at hand."""
    return F.floor(F.length(c) / 4)
