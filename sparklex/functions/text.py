"""Text functions: normalisation, n-grams and matching, as Column expressions wherever Spark has the parts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code point ranges of CJK ideographs.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0xF900, 0xFAFF))


def _narrow_table() -> dict[int, str]:
    """Full-width forms to narrow ones: each half-width katakana form is the target of what it normalises to."""
    table = {0x3000: " "} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for half in range(0xFF61, 0xFFA0):
        table.setdefault(ord(unicodedata.normalize("NFKC", chr(half))[0]), chr(half))
    for full in range(0x30A1, 0x30FB):
        parts = unicodedata.normalize("NFD", chr(full))
        if len(parts) == 2 and ord(parts[0]) in table and ord(parts[1]) in (0x3099, 0x309A):
            table[full] = table[ord(parts[0])] + ("ﾞ" if ord(parts[1]) == 0x3099 else "ﾟ")
    return table


NARROW = _narrow_table()
#: The other way round: each narrow form to its full-width one, two characters first.
VOICED = {v: chr(k) for k, v in NARROW.items() if len(v) == 2}
WIDE = {ord(v): k for k, v in sorted(NARROW.items(), reverse=True) if len(v) == 1}
_VOICED = re.compile("|".join(map(re.escape, VOICED)))


def normalize(text: str | None, nfkc: bool = True, width: str = "narrow", lower: bool = False) -> str | None:
    """NFKC, then width folding ("narrow", "wide" or "keep"), then lower-casing; as texts and terms are both normalised."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text) if nfkc else text
    text = text.translate(NARROW) if width == "narrow" else _VOICED.sub(lambda m: VOICED[m[0]], text).translate(WIDE) if width == "wide" else text
    return text.lower() if lower else text


def normalized(column: Column, nfkc: bool = True, width: str = "narrow", lower: bool = False) -> Column:
    """normalize() of a column, for building tables; ASCII texts stay in the JVM."""

    @F.pandas_udf(T.StringType())
    def slow(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: normalize(x, nfkc, width, lower), na_action="ignore")

    ascii_only = (F.octet_length(column) == F.length(column)) & F.lit(width != "wide")
    return F.when(ascii_only, F.lower(column) if lower else column).otherwise(slow(F.when(~ascii_only, column)))


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK)


def ngrams(text: str, n: int = 2, kanji: int = 0, cross: bool = True) -> list[str]:
    """Distinct n-grams in order: kanji (else n) characters from an ideograph, n from others; without cross, of one kind only."""
    out = {}
    for i, c in enumerate(text):
        g = text[i : i + ((kanji or n) if is_cjk(c) else n)]
        whole = len(g) == ((kanji or n) if is_cjk(c) else n)
        if whole and (cross or len({is_cjk(x) for x in g}) == 1):
            out[g] = None
    return list(out)


def gram_places(texts: list[str], size: int, ideographs: bool | None = None, cross: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct n-grams of so many characters in texts, the texts that have each (all in one array), and their number for each n-gram.

    ideographs: only those that begin (True) or don't begin (False) with an ideograph; cross as in ngrams().
    """
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])
    n = max(0, len(chars) - size + 1)
    code, bits = chars[:n], 21
    for k in range(1, size):
        if k > 1:  # numbers of the distinct ones so far instead: two characters and a text's number fit
            code, bits = np.unique(code, return_inverse=True)[1].astype(np.uint64), max(1, len(chars).bit_length())
        code, bits = code << np.uint64(21) | chars[k : n + k], bits + 21
    ok = of[:n] == of[size - 1 :]
    if ideographs is not None or not cross:
        kind = np.zeros(len(chars), bool)
        for a, b in CJK:
            kind |= (chars >= a) & (chars <= b)
        if ideographs is not None:
            ok &= kind[:n] == ideographs
        for k in range(1, 1 if cross else size):
            ok &= kind[:n] == kind[k : n + k]
    shift = len(texts).bit_length()
    assert bits + shift <= 64
    at = np.flatnonzero(ok)
    pairs = np.unique(code[at] << np.uint64(shift) | of[at])
    own = pairs >> np.uint64(shift)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    if size > 2:
        at = at[np.unique(code[at], return_index=True)[1]]
        shown = chars[at[:, None] + np.arange(size)]
    else:
        shown = own[first][:, None] >> np.array([21, 0][-size:], np.uint64) & np.uint64((1 << 21) - 1)
    every = shown.astype("<u4").tobytes().decode("utf-32-le")
    return [every[i : i + size] for i in range(0, len(every), size)], (pairs & np.uint64((1 << shift) - 1)).astype(np.int64), np.diff(np.append(first, len(own)))


#: An ideograph, as a regular expression.
IDEOGRAPH = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in CJK) + "]"


def ngram_array(text: Column, n: int = 2, kanji: int = 0, cross: bool = True) -> Column:
    """The distinct n-grams of a text, as ngrams() has them; empty where the text is shorter, null where it is null.

    The text is split into characters once, and n-grams of each place are put together from shifted copies of that array.
    """
    chars = F.split(text, "")
    chars = F.filter(chars, lambda c: c != "")

    def runs(size: int) -> Column:
        out = chars
        for k in range(1, size):
            out = F.zip_with(F.slice(out, F.lit(1), F.greatest(F.size(chars) - k, F.lit(0))), F.slice(chars, F.lit(k + 1), F.greatest(F.size(chars) - k, F.lit(0))), lambda a, b: F.concat(a, b))
        return out

    if kanji in (0, n):
        every = runs(n)
    else:
        both = F.arrays_zip(chars.alias("c"), runs(n).alias("other"), runs(kanji).alias("own"))
        every = F.filter(F.transform(both, lambda x: F.when(x["c"].rlike(IDEOGRAPH), x["own"]).otherwise(x["other"])), lambda g: g.isNotNull())
    if not cross:
        every = F.filter(every, lambda g: g.rlike(f"^(?:{IDEOGRAPH}+|[^{IDEOGRAPH[1:]}+)$"))
    return F.array_distinct(every)


def all_of(columns: list[Column], empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(empty)


def any_of(columns: list[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(empty)


def has(text: Column, term: str) -> Column:
    """Whether the text has the term as a substring; an empty term is nowhere, a null text has none."""
    return F.coalesce(text.contains(term), F.lit(False)) if term else F.lit(False)


def has_ngrams(text: Column, term: str, n: int = 2, kanji: int = 0, cross: bool = True, at_least: int | None = None) -> Column:
    """Whether the text has all (or at least so many) distinct n-grams of the term; a term too short for any is sought as it is."""
    grams = ngrams(term, n, kanji, cross)
    if not grams:
        return has(text, term)
    if at_least is None or at_least == len(grams):
        return all_of([has(text, g) for g in grams])
    if at_least <= 0 or at_least > len(grams):
        return F.lit(False)
    return reduce(lambda a, b: a + b, [has(text, g).cast("int") for g in grams]) >= at_least


def fuzzy_word(text: Column, term: str, distance: int) -> Column:
    """Whether a word of the text (any window of about the term's length in words beyond ASCII) is within an edit distance of the term."""
    words = F.split(text, "[ \\t\\r\\n　 ]+")

    def near(w: Column) -> Column:
        return F.levenshtein(w, F.lit(term), distance) >= 0

    def window(w: Column, size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(w) - size + 1, F.lit(1)))
        return F.exists(places, lambda i: (F.length(w) >= size) & near(F.substring(w, i, F.lit(size))))

    def in_word(w: Column) -> Column:
        sizes = [k for k in range(len(term) - distance, len(term) + distance + 1) if k > 0]
        return near(w) | ((F.octet_length(w) > F.length(w)) & any_of([window(w, k) for k in sizes]))

    return F.coalesce(F.exists(words, in_word), F.lit(False))


def term_count(text: Column, term: str) -> Column:
    """Occurrences of the term that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int") if term else F.lit(0)
