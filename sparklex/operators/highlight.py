"""Snippets around matches, for the rows of a page (at most a query's limit)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklex.plans.spec import Highlight

Spans = list[tuple[int, int]]


def positions(text: str, terms: list[str]) -> Spans:
    """Matches in order of their places, the longer first; what overlaps an earlier one is left out."""
    found = []
    for t in terms:
        at = text.find(t) if t else -1
        while at >= 0:
            found.append((at, at + len(t)))
            at = text.find(t, at + len(t))
    out: Spans = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def fragments(size: int, matches: Spans, h: Highlight) -> Spans:
    """Stretches of half a snippet around the matches; those that touch are one, cut to a snippet's length around its first match."""
    half, joined = h.snippet_len // 2, []
    for a, b in matches:
        lo, hi = max(0, a - half), min(size, b + half)
        if joined and lo <= joined[-1][1]:
            lo, hi = joined[-1][0], max(joined.pop()[1], hi)
        joined.append((lo, hi))
    out = []
    for lo, hi in joined[: h.max_fragments]:
        if hi - lo > h.snippet_len:
            first = next(a for a, b in matches if b > lo)
            lo = max(lo, min(first - half, size - h.snippet_len))
            hi = min(hi, lo + h.snippet_len)
        out.append((lo, hi))
    return out


def marked(text: str, matches: Spans, h: Highlight) -> str:
    """The fragments with their matches between tags, which are clipped where a fragment is cut; without matches, the text's beginning."""
    cut = "..."
    if not matches:
        return text[: h.snippet_len] + (cut if len(text) > h.snippet_len else "")
    parts = fragments(len(text), matches, h)
    shown = []
    for lo, hi in parts:
        at, piece = lo, ""
        for a, b in ((max(a, lo), min(b, hi)) for a, b in matches):
            if a < b:
                piece += text[at:a] + h.open + text[a:b] + h.close
                at = b
        shown.append(piece + text[at:hi])
    return (cut if parts[0][0] else "") + cut.join(shown) + (cut if parts[-1][1] < len(text) else "")


def snippet(text: str, terms: list[str], h: Highlight) -> str:
    return marked(text, positions(text, terms), h)


def _clusters(text: str) -> Iterator[str]:
    """Characters with the marks that join them: combining ones, half-width voiced marks, joiners."""
    begin = 0
    for k in range(1, len(text) + 1):
        if k == len(text) or not (unicodedata.category(text[k]).startswith("M") or text[k] in "ﾞﾟ‍" or text[k - 1] == "‍"):
            yield text[begin:k]
            begin = k


def original_snippet(original: str, norm: str, terms: list[str], h: Highlight, normalize: Callable[[str], str]) -> str:
    """The snippet of the text as it was given, where its normalised form has the matches; its beginning if the two can't be matched up."""
    spans: Spans = []
    made = []
    at = place = 0
    for cluster in _clusters(original):
        piece = normalize(cluster)
        spans += [(place, place + len(cluster))] * len(piece)
        made.append(piece)
        at, place = at + len(piece), place + len(cluster)
    if "".join(made) != norm:
        return marked(original, [], h)
    out: Spans = []
    for a, b in positions(norm, terms):
        lo, hi = spans[a][0], spans[b - 1][1]
        if out and lo < out[-1][1]:
            lo = out[-1][1]
        if lo < hi:
            out.append((lo, hi))
    return marked(original, out, h)


def highlighted(original: Column, norm: Column, terms: list[str], h: Highlight, normalize: Callable[[str], str]) -> Column:
    """Snippets of original texts; terms as Compiler.highlight_terms() gives them."""

    @F.pandas_udf(T.StringType())
    def mark(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for o, n in frames:
            yield pd.Series([None if x is None or y is None else snippet(x, terms, h) if x == y else original_snippet(x, y, terms, h, normalize) for x, y in zip(o, n, strict=True)], dtype=object)

    return mark(original, norm)
