"""From a query to one Column: terms, then exclusions, then filters, then verification."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklex.functions.text import all_of, any_of, fuzzy_word, has, has_ngrams, is_cjk, ngrams, normalize
from sparklex.functions.values import decimal, epoch, integer, number
from sparklex.plans.spec import Both, Either, Expression, Filter, Not, Query, Required, TableSpec, Term

NEAR = 1e-9  # doubles that differ by less are equal


def resolve(name: str, columns: list[str]) -> str | None:
    """The column of that name, else the only one that differs in case."""
    if name in columns:
        return name
    like = [c for c in columns if c.lower() == name.lower()]
    return like[0] if len(like) == 1 else None


def _literal(value: str, kind: T.DataType) -> object | None:
    """The value in the column's type, or None if it is no such value."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BooleanType):
        return value in ("1", "true")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number(value)
    if isinstance(kind, T.DecimalType):
        return decimal(value, kind)
    return integer(value, kind)  # whole numbers, times in seconds


def seconds(c: Column, kind: T.DataType) -> Column:
    """A time column as seconds since 1970; times without a zone count as UTC. Other columns as they are."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("second", c).cast("timestamp_ntz"))
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return F.unix_timestamp(c) if isinstance(kind, T.TimestampType) else c


def compare(f: Filter, schema: T.StructType) -> Column:
    """A filter on a typed column. Null matches != only; a value that the type hasn't matches nothing, an unknown column as null does."""
    name = resolve(f.column, schema.fieldNames())
    if name is None:
        return F.lit(f.op == "!=")
    kind, c = schema[name].dataType, F.col(f"`{name}`")
    value = _literal(f.value, kind)
    if value is None:
        return F.lit(False)
    c = seconds(c, kind)
    near = isinstance(kind, (T.DoubleType, T.FloatType))
    v = F.lit(value)
    equal = (F.abs(c - v) < NEAR) if near else (c == v)
    got = {"=": equal, "!=": ~F.coalesce(equal, F.lit(False)), ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[f.op]
    return F.coalesce(got, F.lit(False))


def required(f: Filter | Required, schema: T.StructType, offset: str = "+00:00") -> Column:
    """Whether a row may get into a table. It fails closed: nulls (but for IS NULL), unknown columns and values that the type hasn't let no row in.

    Columns of times take seconds or dates, and texts on them compare as such.
    """
    name = resolve(f.column, schema.fieldNames())
    if name is None:
        return F.lit(False)
    c, kind = F.col(f"`{name}`"), schema[name].dataType
    if f.op in ("IS NULL", "IS NOT NULL"):
        return c.isNull() if f.op == "IS NULL" else c.isNotNull()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        c, v = seconds(c, kind), epoch(F.lit(f.value), offset)
        got = {"=": c == v, "!=": c != v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[f.op]
        return F.coalesce(got, F.lit(False))
    return c.isNotNull() & compare(Filter(f.column, f.op, f.value), schema)


class Compiler:
    """The predicate of queries on one table; text is its column of normalised texts."""

    def __init__(self, spec: TableSpec, schema: T.StructType, synonyms: dict[str, tuple[str, ...]] | None = None, text: str = "norm_text"):
        self.spec, self.schema, self.synonyms, self.text = spec, schema, synonyms or {}, F.col(text)
        self.norm = partial(normalize, nfkc=spec.nfkc, width=spec.width, lower=spec.lower)

    def group(self, term: str) -> tuple[str, ...]:
        t = self.norm(term)
        return self.synonyms.get(t, (t,))

    def grams(self, t: str, at_least: int | None = None) -> Column:
        return has_ngrams(self.text, t, self.spec.n, self.spec.kanji, self.spec.cross, at_least)

    def matches(self, term: str) -> Column:
        """All n-grams of the term, or of a synonym."""
        return any_of([self.grams(t) for t in self.group(term)])

    def contains(self, term: str) -> Column:
        return any_of([has(self.text, t) for t in self.group(term)])

    def verified(self, terms: list[str]) -> bool:
        """Whether texts are verified: by the mode, or as a term's n-grams leave characters of mixed scripts out."""
        every = [t for x in terms for t in self.group(x)]
        if self.spec.verify == "all" or self.spec.verify == "ascii" and all(t.isascii() for t in every):
            return bool(every)
        return any(self._gap(t) for t in every)

    def _gap(self, t: str) -> bool:
        if len({is_cjk(c) for c in t}) < 2:
            return False
        inside = [False] * len(t)
        for g in ngrams(t, self.spec.n, self.spec.kanji, self.spec.cross):
            at = t.find(g)
            while at >= 0:
                inside[at : at + len(g)] = [True] * len(g)
                at = t.find(g, at + 1)
        return not all(inside)

    def expression(self, e: Expression, leaf) -> Column:
        if isinstance(e, Term):
            return leaf(e.text)
        if isinstance(e, Not):
            return ~self.expression(e.of, leaf)
        assert isinstance(e, Both)
        a, b = self.expression(e.left, leaf), self.expression(e.right, leaf)
        return a | b if isinstance(e, Either) else a & b

    def fuzzy(self, term: str, d: int) -> Column:
        """Enough n-grams for a text that may have the term within a distance of d; synonyms aren't taken."""
        t, n, k = self.norm(term), self.spec.n, self.spec.kanji or self.spec.n
        grams = ngrams(t, n, k, self.spec.cross)
        if not grams:
            return F.lit(False)
        short = sum(len(g.encode()) <= 3 for g in grams)  # in bytes: so bigrams of ASCII count, too
        step = k if 2 * short > len(grams) else n
        return self.grams(t, max(1, len(grams) - d * step))

    def stages(self, q: Query) -> list[tuple[str, Column]]:
        """What a query asks of a row, in order: terms, exclusions (by n-grams only, never verified), filters, verification."""
        leaf = (lambda t: self.fuzzy(t, q.fuzzy)) if q.fuzzy else self.matches
        terms = list(q.terms)
        wanted = [leaf(t) for t in q.terms]
        if q.expression is not None:
            wanted.insert(0, self.expression(q.expression, leaf))
            terms += q.expression.terms(False)
        parts = [("terms", all_of(wanted)), ("exclusions", all_of([~self.matches(t) for t in q.none])), ("filters", all_of([compare(f, self.schema) for f in q.filters]))]
        if terms and self.verified(terms):
            exact = (lambda t: has(self.text, self.norm(t)) | fuzzy_word(self.text, self.norm(t), q.fuzzy)) if q.fuzzy else self.contains
            checks = [exact(t) for t in q.terms] + ([self.expression(q.expression, exact)] if q.expression is not None else [])
            parts.append(("verification", F.isnull(self.text) | all_of(checks)))
        return parts

    def predicate(self, q: Query) -> Column:
        return all_of([c for _, c in self.stages(q)])

    def score_terms(self, q: Query) -> list[str]:
        return [self.norm(t) for t in [*q.terms, *(q.expression.terms() if q.expression is not None else [])]]

    def highlight_terms(self, q: Query) -> list[str]:
        """The terms, what white space parts in them, and their synonyms."""
        every = [*q.terms, *(q.expression.terms() if q.expression is not None else [])]
        variants = {v for t in every for v in (self.norm(t), *self.group(t))}
        return sorted({x for v in variants for x in (v, *v.split()) if x})
