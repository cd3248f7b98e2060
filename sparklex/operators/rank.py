"""BM25 scores and orders."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklex.functions.text import has, term_count

K1, B = 1.2, 0.75


def corpus_counts(texts: DataFrame, terms: list[str], n: int, text: str = "norm_text") -> DataFrame:
    """docs (texts that aren't empty), length (of all), and df: for each term in how many texts it is (0 if it is shorter than an n-gram). One row, one scan."""
    c = F.col(text)
    df = [F.count_if(has(c, t)) if len(t) >= n else F.lit(0).cast("long") for t in terms]
    return texts.agg(F.count_if(c != "").alias("docs"), F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long").alias("length"), F.array(*df).cast("array<long>").alias("df"))


def corpus_stats(texts: DataFrame, terms: list[str], n: int, text: str = "norm_text", known: tuple[int, int] | None = None) -> tuple[int, float, dict[str, int]]:
    """Number of texts that aren't empty, their mean length, and in how many each term is. known: the first two, as counted before (docs, length)."""
    wanted = list(dict.fromkeys(terms))
    row = corpus_counts(texts, wanted, n, text).first()
    docs, length = known or (row.docs, row.length)
    return docs, length / docs if docs else 0.0, dict(zip(wanted, row.df or [], strict=True))


def idf(docs: int, df: int) -> float:
    return log((docs - min(df, docs) + 0.5) / (min(df, docs) + 0.5) + 1) if docs else 0.0


def bm25(terms: list[str], docs: int, mean: float, df: dict[str, int], text: str = "norm_text", k1: float = K1, b: float = B) -> Column:
    c = F.col(text)
    score = F.lit(0.0)
    for t in terms:
        tf = term_count(c, t)
        score = score + F.lit(idf(docs, df.get(t, 0))) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.length(c) / max(mean, 1.0)))
    return F.coalesce(F.when(c != "", score), F.lit(0.0))


def sort_key(df: DataFrame, name: str, key: str) -> Column:
    """What rows are sorted by. Keys that are texts of digits (64 bits at most) count as numbers; other texts go by their bytes, null as an empty one."""
    c = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, T.StringType):
        return c
    if name != key:
        return F.coalesce(c, F.lit(""))
    value = F.when(c.rlike("^[0-9]{1,20}$"), c.try_cast("decimal(20,0)"))
    return F.when(value < F.lit(str(1 << 64)).cast("decimal(20,0)"), F.lpad(value.cast("string"), 20, "0")).otherwise(c)


def ordered(df: DataFrame, column: str | None, ascending: bool, key: str = "doc_id") -> DataFrame:
    """By a column (nulls first when ascending, last when not) and the key in the same direction."""
    keys = [sort_key(df, name, key) for name in ([key] if column in (None, key) else [column, key])]
    return df.orderBy(*[c.asc_nulls_first() if ascending else c.desc_nulls_last() for c in keys])
