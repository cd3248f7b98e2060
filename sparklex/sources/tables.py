"""Snapshots and synonym files as sources of search tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions.text import all_of, normalize, normalized
from sparklex.functions.values import typed
from sparklex.plans.predicate import required
from sparklex.plans.spec import TableSpec

MOST_SYNONYMS = 20


def text_source(columns: tuple[str, ...], delimiter: str = " ") -> Column:
    """The columns that aren't empty, joined; null if all are null."""
    cs = [F.col(f"`{c}`").cast("string") for c in columns]
    return F.when(F.coalesce(*cs).isNotNull(), F.concat_ws(delimiter, *[F.when(c != "", c) for c in cs]))


def documents(snapshot: DataFrame, spec: TableSpec) -> DataFrame:
    """The search table of a snapshot: key, filters, norm_text, orig_text of rows that the required filters let in.

    A null key fails the job, whatever columns are asked for. Of rows with one key that the filters let in, the first in the
    order of their texts stays, then of their filter columns; nulls come last. With spec.unique, such a key fails the job.
    Filter columns with a type in spec.types are read from texts; what isn't of the type is null.
    """
    kinds = dict(spec.types)
    snapshot = snapshot.withColumns({c: typed(F.col(f"`{c}`").cast("string"), kinds[c]) for c in spec.filters if c in kinds})
    checked = snapshot.where(F.when(F.col(f"`{spec.key}`").isNull(), F.raise_error(F.lit("a row without key")).cast("boolean")).otherwise(F.lit(True)))
    rows = checked.where(all_of([required(f, snapshot.schema) for f in spec.required]))
    source = text_source(spec.text, spec.delimiter)
    first = first_by_key(rows.select(F.col(f"`{spec.key}`"), *[F.col(f"`{c}`") for c in spec.filters], source.alias("orig_text")), spec.key, "orig_text", *spec.filters, unique=spec.unique)
    return first.select(f"`{spec.key}`", *[F.col(f"`{c}`") for c in spec.filters], normalized(F.col("orig_text"), spec.nfkc, spec.width, spec.lower).alias("norm_text"), "orig_text")


def first_by_key(rows: DataFrame, key: str, *arrival: str, unique: bool = False) -> DataFrame:
    """Insert-or-ignore: of rows with one key, that which arrived first, by these columns; nulls come last. unique: a second row fails the job."""
    order = F.struct(*[x for c in arrival for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    best = rows.groupBy(f"`{key}`").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("r"), F.count("*").alias("rows"))
    if unique:
        best = best.where(F.when(F.col("rows") > 1, F.raise_error(F.lit("a key occurs twice")).cast("boolean")).otherwise(F.lit(True)))
    return best.select("r.*")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1")


def synonyms(lines: list[str], spec: TableSpec) -> dict[str, tuple[str, ...]]:
    """Each normalised term's group. A line is a group, parted by tabs; # begins a comment; a term's first group counts."""
    out: dict[str, tuple[str, ...]] = {}
    for line in lines:
        line = line.rstrip("\r\n")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        terms = sorted({normalize(t.strip(), spec.nfkc, spec.width, spec.lower) for t in line.split("\t")} - {""})[:MOST_SYNONYMS]
        terms = [t for t in terms if t not in out]
        if len(terms) >= 2:
            out |= dict.fromkeys(terms, tuple(terms))
    return out


def read_synonyms(spark: SparkSession, path: str, spec: TableSpec) -> dict[str, tuple[str, ...]]:
    """synonyms() of a text file's lines, in their order; such a file is small, as it goes to the driver."""
    return synonyms(spark.read.text(path, wholetext=True).first().value.split("\n"), spec)


def read_spec(spark: SparkSession, path: str) -> TableSpec:
    """A table's settings from a JSON file."""
    return TableSpec.from_dict(json.loads(spark.read.text(path, wholetext=True).first().value))
