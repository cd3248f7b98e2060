"""SearchTable: search, count, facet, get, statistics, save and load."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions.text import all_of
from sparklex.operators.highlight import highlighted
from sparklex.operators.postings import BUCKETS, Postings, posting_lists
from sparklex.operators.rank import bm25, corpus_stats, ordered
from sparklex.plans.language import command
from sparklex.plans.predicate import Compiler, resolve
from sparklex.plans.spec import Query, TableSpec
from sparklex.sources.tables import documents


class SearchTable:
    """A table's rows (key, filters, norm_text, orig_text) and the searches on them. index: their postings; seq: the position in the change log that they stand for."""

    def __init__(self, rows: DataFrame, spec: TableSpec, synonyms: dict[str, tuple[str, ...]] | None = None, index: Postings | None = None, seq: int | None = None):
        self.rows, self.spec, self.index, self.seq = rows, spec, index, seq
        self.compiler = Compiler(spec, rows.select(spec.key, *spec.filters).schema, synonyms)
        self.kept: dict[tuple, DataFrame] = {}

    @classmethod
    def of(cls, snapshot: DataFrame, spec: TableSpec, synonyms: dict[str, tuple[str, ...]] | None = None) -> SearchTable:
        return cls(documents(snapshot, spec), spec, synonyms)

    def matches(self, q: Query) -> DataFrame:
        if (k := q.key()) in self.kept:
            return self.kept[k]
        return self.candidates(q).where(self.compiler.predicate(q))

    def candidates(self, q: Query) -> DataFrame:
        """The rows, or those that the postings leave for a query's terms (fuzzy terms and such with synonyms go by a scan)."""
        terms = [] if self.index is None or q.fuzzy else [g[0] for t in q.terms if len(g := self.compiler.group(t)) == 1]
        keys = self.index.keys(terms) if terms else None
        return self.rows if keys is None else self.rows.join(keys.withColumnRenamed("key", self.spec.key), self.spec.key, "left_semi")

    def keep(self, q: Query) -> DataFrame:
        """Keeps a query's matches in memory, for all its orders and pages."""
        return self.kept.setdefault(q.key(), self.candidates(q).where(self.compiler.predicate(q)).persist())

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()

    def scored(self, q: Query) -> DataFrame:
        terms = self.compiler.score_terms(q)
        return self.matches(q).withColumn("score", bm25(terms, *corpus_stats(self.rows, terms, self.spec.n, known=(self.index.docs, self.index.length) if self.index else None)))

    def search(self, q: Query) -> DataFrame:
        """A page of keys (by default the largest first), with score or snippet where asked for."""
        if q.sort == "score":
            found, by, more = self.scored(q), "score", ["score"]
        else:
            by = None if q.sort is None else resolve(q.sort, [self.spec.key, *self.spec.filters])
            if q.sort is not None and by is None:
                raise ValueError(f"no column to sort by: {q.sort}")
            found, more = self.matches(q), [by] if by not in (None, self.spec.key) else []
        if q.highlight:
            original = "orig_text" if "orig_text" in self.rows.columns else "norm_text"
            more = [*more, "norm_text", *(["orig_text"] if original == "orig_text" else [])]
        page = ordered(found.select(self.spec.key, *more), by, q.ascending, self.spec.key).offset(q.offset).limit(q.limit)
        if q.highlight:
            page = page.withColumn("snippet", highlighted(F.col(original), F.col("norm_text"), self.compiler.highlight_terms(q), q.highlight, self.compiler.norm)).drop("norm_text", "orig_text")
        return page

    def search_with_total(self, q: Query) -> DataFrame:
        """search(), with total: the number of all matches, before limit and offset."""
        return self.search(q).crossJoin(F.broadcast(self.count(q)))

    def search_json(self, q: Query) -> DataFrame:
        """One row, json: count (of all matches), limit, offset, results (primary_key, filters and, if asked for, highlight of each row of the page)."""
        key = F.col(f"`{self.spec.key}`")
        page = self.search(q)
        place = F.monotonically_increasing_id()  # the page is one sorted partition
        page = page.select(key, *([c for c in ("snippet",) if c in page.columns]), place.alias("place"))
        filters = F.struct(*[F.col(f"`{c}`") for c in self.spec.filters]) if self.spec.filters else F.create_map()
        rows = self.rows.select(key, filters.alias("filters")).join(F.broadcast(page), self.spec.key)  # MOST_LIMIT rows at most
        one = F.struct(key.cast("string").alias("primary_key"), "filters", *([F.col("snippet").alias("highlight")] if q.highlight else []))
        results = rows.agg(F.sort_array(F.collect_list(F.struct("place", one.alias("r")))).alias("rs")).select(F.transform("rs", lambda x: x["r"]).alias("results"))
        whole = results.crossJoin(F.broadcast(self.count(q)))
        return whole.select(F.to_json(F.struct(F.col("total").alias("count"), F.lit(q.limit).alias("limit"), F.lit(q.offset).alias("offset"), "results")).alias("json"))

    def count(self, q: Query) -> DataFrame:
        return self.matches(q).agg(F.count("*").alias("total"))

    def facet(self, column: str, q: Query | None = None) -> DataFrame:
        """value, n of a column over the matches, the most first and then by value; nulls aren't counted."""
        name = resolve(column, list(self.spec.filters))
        if name is None:
            raise ValueError(f"no filter column: {column}")
        c = F.col(f"`{name}`")
        found = (self.matches(q) if q else self.rows).where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"))
        found = found.orderBy(F.desc("n"), F.asc("value"))
        return found.offset(q.offset).limit(q.limit) if q else found

    def facet_with_total(self, column: str, q: Query | None = None) -> DataFrame:
        """facet() as it is shown (values as texts), with values: the number of distinct ones before limit and offset."""
        name = resolve(column, list(self.spec.filters))
        shown = self.facet(column, q)
        every = (self.matches(q) if q else self.rows).agg(F.count_distinct(F.col(f"`{name}`")).alias("values"))
        return shown.select(F.col("value").cast("string").alias("value"), "n").crossJoin(F.broadcast(every))

    def funnel(self, q: Query) -> DataFrame:
        """stage, rows: how many rows a query's terms, exclusions, filters and verification leave, one after the other, in one scan."""
        stages = self.compiler.stages(q)
        counts = [F.count_if(all_of([c for _, c in stages[: k + 1]])).alias(name) for k, (name, _) in enumerate(stages)]
        row = self.rows.agg(F.count("*").alias("all"), *counts)
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("rows")) for c in row.columns])).alias("s")).select("s.*")

    def get(self, key: object) -> DataFrame:
        return self.rows.where(F.col(self.spec.key) == F.lit(key)).drop("norm_text")

    def postings(self) -> DataFrame:
        """ngram, key: one row for each text's distinct n-gram."""
        return posting_lists(self.rows, self.spec).select("ngram", F.explode("keys").alias(self.spec.key))

    def posting_sizes(self) -> DataFrame:
        return posting_lists(self.rows, self.spec).groupBy("ngram").agg(F.sum(F.size("keys")).alias("docs"))

    def statistics(self) -> DataFrame:
        return self.posting_sizes().agg(F.count("*").alias("terms"), F.sum("docs").alias("postings"))

    def indexed(self, path: str, buckets: int = BUCKETS) -> SearchTable:
        """This table with postings, which are built below path."""
        return SearchTable(self.rows, self.spec, self.compiler.synonyms, Postings.build(self.rows, self.spec, path, buckets), self.seq)

    def save(self, path: str) -> None:
        """The rows as Parquet, and beside them settings, position and what they are checked by on loading. A path that is taken is an error."""
        self.rows.write.parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        count, digest = _digest(spark.read.parquet(f"{path}/rows"), self.spec.key)
        meta = {"rows": count, "digest": digest, "seq": self.seq, "spec": self.spec.to_dict(), "synonyms": sorted({g for g in self.compiler.synonyms.values()})}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")

    @staticmethod
    def saved(spark: SparkSession, path: str) -> dict:
        """What a saved table is: rows, digest, seq, spec, synonyms."""
        return json.loads(spark.read.text(f"{path}/meta").first().value)

    @staticmethod
    def verify(spark: SparkSession, path: str) -> bool:
        """Whether the rows below path are those that were saved."""
        meta = SearchTable.saved(spark, path)
        return _digest(spark.read.parquet(f"{path}/rows"), meta["spec"]["key"]) == (meta["rows"], meta["digest"])

    @classmethod
    def load(cls, spark: SparkSession, path: str, spec: TableSpec | None = None, synonyms: dict[str, tuple[str, ...]] | None = None) -> SearchTable:
        """A saved table, after a check of its rows; with a spec, of these settings or none."""
        meta = cls.saved(spark, path)
        if spec is not None and json.loads(json.dumps(spec.to_dict())) != meta["spec"] or not cls.verify(spark, path):
            raise ValueError("the saved table is another one, or damaged")
        groups = {t: tuple(g) for g in meta["synonyms"] for t in g}
        return cls(spark.read.parquet(f"{path}/rows"), TableSpec.from_dict(meta["spec"]), groups if synonyms is None else synonyms, seq=meta["seq"])

    @classmethod
    def open_or_build(cls, spark: SparkSession, path: str, snapshot: DataFrame, spec: TableSpec, seq: int | None = None, synonyms: dict[str, tuple[str, ...]] | None = None) -> SearchTable:
        """The table saved below path, if there is one of these settings; else it is built from the snapshot taken at seq, and saved there."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return cls.load(spark, path, spec, synonyms)
        made = cls.of(snapshot, spec, synonyms)
        made.seq = seq
        made.save(path)
        return cls.load(spark, path, spec, synonyms)


def _digest(rows: DataFrame, key: str) -> tuple[int, int | None]:
    row = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(f"`{key}`", "norm_text"))).first()
    return row[0], row[1]


def run(tables: dict[str, SearchTable], text: str) -> DataFrame:
    """The result of a command in text form: SEARCH with total, COUNT, FACET with its number of values, GET."""
    c = command(text)
    if c.table not in tables:
        raise ValueError(f"no table: {c.table}")
    t = tables[c.table]
    if c.verb == "GET":
        return t.get(c.key)
    if c.verb == "COUNT":
        return t.count(c.query)
    if c.verb == "FACET":
        return t.facet_with_total(c.column, c.query)
    return t.search_with_total(c.query)
