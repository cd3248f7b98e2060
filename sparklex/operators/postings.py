"""The posting form of a search table: which keys have which n-gram, bucketed, so that a query reads only its n-grams' buckets.

Postings are a Parquet table with a folder for each bucket of n-grams; a row has an n-gram and the keys of some texts with it (those
that a task held at a time), so that far fewer rows than postings are shuffled and sorted. Beside it stand the corpus statistics,
counted once. A conjunction of terms is a semi-join of the table with the keys that have all n-grams. What postings can't decide (terms too short for
an n-gram, order of n-grams) the query's predicate decides on the rows that are left, so that results equal those of a scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklex.functions.text import gram_places, ngrams
from sparklex.plans.spec import TableSpec

BUCKETS = 256
#: Characters of texts whose postings are put together at a time, but for one longer text.
CHARS = 1 << 20


def posting_lists(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """ngram, keys: the distinct n-grams of the texts and the keys of those that have them, a row for each CHARS of texts in a task.

    A row's key is there once for each of its distinct n-grams; equal keys are kept apart, and null texts have no n-grams.
    """
    most, kinds = CHARS, [(spec.n, None)] if spec.kanji in (0, spec.n) else [(spec.n, False), (spec.kanji, True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = [t or "" for t in batch.column("text").to_pylist()], batch.column("key")
            end = np.cumsum([len(t) for t in texts])
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
                for size, ideographs in kinds:
                    grams, of, count = gram_places(texts[i:j], size, ideographs, spec.cross)
                    offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), keys.take(pa.array(of + i)))], ["ngram", "keys"])
                i = j

    named = rows.select(F.col("norm_text").alias("text"), F.col(f"`{spec.key}`").alias("key"))
    return named.mapInArrow(run, f"ngram string, keys array<{named.schema['key'].dataType.simpleString()}>")


class Postings:
    def __init__(self, spark: SparkSession, path: str, spec: TableSpec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        meta = json.loads(spark.read.text(f"{self.path}/meta").first().value)
        if meta["form"] != [spec.key, spec.n, spec.kanji, spec.cross]:
            raise ValueError("the postings are of another table, or of other n-grams")
        self.buckets, self.docs, self.length = meta["buckets"], meta["docs"], meta["length"]
        self.lists = spark.read.parquet(f"{self.path}/postings")
        self.rows = self.lists.select("bucket", "ngram", F.explode("keys").alias("key"))

    @classmethod
    def build(cls, rows: DataFrame, spec: TableSpec, path: str, buckets: int = BUCKETS) -> Postings:
        """Writes the postings of a search table's rows (key, norm_text) and their statistics."""
        spark, text = rows.sparkSession, F.col("norm_text")
        # several tasks a bucket, by key: a bucket may hold a very common n-gram
        parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        placed = posting_lists(rows, spec).withColumn("bucket", F.pmod(F.xxhash64("ngram"), F.lit(buckets)).cast("int")).repartition("bucket", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(parts)))
        placed.sortWithinPartitions("bucket", "ngram").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
        docs, length = rows.agg(F.count_if(text != ""), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
        meta = json.dumps({"form": [spec.key, spec.n, spec.kanji, spec.cross], "buckets": buckets, "docs": docs, "length": length})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
        return cls(spark, path, spec)

    def of(self, grams: list[str]) -> DataFrame:
        """ngram, key of these n-grams: only their buckets are read, and in them only their pages."""
        wanted = self.spark.createDataFrame([(g,) for g in grams], "ngram string")
        buckets = [r.b for r in wanted.select(F.pmod(F.xxhash64("ngram"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # of a query's terms
        return self.rows.where(F.col("bucket").isin(buckets) & F.col("ngram").isin(grams)).select("ngram", "key")

    def keys(self, terms: list[str]) -> DataFrame | None:
        """key of the texts that have all n-grams of all terms; None if no term has an n-gram, so that a scan must do."""
        grams = list(dict.fromkeys(g for t in terms for g in ngrams(t, self.spec.n, self.spec.kanji, self.spec.cross)))
        if not grams:
            return None
        found = self.of(grams)
        return found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("key") if len(grams) > 1 else found.select("key")

    def sizes(self) -> DataFrame:
        return self.lists.groupBy("ngram").agg(F.sum(F.size("keys")).alias("docs"))

    def optimized(self, path: str) -> Postings:
        """The same postings written anew, in fewer and sorted files."""
        self.lists.repartition("bucket").sortWithinPartitions("bucket", "ngram").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
        self.spark.read.text(f"{self.path}/meta").coalesce(1).write.text(f"{path}/meta")
        return Postings(self.spark, path, self.spec)
