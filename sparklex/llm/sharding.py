"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows uniformly, by a seeded hash, into buckets of bounded size, each of which one task holds in order; pass
two shuffles each bucket by Fisher-Yates and writes it. What Spark's shuffle() shuffles is the bucket's array of places: its
draws follow from the seed and the number of the partition, so each array is dealt to the partition of its bucket's number,
alone, and the same rows get the same slots whatever the plan and however often a task is run. A shard is the sequence of its
buckets: a row's slot is its bucket's offset plus its place in the shuffled bucket.

Shards follow the law "key": rendezvous hashing, where a row goes to the shard whose seeded hash with the row's
key is largest. Key and shard count alone decide, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklex.llm.scratch import new_path

BUCKET_BYTES = 16 << 20
#: Buckets of one task, on average: as they are hashed to tasks, some get several times as many.
TASK_BUCKETS = 1


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard of 0 to shards - 1 that wins the key; ties go to the larger shard. A null key is a key too."""
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s"))))
    return best["s"]


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, out: str | None = None) -> DataFrame:
    """Writes docs as shuffled shards (Parquet, a folder for each shard) and returns the written table.

    Columns: the id and text as given, size (UTF-8 bytes of the text, a null counting none, plus 8), text_crc32,
    law, shard, slot (gapless from 0 in each shard), grown_shard (with one more shard). Other columns of docs are
    left behind, so none can clash. A shard's order is that of slot: its files hold whole buckets, each in that order, but
    the files' names don't follow it. Null ids are one key; repeated ids share a shard and a bucket, which is sorted, never
    held as one array of rows; empty tables give empty shards; ties in the bucket's order before the shuffle are equal rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    buckets = max(1, ceil(total / shards / bucket_bytes))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"shard": rendezvous(F.col("id"), shards, seed), "bucket": F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.lit(buckets)).cast("int")})

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed(rows.select("id")).groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    alone = counts.repartitionById(shards * buckets, (F.col("shard") * buckets + F.col("bucket")).cast("int"))
    places = alone.select("shard", "bucket", "offset", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("places"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text")
    tasks = max(1, ceil(shards * buckets / TASK_BUCKETS))
    scattered = placed(rows).repartition(tasks, "shard", "bucket").withColumn("pos", F.row_number().over(inside) - 1)
    slot = F.col("offset") + F.get("places", F.col("pos"))
    path = out or new_path(spark, "shards")
    table = scattered.join(places.hint("merge"), ["shard", "bucket"]).select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), slot.cast("long").alias("slot"), rendezvous(F.col("id"), shards + 1, seed).cast("int").alias("grown_shard"), F.col("shard").cast("int").alias("shard"),
    )
    table.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)
