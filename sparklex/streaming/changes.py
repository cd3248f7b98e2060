"""Replay of a change log into a table: events are folded by key in the order of seq, in batches or as a stream.

An event: seq, op (INSERT, UPDATE, DELETE, TRUNCATE), key, old_key (of an UPDATE that moves a row), text (null: left as it
was), keep (whether the row passes the required filters); if there, tbl (its table) and text_state (absent, null, present:
null sets the text to null), and columns that are carried along. INSERT of a key that is there is ignored; UPDATE replaces,
inserts or removes, by keep; TRUNCATE ends all before it. CREATE and ALTER whose text is the known schema change nothing;
those with another one, DROP and RENAME stop the replay before anything is applied.

The fold has no list of a key's events: a row is there if something put it after the last event that removed it. Its text and
carried columns are those of the last UPDATE after that, else of what first put it. All of that are aggregates that combine
before the shuffle, so a key with a third of all events is no large group.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

OPS = ("INSERT", "UPDATE", "DELETE", "TRUNCATE")
BEFORE = -(1 << 62)
BUCKETS = 64


def _stop(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def keyed(events: DataFrame, after: int | None = None, base: DataFrame | None = None, carry: tuple[str, ...] = (), tables: tuple[str, ...] | None = None, schema: str | None = None) -> DataFrame:
    """seq, key, op, text, has_text, keep and carried columns of events of these tables after a snapshot's seq and the last TRUNCATE.

    base (key, text, carried columns) counts as inserted before all events. An update of the key is a delete and an insert;
    it must bring its text.
    """
    rows = events if after is None else events.where(F.col("seq") > after)
    rows = rows if tables is None else rows.where(F.col("tbl").isin(*tables))
    same = F.col("op").isin("CREATE", "ALTER") & F.coalesce(F.col("text") == F.lit(schema), F.lit(False))
    rows = rows.where(~same).withColumn("op", F.when(F.col("op").isin(*OPS), F.col("op")).otherwise(_stop("a change of the schema stops the replay", "string")))
    state = F.col("text_state") if "text_state" in events.columns else F.when(F.col("text").isNull(), "absent").otherwise("present")
    rows = rows.withColumns({"has_text": state != "absent", "text": F.when(state == "present", F.col("text"))})
    moved = (F.col("op") == "UPDATE") & F.col("old_key").isNotNull() & (F.col("old_key") != F.col("key"))
    put = F.when(F.col("has_text"), F.lit("INSERT")).otherwise(_stop("an update of the key without its text", "string"))
    parts = F.when(moved, F.array(F.struct(F.col("old_key").alias("k"), F.lit("DELETE").alias("o")), F.struct(F.col("key").alias("k"), put.alias("o")))).otherwise(F.array(F.struct(F.col("key").alias("k"), F.col("op").alias("o"))))
    cut = rows.agg(F.max(F.when(F.col("op") == "TRUNCATE", F.col("seq"))).alias("cut"))  # one row
    rows = rows.where("op <> 'TRUNCATE'").withColumn("part", F.explode(parts)).select("seq", F.col("part.k").alias("key"), F.col("part.o").alias("op"), "text", "has_text", "keep", *carry)
    if base is not None:
        rows = rows.unionByName(base.select(F.lit(BEFORE).alias("seq"), "key", F.lit("INSERT").alias("op"), "text", F.lit(True).alias("has_text"), F.lit(True).alias("keep"), *carry))
    return rows.crossJoin(F.broadcast(cut)).where("cut IS NULL OR seq > cut").drop("cut")


def folded(events: DataFrame, base: DataFrame | None = None, after: int | None = None, carry: tuple[str, ...] = (), tables: tuple[str, ...] | None = None, schema: str | None = None) -> DataFrame:
    """key, text and carried columns of the rows that are there after all events; base is what was there before."""
    rows = keyed(events, after, base, carry, tables, schema)
    keep = F.coalesce(F.col("keep"), F.lit(False))
    gone = (F.col("op") == "DELETE") | ((F.col("op") == "UPDATE") & ~keep)
    removed = rows.groupBy("key").agg(F.max(F.when(gone, F.col("seq"))).alias("gone")).where("gone IS NOT NULL")
    puts = rows.join(removed, "key", "left").where((F.col("gone").isNull() | (F.col("seq") > F.col("gone"))) & keep & F.col("op").isin("INSERT", "UPDATE"))
    updated = F.when(F.col("op") == "UPDATE", F.col("seq"))
    whole = F.struct("text", *carry)
    each = puts.groupBy("key").agg(F.min_by(whole, "seq").alias("first"), F.max_by(whole, updated).alias("last"), F.max_by(F.struct("text"), F.when(F.col("has_text"), updated)).alias("told"))
    text = F.when(F.col("told").isNotNull(), F.col("told.text")).otherwise(F.col("first.text"))
    return each.select("key", text.alias("text"), *[F.when(F.col("last").isNotNull(), F.col(f"last.`{c}`")).otherwise(F.col(f"first.`{c}`")).alias(c) for c in carry])


def checked(events: DataFrame) -> DataFrame:
    """A problem a row of a change log: kind, n. Empty if it can be replayed: numbered once each, known operations, keys where they are needed."""
    ops = (*OPS, "CREATE", "ALTER", "DROP", "RENAME")
    kinds = F.when(F.col("seq").isNull(), "no seq").when(~F.coalesce(F.col("op").isin(*ops), F.lit(False)), "no such op").when(F.col("op").isin("INSERT", "UPDATE", "DELETE") & F.col("key").isNull(), "no key")
    single = events.select(kinds.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))
    twice = events.where("seq IS NOT NULL").groupBy("seq").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).where("n > 0")
    return single.unionByName(twice.select(F.lit("seq twice").alias("kind"), "n"))


class ReplayTable:
    """A table kept below a path, in buckets of keys; each version names for each bucket the files that it has then.

    A batch rewrites only buckets of its keys, into files of its own, and counts once its manifest is there: a batch that was
    broken off is done again from the version before it. Old versions stay readable until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, carry: tuple[str, ...] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.carry, self.buckets = spark, path.rstrip("/"), carry, buckets

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        fs = self._files()
        found = fs.listStatus(self._at("manifest")) if fs.exists(self._at("manifest")) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._at(f"manifest/{n}/_SUCCESS")))

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}").first().value)

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """key, text and carried columns of a version (the last one); None before there is any."""
        known = self.versions()
        if version is None and not known:
            return None
        m = self.manifest(known[-1] if version is None else version)
        parts = sorted({f"{self.path}/data/{v}/bucket={b}" for b, v in m["buckets"].items() if only is None or int(b) in only})
        try:
            return self.spark.read.schema(m["schema"]).option("basePath", f"{self.path}/data").parquet(*parts).select("key", "text", *self.carry) if parts else None
        except AnalysisException:
            return None

    def apply(self, batch: DataFrame, number: int, anew: bool = False, **how) -> None:
        """One more version, numbered; done before, it isn't done again. anew: the batch may begin before what was applied last."""
        known = self.versions()
        if number in known:
            return
        base = [v for v in known if v < number]
        old = self.manifest(base[-1]) if base else {"buckets": {}, "schema": "", "seq": None}
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        batch = batch if anew or old["seq"] is None else batch.where(F.col("seq") > old["seq"])
        keys = batch.select("key").union(batch.where("old_key IS NOT NULL").select(F.col("old_key").alias("key")))
        facts = batch.agg(F.max("seq").alias("seq"), F.max(F.col("op") == "TRUNCATE").alias("cut")).first()
        touched = sorted(r.b for r in keys.where("key IS NOT NULL").select(bucket.alias("b")).distinct().collect())  # at most self.buckets
        before = self.read(base[-1], touched) if base and not facts.cut else None
        made = folded(batch, before, carry=self.carry, **how)
        made.withColumn("bucket", bucket).repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        fs = self._files()
        buckets = {} if facts.cut else {b: v for b, v in old["buckets"].items() if int(b) not in touched}
        buckets |= {str(b): number for b in touched if fs.exists(self._at(f"data/{number}/bucket={b}"))}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
        m = {"buckets": buckets, "schema": schema, "seq": max((x for x in (facts.seq, None if anew else old["seq"]) if x is not None), default=None)}
        self.spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{number}")

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the last versions, and the files that none of them names."""
        known, fs = self.versions(), self._files()
        gone, stay = known[:-keep], known[-keep:]
        named = {(v, b) for k in stay for b, v in self.manifest(k)["buckets"].items()}
        for k in gone:
            for b, v in self.manifest(k)["buckets"].items():
                if (v, b) not in named:
                    fs.delete(self._at(f"data/{v}/bucket={b}"), True)
        for k in gone:
            fs.delete(self._at(f"manifest/{k}"), True)


def stream_into(events: DataFrame, table: ReplayTable, checkpoint: str, keep: int | None = None, **how):
    """Applies a stream of events to a ReplayTable, a version for each batch (the last keep stay); returns the StreamingQuery.

    The batch's number and the events' seq say what was applied before, so a batch that Spark gives again changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.apply(batch, number, **how)
        if keep:
            table.vacuum(keep)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()


def rebuilt(table: ReplayTable, snapshot: DataFrame, seq: int) -> int:
    """A new version from a whole snapshot (key, text, carried columns) taken at seq, beside the old ones; its number. Later events go on from it."""
    number = max(table.versions(), default=-1) + 1
    rows = snapshot.select(F.lit(seq).alias("seq"), F.lit("INSERT").alias("op"), "key", F.lit(None).cast(snapshot.schema["key"].dataType).alias("old_key"), "text", F.lit("present").alias("text_state"), F.lit(True).alias("keep"), *table.carry)
    cut = rows.limit(0).unionByName(table.spark.createDataFrame([(seq - 1, "TRUNCATE")], "seq long, op string"), allowMissingColumns=True)
    table.apply(rows.unionByName(cut), number, anew=True)
    return number
