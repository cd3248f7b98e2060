"""Near-duplicates by min-max hashing.

Each document's set of word shingles is hashed under some permutations, and of each both the least and the greatest value
are kept: twice as many unbiased values as hash evaluations, with less variance than as many minima. The values are banded;
documents that share a band are candidates, and a candidate is linked only if the full sets are similar enough.

Documents with equal sets are one class from the start. A class is compared with one other first: of the hubs of its bands'
buckets (the members whose buckets are largest in all) the most central. Where that leaves a bucket in several components,
all its members are compared with one hub of theirs, and what they have in common with it bounds what two of them can have
in common with each other: the smaller share of the hub's set, and of the shingles outside the hub's set those that both
have. So two members can be similar only if the hub's part alone is enough (they meet in their bucket), or if they share one
of the rarest shingles that they have outside the hub (they meet there: a prefix filter). Only pairs with a member that isn't
connected with the hub are met, and only where these bounds allow a link. Groups that are too large for that get new hubs
from the members not connected yet, and at last are dealt into blocks, each two of which meet. No pair that shares a band is
left out: all others are compared, connected already, or shown by exact counts not to be similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.bytewords import Chunk, chunks, mix, random64, windows, words
from sparklex.llm.components import components
from sparklex.llm.scratch import dropped, written

#: A similar pair shares no band with at most this probability.
MISS = 1e-6
#: Pairs of a group that are weighed against the bounds at once are at most the square of this; larger groups get new hubs, then blocks.
SMALL = 1024
#: Candidates of one class that are compared in one group.
GROUP = 500


def banding(similarity: float) -> tuple[int, int]:
    """Rows of a band and bands: more rows the more similar pairs must be, bands for MISS."""
    rows = 5 if similarity >= 0.85 else 4 if similarity >= 0.75 else 3
    bands = ceil(log(MISS) / log(1 - similarity**rows))
    return rows, bands + bands * rows % 2  # an even number of values


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of each text's distinct k-word shingles (one of all words, if they are fewer) and where each text's begin."""
    w = words(c, lower=True)
    n = w.per_text()
    h = windows(w.hash, k)
    parts = []
    for a, m in zip(w.first[:-1].tolist(), n.tolist(), strict=True):
        if m >= k:
            parts.append(np.unique(h[a : a + m - k + 1]))
        elif m:
            parts.append(mix(windows(w.hash[a : a + m], m) + np.uint64(m)))
        else:
            parts.append(h[:0])
    return np.concatenate(parts) if parts else h[:0], np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def signatures(rows: DataFrame, k: int, similarity: float, seed: int = 3) -> DataFrame:
    """id, n_shingles, s1, s2 (equal for equal sets) and bands (a hash of each; none of an empty set) of rows (id, text)."""
    per_band, bands = banding(similarity)
    a = random64(per_band * bands // 2, seed) | np.uint64(1)
    of_band = random64(bands, seed + 1)
    weight = random64(per_band, seed + 2) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            sets, first = shingle_sets(c, k)
            n = np.diff(first)
            some = np.flatnonzero(n)
            at = first[some]
            keys = np.zeros((len(some), bands), np.uint64)
            s1, s2 = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
            if len(some):
                s1[some] = np.add.reduceat(mix(sets), at)
                s2[some] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at)
                values = np.empty((len(some), 2 * len(a)), np.uint64)
                buffer = np.empty_like(sets)
                for i, x in enumerate(a):
                    np.multiply(sets, x, out=buffer)
                    values[:, 2 * i] = np.minimum.reduceat(buffer, at)
                    values[:, 2 * i + 1] = np.maximum.reduceat(buffer, at)
                for b in range(bands):
                    keys[:, b] = mix((mix(values[:, b * per_band : (b + 1) * per_band]) * weight).sum(1, dtype=np.uint64) + of_band[b])
            size = np.zeros(len(c), np.int64)
            size[some] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([c.rows.column("id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], ["id", "n_shingles", "s1", "s2", "bands"])

    return rows.mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame, k: int, similarity: float, outside: bool = True) -> DataFrame:
    """a, b, both, linked, outside of each pair (a, b): the shingles in common, whether the full sets have at least this
    Jaccard similarity and, if wanted, those of b that a hasn't. texts: id, text.

    The sets of a's partners meet a's set in groups of bounded size; a's text goes to each of its groups.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    members = pairs.join(groups, "a").select(F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "groups").cast("int").alias("part"), F.lit(1).alias("member"))
    hubs = groups.select(F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("member"))
    dealt = texts.join(members.unionByName(hubs).hint("merge"), "id").select("hub", "part", "member", "id", "text")
    percent = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for c in chunks(batches):
            sets, first = shingle_sets(c, k)
            a, b, n, ok, rest = [], [], [], [], []
            for i, (hub, part, member, number) in enumerate(zip(*(c.rows.column(x).to_pylist() for x in ("hub", "part", "member", "id")), strict=True)):
                mine = sets[first[i] : first[i + 1]]
                if not member:
                    now, own = (hub, part), mine.copy()
                    continue
                if now != (hub, part):
                    raise RuntimeError("a group of candidates has lost its first row")
                if not len(mine) or not len(own):
                    continue
                same = own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine
                both = int(same.sum())
                a.append(hub)
                b.append(number)
                n.append(both)
                ok.append(100 * both >= percent * (len(own) + len(mine) - both))
                rest.append(mine[~same].view(np.int64) if outside else mine[:0].view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(x) for x in rest]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rest) if rest else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(ok, pa.bool_()), lists], ["a", "b", "both", "linked", "outside"])

    return dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInArrow(run, "a long, b long, both long, linked boolean, outside array<long>")


class Links:
    """What has been compared so far, and the components (node, component) of what was linked."""

    def __init__(self, texts: DataFrame, k: int, similarity: float):
        self.texts, self.k, self.similarity = texts, k, similarity
        self.known: DataFrame | None = None  # of pairs (hub, class)
        self.others: DataFrame | None = None  # of other pairs, without what is outside
        self.reached: DataFrame | None = None

    def add(self, pairs: DataFrame, outside: bool = True) -> None:
        """Compares pairs (a, b), each once, that weren't compared before. The components found so far go in as stars, which need few rounds."""
        pairs = pairs.distinct()
        done = [x.select("a", "b") for x in ([self.known] if outside else [self.known, self.others]) if x is not None]
        if not outside and self.known is not None:
            done.append(self.known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        for x in done:
            pairs = pairs.join(x, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidates", narrow=True)
        if pairs.isEmpty():
            return
        new = written(compared(pairs, self.texts, self.k, self.similarity, outside), "compared")
        if outside:
            self.known = new if self.known is None else self.known.unionByName(new)
        else:
            self.others = new if self.others is None else self.others.unionByName(new)
        links = new.where("linked").select("a", "b")
        if links.isEmpty():
            return
        if self.reached is not None:
            links = links.unionByName(self.reached.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.reached = components(links)

    def placed(self, rows: DataFrame, node: str = "id", name: str = "component") -> DataFrame:
        """rows with the component of a node (itself, if it has no link)."""
        if self.reached is None:
            return rows.withColumn(name, F.col(node))
        return rows.join(self.reached.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def classes(rows: DataFrame, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, text): the written signatures, and n_shingles, s1, s2, component (the smallest id) of each class of equal sets."""
    key = ["n_shingles", "s1", "s2"]
    signed = written(signatures(rows, k, similarity), "signatures")
    sets = written(signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy(*key).agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "classes", narrow=True)
    buckets = sets.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"), F.lit(True).alias("apart"))
    links = None
    for step in ("bands", "again", "blocks"):
        held = written(_centred(buckets), "buckets", narrow=True)
        if links is None:
            texts = rows.join(held.select("id").distinct().hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
            links = Links(written(texts, "candidate-texts"), k, similarity)
        near = (F.col("size") >= similarity * F.col("hub_size")) & (F.col("hub_size") >= similarity * F.col("size"))
        best = held.where((F.col("id") != F.col("hub")) & near).groupBy("id").agg(F.max(F.struct("hub_weight", (-F.col("hub")).alias("minus"))).alias("best"))
        best = written(best, "first-hubs", narrow=True)
        links.add(best.select((-F.col("best.minus")).alias("a"), F.col("id").alias("b")))
        open_ = written(_several(links.placed(held.select("id", "size", "bucket", "hub", "hub_weight"))), "open-buckets", narrow=True)
        dropped(held)
        if open_.isEmpty():
            break
        met = _met(open_, best, links, step == "blocks")
        large = F.lit(False) if step == "blocks" else F.col("members") * F.col("n_apart") > SMALL * SMALL
        links.add(_possible(met.where(~large), similarity), outside=False)
        if step == "blocks":
            break
        buckets = _several(links.placed(met.where(large).select("id", "size", "bucket", "apart"))).drop("component")
        buckets = written(_in_blocks(buckets) if step == "again" else buckets, "buckets-again", narrow=True)
        if buckets.isEmpty():
            break
    found = links.placed(sets).select(*key, "component")
    return signed, found


def _centred(buckets: DataFrame) -> DataFrame:
    """The rows of buckets of two or more, with n and the hub: of the members apart, that whose buckets are largest in all, as the one most alike the others."""
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = written(buckets.join(counts, "bucket"), "shared-buckets", narrow=True)
    weight = held.groupBy("id").agg(F.sum("n").alias("weight"))
    best = held.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("apart", "weight", (-F.col("id")).alias("minus"), F.col("size").alias("hub_size"))).alias("best"))
    return held.join(best.select("bucket", (-F.col("best.minus")).alias("hub"), "best.hub_size", F.col("best.weight").alias("hub_weight")), "bucket")


def _several(placed: DataFrame) -> DataFrame:
    """The rows of buckets that lie in more than one component."""
    groups = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    return placed.join(groups.select("bucket"), "bucket")


def _met(open_: DataFrame, best: DataFrame, links: Links, blocks: bool) -> DataFrame:
    """bucket, id, size, both, out, component, apart, members, n_apart: where classes of open buckets meet that may be similar.

    All members of a bucket are compared with one hub, ref. both: what a class has in common with it; out: how many of its other
    shingles another class with this hub has, too; apart: it isn't connected with the hub. Two of a bucket are similar only
    if min(both) + min(out) is enough for their sizes, where only shingles that both have count for out. If min(both) alone
    is, they meet in their bucket (out is 0 there). Else they share one of those outside the hub at least, and if either
    needs more, one of the rarest of either: they meet in such a shingle. In blocks, all of a bucket meet there.
    """
    s = links.similarity
    ref = open_.join(best, "id", "left").groupBy("bucket").agg(F.coalesce(F.max("best"), F.max(F.struct("hub_weight", (-F.col("hub")).alias("minus")))).alias("best"))
    placed = written(open_.select("id", "size", "bucket").join(ref.select("bucket", (-F.col("best.minus")).alias("ref")), "bucket").where("id <> ref"), "referred", narrow=True)
    links.add(placed.select(F.col("ref").alias("a"), F.col("id").alias("b")))
    now = links.placed(links.placed(placed), "ref", "ref_component")
    # the hub is a member, too: a bucket is done if all are connected with it
    groups = now.groupBy("bucket").agg(F.count_if(F.col("component") != F.col("ref_component")).alias("n")).where("n > 0").select("bucket")
    now = written(now.join(groups, "bucket").withColumn("apart", F.col("component") != F.col("ref_component")), "referred-open", narrow=True)
    member = now.select("ref", "id", "size", "component", "apart").distinct()
    known = links.known.select(F.col("a").alias("ref"), F.col("b").alias("id"), "both", "outside")
    member = written(member.join(known, ["ref", "id"]), "members")
    rest = member.select("ref", "id", F.explode("outside").alias("shingle"))
    # written, so that the join gets it by a shuffle of its own and can part common shingles
    counts = written(rest.groupBy("ref", "shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingle-counts", narrow=True)
    shared = rest.join(counts.hint("merge"), ["ref", "shingle"]).groupBy("ref", "id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("found"))
    member = written(member.drop("outside").join(shared, ["ref", "id"], "left").withColumn("out", F.coalesce(F.size("found"), F.lit(0)).cast("long")), "bounded", narrow=True)
    columns = ["id", "size", "both", "out", "component", "apart"]
    in_bucket = now.select("bucket", "ref", "id").join(member.drop("found"), ["ref", "id"])
    if blocks:
        met = in_bucket.select("bucket", *columns)
    else:
        need = F.greatest(F.ceil(s * F.col("size") - F.col("both") - 1e-6), F.lit(1))
        first = F.slice("found", F.lit(1), (F.col("out") - need + 1).cast("int"))
        by_shingle = member.where(F.col("out") >= need).select("ref", *columns, F.explode(first).alias("f")).select(F.xxhash64("ref", "f.shingle").alias("bucket"), *columns)
        enough = in_bucket.where(F.col("both") >= s * F.col("size") - 1e-6)
        least = enough.groupBy("bucket").agg(F.min("size").alias("least"))
        able = ~F.col("apart") | (F.col("both") >= s / (1 + s) * (F.col("size") + F.greatest(F.col("least").cast("double"), s * F.col("size"))) - 1e-6)
        met = by_shingle.unionByName(enough.join(least, "bucket").where(able).withColumn("out", F.lit(0).cast("long")).select("bucket", *columns))
    met = written(met, "met", narrow=True)
    groups = met.groupBy("bucket").agg(F.count("*").alias("members"), F.count_if("apart").alias("n_apart")).where("members > 1 AND n_apart > 0")
    return written(met.join(groups, "bucket"), "meetings", narrow=True)


def _possible(met: DataFrame, similarity: float) -> DataFrame:
    """a, b: the pairs that meet with different components, where the bounds allow a link; each has a member apart."""
    x, y = met.where("apart").alias("x"), met.alias("y")
    can = F.expr("x.bucket = y.bucket AND x.component <> y.component AND (NOT y.apart OR x.id < y.id)")
    enough = F.expr("least(x.both, y.both) + least(x.out, y.out)") >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    return x.join(y, can & enough).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _in_blocks(large: DataFrame) -> DataFrame:
    """id, size, bucket, apart: the members of large buckets in three or more parts of about SMALL / 2 each, a bucket for each two parts."""
    counts = large.groupBy("bucket").agg(F.greatest(F.ceil(2 * F.count("*") / SMALL), F.lit(3)).cast("int").alias("parts"))
    dealt = large.join(counts, "bucket").withColumn("part", F.pmod(F.xxhash64("id", "bucket"), "parts").cast("int"))
    dealt = dealt.select("id", "size", "bucket", "apart", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return dealt.where("part <> other").select("id", "size", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), F.lit(True).alias("apart"))


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id is that) of each row of docs.

    Words: A-Z lower-cased, split at ASCII white space. A document's set: its distinct k-word shingles; with fewer words, one
    of them all. Documents without words or text, and rows with a null id, are linked with nothing and kept. Rows of one id
    should have one text; repeated rows are one component and all kept.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed, found = classes(rows, k, similarity)
    key = ["n_shingles", "s1", "s2"]
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    signed = signed.drop("bands")
    alone = signed.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long"))
    return signed.where("n_shingles > 0").join(found, key, "left").unionByName(alone).select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: that with the smallest id. All columns stay."""
    gone = near_duplicates(docs, k, similarity, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
