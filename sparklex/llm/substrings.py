"""Substring dedup: words in windows of 50 words that an earlier document has too are removed, found by super-k-mers.

The minimiser of a window is the least hash of its runs of ten words. Consecutive windows of a document that share a
minimiser form a super-k-mer: one packed string of words, which goes to the minimiser's bucket. Equal windows have equal
minimisers, so a bucket sees all copies of its windows; there, sorting (by ranks of exact words, doubled up to the window's
length) finds which are equal and which document with the smallest id has each.

What keeps traffic small: a minimiser that only one document has sends no string at all; equal strings are merged, with
their smallest id, before they reach the bucket; windows of minimisers with very many different strings go singly, by
their digests, so that they are merged in the tasks and no bucket grows with the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklex.llm.bytewords import CHUNK, chunks, covered, window_starts, windows, words
from sparklex.llm.scratch import dropped, written

WINDOW, RUN = 50, 10
#: Different strings of a minimiser that its bucket takes; windows of larger ones go singly.
BUCKET = 2048
#: Stands for a null id: such a document is later than all others, and earlier than none.
NO_ID = (1 << 63) - 1


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each size consecutive elements."""
    out, have = h, 1
    while 2 * have <= size:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = size - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest and len(out) > rest else out[: max(0, len(out) - rest)]


def _keys(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id, and the text's hash for ids that occur twice."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text")]


def super_kmers(rows: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """minimiser, id, version, start (of the first window, in words), n (windows) of each super-k-mer of rows (id, version, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            w = words(c)
            ok = window_starts(w.first, window)
            if not ok.any():
                continue
            least = np.zeros(len(ok), np.uint64)
            found = sliding_min(windows(w.hash, run), window - run + 1)
            least[: len(found)] = found
            begin = ok.copy()
            begin[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
            end = ok.copy()
            end[:-1] &= ~ok[1:] | begin[1:]
            at, to = np.flatnonzero(begin), np.flatnonzero(end) + 1
            text = np.searchsorted(w.first, at, "right") - 1
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(least[at].view(np.int64)), c.rows.column("id").take(take), c.rows.column("version").take(take), pa.array((at - w.first[text]).astype(np.int32)), pa.array((to - at).astype(np.int32))],
                ["minimiser", "id", "version", "start", "n"],
            )

    return rows.mapInArrow(each, "minimiser long, id long, version long, start int, n int")


def _strings(rows: DataFrame, window: int) -> DataFrame:
    """A packed string for each super-k-mer of rows (id, version, text, kmers)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            raw, out = c.data.tobytes(), []
            for a, b, number, version, kmers in zip(c.at[:-1], c.at[1:], *(c.rows.column(k).to_pylist() for k in ("id", "version", "kmers")), strict=True):
                ws = raw[a:b].split()
                out += [(k["minimiser"], number, version, k["start"], b" ".join(ws[k["start"] : k["start"] + k["n"] + window - 1])) for k in kmers]
            for i in range(0, len(out), 5000):
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 5000], strict=True), types, strict=True)], ["minimiser", "id", "version", "start", "packed"])

    return rows.mapInArrow(each, "minimiser long, id long, version long, start int, packed binary")


def first_owners(packed: list[bytes], ids: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each string the smallest id that has each of its windows, over all strings."""
    number: dict[bytes, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in p.split(b" ")] for p in packed]
    size = np.array([len(t) for t in texts])
    rank = np.fromiter((x for t in texts for x in t), np.int64, int(size.sum()))
    have = 1
    while have < window:  # ranks of runs of so many words, from those of half the length
        step = min(have, window - have)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        have += step
    first = np.concatenate(([0], np.cumsum(size)))
    ok = np.flatnonzero(window_starts(first, window))
    mine = rank[ok]
    least = np.full(int(rank.max(initial=0)) + 1, NO_ID, np.int64)
    np.minimum.at(least, mine, np.repeat(ids, size - window + 1))
    return np.split(least[mine], np.cumsum(size - window + 1)[:-1])


def _sorted_buckets(strings: DataFrame, window: int) -> DataFrame:
    """minimiser, key, first window, owners of each string; whole buckets are sorted together, some megabytes at a time."""
    schema = "minimiser long, key binary, skip int, owners array<long>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            owners = first_owners([x[2] for x in held], np.array([x[3] for x in held], np.int64), window)
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary()), pa.array([0] * len(held), pa.int32()), pa.array(owners, pa.list_(pa.int64()))], ["minimiser", "key", "skip", "owners"])
            held.clear()
            return out

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("minimiser", "key", "packed", "id")), strict=True):
                if row[0] != last and size > CHUNK:
                    yield flush()
                    size = 0
                last = row[0]
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()

    return strings.repartition("minimiser").sortWithinPartitions("minimiser", "key").mapInArrow(each, schema)


def _single_windows(strings: DataFrame, window: int) -> DataFrame:
    """The same rows for strings whose minimiser has very many: a row a window, merged by digest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 1000):
                part, digests, size = b.slice(i, 1000), [], []
                for packed in part.column("packed").to_pylist():
                    ws = packed.split(b" ")
                    digests += [hashlib.md5(b" ".join(ws[j : j + window])).digest() for j in range(len(ws) - window + 1)]
                    size.append(len(ws) - window + 1)
                n = np.array(size)
                take = pa.array(np.repeat(np.arange(len(n)), n))
                skip = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([part.column("minimiser").take(take), part.column("key").take(take), pa.array(skip.astype(np.int32)), pa.array(digests, pa.binary()), part.column("id").take(take)], ["minimiser", "key", "skip", "digest", "id"])

    single = written(strings.mapInArrow(each, "minimiser long, key binary, skip int, digest binary, id long"), "single-windows")
    owner = single.groupBy("digest").agg(F.min("id").alias("owner"))
    return single.join(owner, "digest").select("minimiser", "key", "skip", F.array("owner").alias("owners"))


def _spans(matched: DataFrame, window: int) -> DataFrame:
    """id, version, begin, end: stretches of words in windows that a smaller id has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners = b.column("owners")
            first = owners.offsets.to_numpy()
            of = np.repeat(np.arange(len(b)), np.diff(first))
            number = b.column("id").to_numpy()
            copied = owners.values.to_numpy()[first[0] : first[-1]] < number[of]
            edge = copied.copy()
            edge[1:] &= ~copied[:-1] | (of[1:] != of[:-1])
            last = copied.copy()
            last[:-1] &= ~copied[1:] | (of[1:] != of[:-1])
            i, j = np.flatnonzero(edge), np.flatnonzero(last)
            at = (b.column("start").to_numpy() + b.column("skip").to_numpy()).astype(np.int64) - (first[:-1] - first[0])
            row = of[i]
            yield pa.RecordBatch.from_arrays([pa.array(number[row]), b.column("version").take(pa.array(row)), pa.array((at[row] + i).astype(np.int32)), pa.array((at[row] + j + window).astype(np.int32))], ["id", "version", "begin", "end"])

    return matched.mapInArrow(each, "id long, version long, begin int, end int")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """id, version, spans: for each document with any, the stretches [begin, end) of words to remove (may overlap)."""
    rows = docs.select(*_keys(id_col, text_col))
    kmers = written(super_kmers(rows, window, run), "super-kmers")
    shared = kmers.groupBy("minimiser").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("minimiser")
    wanted = kmers.join(shared, "minimiser", "left_semi").groupBy("id", "version").agg(F.collect_set(F.struct("minimiser", "start", "n")).alias("kmers"))
    strings = _strings(rows.join(wanted, ["id", "version"]), window)
    placed = written(strings.withColumn("key", F.unhex(F.md5("packed"))), "placed-strings")
    dropped(kmers)
    distinct = written(placed.groupBy("minimiser", "key", "packed").agg(F.min("id").alias("id")), "distinct-strings")
    hot = distinct.groupBy("minimiser").count().where(F.col("count") > BUCKET).select("minimiser")
    owners = _sorted_buckets(distinct.join(hot, "minimiser", "left_anti"), window).unionByName(_single_windows(distinct.join(hot, "minimiser", "left_semi"), window))
    matched = placed.select("id", "version", "start", "minimiser", "key").join(owners, ["minimiser", "key"]).select("id", "version", "start", "skip", "owners")
    return _spans(matched, window).groupBy("id", "version").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, kept_sha256 of each row of docs.

    Removed is each word in a window of so many words of its document (words split at ASCII white space) that also begins
    in a document with a smaller id; windows are judged on the input. Null and empty texts have no words (their kept text
    is empty), shorter ones no window. Rows with one id (repeated rows, too) don't count as copies of each other; a null id is larger than all.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_keys(id_col, text_col))
    found = rows.join(duplicates(docs, id_col, text_col, window), ["id", "version"], "left").select("doc_id", "text", "spans")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            raw, kept, counts, gone = c.data.tobytes(), [], [], []
            for a, b, spans in zip(c.at[:-1], c.at[1:], c.rows.column("spans").to_pylist(), strict=True):
                ws = raw[a:b].split()
                counts.append(len(ws))
                if spans:
                    begin, end = (np.array([s[k] for s in spans]) for k in ("begin", "end"))
                    out = covered(begin, end - begin, len(ws))
                    gone.append(int(out.sum()))
                    ws = [w for w, g in zip(ws, out.tolist(), strict=True) if not g]
                else:
                    gone.append(0)
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays(
                [c.rows.column("doc_id"), pa.array([k.decode() for k in kept], pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["doc_id", "text", "n_words", "n_removed", "kept_sha256"],
            )

    return found.mapInArrow(each, "doc_id long, text string, n_words long, n_removed long, kept_sha256 string")
