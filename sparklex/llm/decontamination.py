"""Benchmark decontamination: which words of documents lie in a window of words that a benchmark item has too.

Words are runs of ASCII letters and digits and of characters beyond ASCII, after A-Z are lower-cased. A window is ten
consecutive words of an item; an item of fewer words (but not none) is one window. Each task indexes its documents in
shards of some megabytes with an FM-index and searches the items' windows in it backwards. Words that no window has, or
has beside other neighbours, can be in no occurrence; the index gets one separator for a run of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.bytewords import ALPHANUMERIC, Chunk, chunks, covered, words
from sparklex.llm.fmindex import FMIndex

WINDOW = 10
#: Bytes of benchmark texts whose windows are searched at a time; the searches of larger benchmarks are merged by chunk.
BLOCK_BYTES = 8 << 20
#: Bytes of all benchmark texts that tasks get; a larger benchmark is refused, to be taken in parts.
LIMIT_BYTES = 64 << 20
#: Words and documents of a shard, about.
SHARD_WORDS = 200_000


@dataclass
class Phrases:
    """The distinct windows of a block of benchmark items."""

    vocabulary: np.ndarray  # sorted word hashes; number 1 is the first
    phrases: np.ndarray  # a row for each window, right-aligned word numbers
    length: np.ndarray
    pairs: np.ndarray  # sorted: number * (words + 1) + next number
    single: np.ndarray  # numbers of words that are a window alone
    item_first: np.ndarray  # items of window i: items[item_first[i]:item_first[i + 1]]
    items: np.ndarray  # indexes into names
    names: list[str | None]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def phrases_of(ids: list[str | None], texts: list[str | None], window: int = WINDOW) -> Phrases:
    found: dict[tuple[int, ...], set[int]] = {}
    every: set[int] = set()
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    i = 0
    for c in chunks(iter([batch])):
        w = words(c, ALPHANUMERIC, lower=True)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            h = w.hash[a:b].tolist()
            every.update(h)
            for k in range(max(1, len(h) - window + 1)) if h else ():
                found.setdefault(tuple(h[k : k + window]), set()).add(i)
            i += 1
    vocabulary = np.array(sorted(every), np.uint64)
    number = {h: k + 1 for k, h in enumerate(vocabulary.tolist())}
    rows = [[number[h] for h in k] for k in found]
    table = np.zeros((len(rows), window), np.int64)
    for k, r in enumerate(rows):
        table[k, window - len(r) :] = r
    pairs = np.unique(np.array([a * (len(vocabulary) + 1) + b for r in rows for a, b in zip(r, r[1:], strict=False)], np.int64))
    owners = [sorted(x) for x in found.values()]
    first = np.concatenate(([0], np.cumsum([len(x) for x in owners]))).astype(np.int64)
    return Phrases(vocabulary, table, np.array([len(r) for r in rows], np.int64), pairs, np.array([r[0] for r in rows if len(r) == 1], np.int64), first, np.array([k for x in owners for k in x], np.int64), ids)


@dataclass
class Found:
    """What a chunk has: for each text its number of words, whether each word is hit, and the items' names."""

    chunk: Chunk
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hit: np.ndarray
    items: dict[int, list[str]]


def found(parts: Iterator[Chunk], p: Phrases) -> Iterator[Found]:
    shard: list[tuple[Chunk, object, np.ndarray]] = []
    size = 0
    for c in parts:
        w = words(c, ALPHANUMERIC, lower=True)
        shard.append((c, w, p.numbers(w.hash)))
        size += len(w.hash) + len(c)
        if size >= SHARD_WORDS:
            yield from _search(shard, p)
            shard, size = [], 0
    if shard:
        yield from _search(shard, p)


def merged(parts: Iterator[Chunk], every: list[Phrases]) -> Iterator[Found]:
    """What any block of the benchmark finds in each chunk."""
    if len(every) == 1:
        yield from found(parts, every[0])
        return
    for c in parts:
        first, *more = [next(found(iter([c]), p)) for p in every]
        for f in more:
            first.hit = first.hit | f.hit
            for t, names in f.items.items():
                first.items[t] = sorted({*first.items.get(t, []), *names})
        yield first


def _search(shard: list, p: Phrases) -> Iterator[Found]:
    number = np.concatenate([x[2] for x in shard])
    first = np.cumsum([0] + [len(x[2]) for x in shard])
    text_at = np.concatenate([x[1].first[:-1] + f for x, f in zip(shard, first, strict=False)])
    n = len(number)
    hit = np.zeros(n, bool)
    owned: dict[int, list[str]] = {}
    if n and len(p.phrases):
        linked = np.zeros(n, bool)  # to the next word, as in some window
        key = number[:-1] * (len(p.vocabulary) + 1) + number[1:]
        if len(p.pairs):
            linked[:-1] = p.pairs[np.minimum(np.searchsorted(p.pairs, key), len(p.pairs) - 1)] == key
        linked[:-1] &= (number[:-1] > 0) & (number[1:] > 0)
        linked[text_at[(text_at > 0) & (text_at < n)] - 1] = False
        linked[n - 1] = False
        ends = np.flatnonzero(~linked)
        begins = np.concatenate(([0], ends[:-1] + 1))
        long = ends - begins + 1 >= p.length.min()
        if len(p.single):
            long &= (ends > begins) | np.isin(number[begins], p.single)
        else:
            long &= ends > begins
        begins, ends = begins[long], ends[long]
        if len(begins):
            runs = ends - begins + 1
            place = np.cumsum(runs + 1) - runs - 1
            text = np.zeros(int(runs.sum()) + len(runs), np.int64)
            source = np.zeros(len(text), np.int64)
            to = np.repeat(place, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            at = np.repeat(begins, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            text[to], source[to] = number[at], at
            index = FMIndex(text, len(p.vocabulary) + 1)
            lo, hi = index.search(p.phrases, p.length)
            count = np.maximum(hi - lo, 0)
            which = np.repeat(np.arange(len(count)), count)
            rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            where = source[index.locate(rows)]
            hit = covered(where, p.length[which], n)
            of_text = np.searchsorted(text_at, where, "right") - 1
            for t, k in np.unique(np.stack((of_text, which), 1), axis=0).tolist():
                owned.setdefault(t, []).append(k)
    done = 0
    for (c, w, _), f in zip(shard, first, strict=False):
        items = {}
        for t in range(done, done + len(c)):
            if t in owned:
                every = {p.names[i] for k in owned[t] for i in p.items[p.item_first[k] : p.item_first[k + 1]].tolist()}
                items[t - done] = sorted(x for x in every if x is not None)
        yield Found(c, w.first, w.start, w.end, hit[f : f + len(w.hash)], items)
        done += len(c)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[Phrases]:
    """The benchmark's windows, in blocks of bounded size: the query set that all documents are searched for."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > LIMIT_BYTES:
        raise ValueError(f"a benchmark of {total} bytes; take it in parts of {LIMIT_BYTES}")
    n = max(1, ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    parts = (items.where(block == k).toPandas() for k in range(n))
    return [phrases_of([x if isinstance(x, str) else None for x in f["id"]], [x if isinstance(x, str) else None for x in f["text"]], window) for f in parts]


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: doc_id, n_words, n_hit, items (of whose windows one occurs, sorted as strings), spans, contaminated.

    spans are the merged stretches of hit words, as [begin, end) in bytes of the UTF-8 text. A null text has no words, an
    empty benchmark no windows; items without id hit but aren't listed. Repeated rows are reported once each.
    """
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<array<long>>, contaminated boolean"

    parts = blocks(benchmark)

    def searched(out: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in merged(chunks(batches), parts):
                n_hit, spans = [], []
                for a, b, base in zip(f.first[:-1], f.first[1:], f.chunk.at.tolist(), strict=False):
                    hit = f.hit[a:b]
                    n_hit.append(int(hit.sum()))
                    begin, end = _runs(hit) if n_hit[-1] else ((), ())
                    spans.append([[int(f.start[a + i]) - base, int(f.end[a + j - 1]) - base] for i, j in zip(begin, end, strict=True)])
                items = [f.items.get(t, []) for t in range(len(f.chunk))]
                yield pa.RecordBatch.from_arrays(
                    [f.chunk.rows.column("doc_id"), pa.array(np.diff(f.first)), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([x > 0 for x in n_hit])],
                    ["doc_id", "n_words", "n_hit", "items", "spans", "contaminated"],
                )

        return out.mapInArrow(run, schema)

    return searched(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the words that occur in benchmark windows; all rows and columns stay, null texts too."""
    parts = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in merged(chunks(batches, text_col), parts):
            rows = f.chunk.rows
            if f.hit.any():
                at = rows.schema.get_field_index(text_col)
                texts = rows.column(at).to_pylist()
                of_text = np.searchsorted(f.first, np.flatnonzero(f.hit), "right") - 1
                for t in np.unique(of_text).tolist():
                    a, b = f.first[t], f.first[t + 1]
                    raw, base, kept, last = texts[t].encode(), int(f.chunk.at[t]), [], 0
                    for i, j in zip(*_runs(f.hit[a:b]), strict=True):
                        kept.append(raw[last : f.start[a + i] - base])
                        last = f.end[a + j - 1] - base
                    texts[t] = b"".join([*kept, raw[last:]]).decode()
                rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
            yield rows

    return docs.mapInArrow(run, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
