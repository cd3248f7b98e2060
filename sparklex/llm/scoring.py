"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside a unigram base.

P(word | history) = P(class | history) * P(word | class, history). Classes are groups of frequent words that follow alike
words, of about equal size; all other words are one more class. Both factors are softmaxes with weights for hashed features:
the word before, the word before that (a skip feature) and the pair of both; in the second factor the class is hashed with
them. In the class of all other words, each has its smoothed share of their count, whatever the history. Each task goes over its
part of the training documents in sparse batches of gradient updates (AdaGrad by row) from common weights; the tasks' weights are
averaged, each row of them by how often the task used it, and the next pass starts from there. The number of hashed rows grows with
the distinct words, up to a bound that is a worker's memory.

Texts are parted into words once; their tokens are written as a table. Counts of all training words are kept as a table. Words
with the highest counts, as many as a bound allows, are sent to the tasks; the others meet their counts in a join, so that every word's count is exact whatever the vocabulary's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.bytewords import Chunk, chunks, mix, random64, words
from sparklex.llm.scratch import dropped, written

#: Most words whose counts tasks get; words with classes; classes (the first is of all other words); words before them that they are classed by.
FREQUENT, CLASSED, CLASSES, CONTEXTS = 1 << 18, 4032, 64, 128
#: Least and greatest number of bits of hashed rows; distinct words for each row.
LEAST_BITS, MOST_BITS, WORDS_A_ROW = 13, 17, 128
#: Kinds of features, tokens of a batch, step size (a pass's share), passes, blocks that weights travel in, input partitions of a training task.
KINDS, BATCH, STEP, PASSES, BLOCKS, PARTS = 3, 1 << 12, 0.5, 2, 64, 8
#: Tokens taken from a table of tokens at once; bytes of its row groups, so small that the tasks of a training pass get about equal parts.
PIECE, GROUP = 20 * BATCH, 1 << 22
#: Added to each count, also that of one word for all that weren't seen.
ADDED = 0.1
END, BEGIN = random64(2, 11)


@dataclass
class Counts:
    """What the tasks know of the training tokens."""

    hashes: np.ndarray  # of frequent words, sorted
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V


@dataclass
class Model:
    counts: Counts
    words: np.ndarray  # sorted hashes of classed words
    class_of: np.ndarray  # of each, from 1; 0 is the class of all others
    place: np.ndarray  # of each in its class
    log_rest: float  # log10 of the others' total, with what is added
    bits: int
    bias: np.ndarray  # of classes
    inner_bias: np.ndarray  # a row for each class: of its words
    weights: np.ndarray
    inner: np.ndarray

    def classes(self, at: np.ndarray) -> np.ndarray:
        """Of words by their place among the classed ones, -1 for others."""
        return np.where(at >= 0, self.class_of[at] if len(self.class_of) else 0, 0)


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts of a chunk, each text ending with END, and where each begins."""
    w = words(c, lower=True)
    n = w.per_text() + 1
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.full(int(first[-1]), END, np.uint64)
    out[np.arange(len(w.hash)) + w.text_of()] = w.hash
    return out, first


def tokenised(docs: DataFrame) -> DataFrame:
    """docs with the tokens of each text, 8 bytes each, in place of the text: all later passes read these."""
    names = [n for n in docs.columns if n != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches):
            t, first = tokens(c)
            blobs = pa.Array.from_buffers(pa.large_binary(), len(c), [None, pa.py_buffer(8 * first.astype(np.int64)), pa.py_buffer(t)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.rows.column(n) for n in names), blobs], [*names, "tokens"])

    fields = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.mapInArrow(run, f"{fields}, tokens binary")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows at a time, their tokens and where each row's begin; of batches with texts, or as tokenised() gives them."""
    for batch in batches:
        if "tokens" not in batch.schema.names:
            yield from ((c.rows, *tokens(c)) for c in chunks(iter([batch])))
            continue
        column = batch.column("tokens").cast(pa.large_binary())
        _, offsets, values = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 8
        i = 0
        while i < len(column):
            j = min(len(column), max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1))
            yield batch.slice(i, j - i), np.frombuffer(values, np.uint64, int(ends[j] - ends[i]), 8 * int(ends[i])), ends[i : j + 1] - ends[i]
            i = j


def before(t: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The token k places before each one; BEGIN before a text's first."""
    out = np.full(len(t), BEGIN, np.uint64)
    out[k:] = t[:-k] if k < len(t) else t[:0]
    for j in range(k):
        at = first[:-1] + j
        out[at[at < first[1:]]] = BEGIN
    return out


def find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash is in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


class Lookup:
    """find() in one table, again and again: hashes are spread evenly, so that their first bits tell the place but for a few steps."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.table, self.n = np.append(table, np.uint64(2**64 - 1)), len(table)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.start[h >> self.shift]
        here = self.table[at]
        low = np.flatnonzero(here < h)
        while len(low):
            at[low] += 1
            here[low] = self.table[at[low]]
            low = low[here[low] < h[low]]
        return np.where((here == h) & (at < self.n), at, -1)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number = F.col(id_col).cast("long")
    return docs.select(number.alias("doc_id"), (F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % 10 == 0).alias("held_out"), F.col(text_col).alias("text"))


def count_words(train: DataFrame) -> DataFrame:
    """word (hash), n of all training tokens; tasks sum theirs up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            order = np.argsort(h)
            h, n = h[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return h[at], np.add.reduceat(n, at)

        def out() -> pa.RecordBatch:
            h, n = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

        size = 0
        for _, t, _ in pieces(batches):
            held.append(np.unique(t, return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 20:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1 << 19:
                    yield out()
                    size = 0
        if held:
            yield out()

    return train.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = FREQUENT) -> Counts:
    """The words of the highest counts, no more than most: those above the least power of 2**(1/8) that so few words reach."""
    level = F.floor(8 * F.log2("n")).alias("level")
    steps = counts.groupBy(level).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).orderBy(F.desc("level")).toPandas()
    fits = steps["words"].cumsum() <= most
    least = int(steps["level"][fits].min()) if fits.any() else 1 << 30
    table = counts.where(level >= least).select("word", "n").toArrow()
    h = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Counts(h[order], table.column("n").to_numpy()[order], int(steps["tokens"].sum()), int(steps["words"].sum()))


def classed(train: DataFrame, counts: Counts, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent words and their classes, by which of some words they follow how often."""
    best = np.sort(np.argsort(-counts.counts, kind="stable")[:CLASSED])
    own = counts.hashes[best]
    leads = counts.hashes[np.sort(np.argsort(-counts.counts, kind="stable")[:CONTEXTS])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(own) * len(leads), np.int64)
        in_own, in_leads = Lookup(own), Lookup(leads)
        for _, t, first in pieces(batches):
            lead = in_leads(before(t, first, 1))
            some = lead >= 0
            w = in_own(t[some])
            cell = (w * len(leads) + lead[some])[w >= 0]
            total += np.bincount(cell, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    found = train.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSED * CONTEXTS
    seen = np.full(len(own) * len(leads), 0.02)
    seen[found.column("cell").to_numpy()] += found.column("n").to_numpy()
    seen = seen.reshape(len(own), len(leads))
    seen = np.sqrt(seen / seen.sum(1, keepdims=True)) if seen.size else seen
    return own, 1 + _grouped(seen, counts.counts[best], CLASSES - 1, seed)


def _grouped(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means into groups of no more than their mean size; the first centres are the heaviest rows."""
    if len(x) <= k:
        return np.arange(len(x))
    rng = np.random.default_rng(seed)
    root = np.sqrt(weight.astype(float))
    order = np.argsort(-weight, kind="stable")
    centre = x[order[:k]].copy()
    for _ in range(12):
        near = x @ centre.T - (centre**2).sum(1) / 2
        group = np.argmax(near, 1)
        for j in range(k):
            mine = group == j
            centre[j] = np.average(x[mine], axis=0, weights=root[mine]) if mine.any() else x[rng.integers(len(x))]
    near = x @ centre.T - (centre**2).sum(1) / 2
    room = np.full(k, -(-len(x) // k))
    for i in order.tolist():  # heavy words choose first
        j = int(np.argmax(np.where(room > 0, near[i], -np.inf)))
        group[i] = j
        room[j] -= 1
    return group


def features(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the tokens' features, a row for each kind."""
    one, two = before(t, first, 1), before(t, first, 2)
    out = np.empty((KINDS, len(t)), np.uint64)
    for k, x in enumerate((one ^ np.uint64(1), two ^ np.uint64(2), mix(two ^ np.uint64(3)) + one)):
        out[k] = mix(x)
    return out


def outer_rows(h: np.ndarray, bits: int) -> np.ndarray:
    """The rows of the classes' weights."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def inner_rows(h: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    """The rows of the words' weights, for these classes."""
    return (mix(h + classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def raised(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, logits: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Writes logits and their exponentials; returns the sums of these. bias: one for all, or a row for each."""
    weights.take(rows[0], axis=0, out=logits, mode="clip")  # rows are there; other modes would copy once more
    logits += bias
    for row in rows[1:]:
        logits += weights.take(row, axis=0, out=e, mode="clip")
    ones = np.ones(logits.shape[1], np.float32)
    with np.errstate(over="ignore"):
        total = np.exp(logits, out=e) @ ones
    if not (total.min() > 1e-30 and total.max() < 1e30):  # too small or large to be taken as they are
        logits -= logits.max(1, keepdims=True)
        total = np.exp(logits, out=e) @ ones
    return total


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Of each column of rows, a token's, its gold class or word."""
    logits, e = np.empty((2, len(gold), weights.shape[1]), np.float32)
    total = raised(weights, bias, rows, logits, e)
    return logits[np.arange(len(gold)), gold] - np.log(total)


def few_sums(x: np.ndarray, of: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For groups of 1 to 8 places of the list `of`, by falling size, the sums of these rows of x."""
    out = x.take(of[first], axis=0)
    for j in range(1, int(size[0])):
        k = np.count_nonzero(size > j)
        out[:k] += x.take(of[first[:k] + j], axis=0)
    return out


def group_sums(x: np.ndarray, of: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some of the groups, and of each of them the sum of the rows of x at its places of the list `of`."""
    falling = np.argsort((9 - np.minimum(size, 9)).astype(np.uint8), kind="stable")
    large = np.count_nonzero(size > 8)
    many, some = falling[:large], falling[large:]
    if len(some):
        yield some, few_sums(x, of, first[some], size[some])
    if large:  # eight places at a time, then these
        parts = -(-size[many] // 8)
        end = np.cumsum(parts)
        at = np.repeat(first[many], parts) + 8 * (np.arange(end[-1]) - np.repeat(end - parts, parts))
        left = np.minimum(np.repeat(first[many] + size[many], parts) - at, 8)
        order = np.argsort((8 - left).astype(np.uint8), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        yield many, np.add.reduceat(few_sums(x, of, at[order], left[order]).take(back, axis=0), end - parts, axis=0)


class Trainer:
    """Weights of one softmax in a task, and how often each row was used; AdaGrad with one step size a row."""

    def __init__(self, weights: np.ndarray, step: float):
        self.w, self.step = weights.copy(), step
        self.used = np.zeros(len(weights), np.float32)
        self.squares = np.full(len(weights), 1e-2, np.float32)
        self.whole = self.w.view(np.dtype((np.void, self.w.itemsize * self.w.shape[1]))).ravel()  # rows as single values: put faster
        self.logits, self.g = np.empty((2, BATCH, self.w.shape[1]), np.float32)

    def learn(self, bias: np.ndarray, rows: np.ndarray, gold: np.ndarray) -> None:
        n, width = len(gold), self.w.shape[1]
        g = self.g[:n]
        g *= (1 / raised(self.w, bias, rows, self.logits[:n], g))[:, None]
        g.reshape(-1)[np.arange(n) * width + gold] -= 1
        key = np.sort(((rows << 20) + np.arange(n)).ravel())
        of, token = key >> 20, key & (1 << 20) - 1
        edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        size = np.diff(np.append(edge, len(of)))
        for groups, sums in group_sums(g, token, edge, size):
            row, times = of[edge[groups]], size[groups].astype(np.float32)
            squares = self.squares[row] + np.vecdot(sums, sums) / (times * width)
            self.squares[row] = squares
            sums *= (self.step / np.sqrt(times * squares))[:, None]
            new = self.w.take(row, axis=0)
            new -= sums
            self.whole[row] = new.view(self.whole.dtype).ravel()
            self.used[row] += times

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        each = len(self.w) // BLOCKS
        for b in range(BLOCKS):
            part = slice(b * each, (b + 1) * each)
            if self.used[part].any():
                yield b, np.concatenate((self.w[part] * self.used[part, None], self.used[part, None]), 1).astype("<f4").tobytes()


def trained(train: DataFrame, m: Model, passes: int = PASSES) -> None:
    """Sets the model's weights, after so many passes of the tasks over the training documents, averaged after each.

    What a task sends and the driver gets is as large as the weights, so tasks take PARTS partitions of input each.
    """
    spark = train.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, train.rdd.getNumPartitions() // PARTS)

    def one_pass(step: float) -> DataFrame:
        start = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = start.value
            outer, inner = Trainer(model.weights, step), Trainer(model.inner, step)
            classed = Lookup(model.words)
            for _, t, first in pieces(batches):
                at = classed(t)
                gold = model.classes(at)
                h = features(t, first)
                for i in range(0, len(t), BATCH):
                    outer.learn(model.bias, outer_rows(h[:, i : i + BATCH], model.bits), gold[i : i + BATCH])
                some = np.flatnonzero(gold)
                for i in range(0, len(some), BATCH):
                    k = some[i : i + BATCH]
                    inner.learn(model.inner_bias.take(gold[k], axis=0), inner_rows(h[:, k], gold[k], model.bits), model.place[at[k]])
            for which, x in enumerate((outer, inner)):
                for b, blob in x.blocks():
                    yield pa.RecordBatch.from_arrays([pa.array([which * BLOCKS + b], pa.int32()), pa.array([blob], pa.binary())], ["block", "sums"])

        return train.coalesce(tasks).mapInArrow(run, "block int, sums binary")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(blob, "<f4")
                total[block] = total[block] + x if block in total else x.astype(np.float64)
        for block, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], ["block", "sums"])

    for k in range(passes):
        sums = one_pass(STEP / (1 + k)).repartition(BLOCKS, "block").mapInArrow(summed, "block int, sums binary").toArrow()  # 2 * BLOCKS rows
        for block, blob in zip(sums.column("block").to_pylist(), sums.column("sums"), strict=True):
            into = m.inner if block >= BLOCKS else m.weights
            x = np.frombuffer(blob.as_buffer(), "<f4").reshape(-1, into.shape[1] + 1)
            some = x[:, -1] > 0
            rows = np.arange(block % BLOCKS * len(x), (block % BLOCKS + 1) * len(x))[some]
            into[rows] = x[some, :-1] / x[some, -1:]


def fit(train: DataFrame, counts: Counts) -> Model:
    own, class_of = classed(train, counts)
    n = counts.counts[find(counts.hashes, own)] + ADDED if len(own) else np.zeros(0)
    total = np.bincount(class_of, n, CLASSES) if len(own) else np.zeros(CLASSES)
    rest = counts.tokens + ADDED * (counts.distinct + 1) - n.sum()
    total[0] = rest
    bias = np.log(np.maximum(total, ADDED) / np.maximum(total, ADDED).sum()).astype(np.float32)
    order = np.argsort(class_of, kind="stable")
    sizes = np.bincount(class_of, minlength=CLASSES)
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inner_bias = np.full((CLASSES, max(1, int(sizes.max(initial=0)))), -1e4, np.float32)
    inner_bias[class_of, place] = np.log(n / total[class_of])
    bits = min(MOST_BITS, max(LEAST_BITS, int(counts.distinct // WORDS_A_ROW).bit_length()))
    weights, inner = np.zeros((1 << bits, CLASSES), np.float32), np.zeros((1 << bits, inner_bias.shape[1]), np.float32)
    model = Model(counts, own, class_of, place, float(np.log10(rest)), bits, bias, inner_bias, weights, inner)
    trained(train, model)
    return model


def log_probability(m: Model, t: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """log10 of each token's probability; of a word without class, only the part that its class has. at: of classed words, where known."""
    at = find(m.words, t) if at is None else at
    classes = m.classes(at)
    h = features(t, first)
    out = np.empty(len(t))
    for i in range(0, len(t), BATCH):
        part = classes[i : i + BATCH]
        out[i : i + BATCH] = log_softmax(m.weights, m.bias, outer_rows(h[:, i : i + BATCH], m.bits), part)
    some = np.flatnonzero(classes)
    for i in range(0, len(some), BATCH):
        k = some[i : i + BATCH]
        out[k] += log_softmax(m.inner, m.inner_bias.take(classes[k], axis=0), inner_rows(h[:, k], classes[k], m.bits), m.place[at[k]])
    return out / np.log(10)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Learned is from rows whose crc32 of the id as text leaves a remainder by 10 (a null id counts as empty text: held out).
    Tokens: words after A-Z are lower-cased, split at ASCII white space, and one end; a null text has the end only. Words
    are told apart by 64-bit hashes. base_score: sum of log10((c + 0.1) / (N + 0.1 * (V + 1))); score: the model's log10
    probability, by the same smoothing within classes. Without training rows, all words are unseen.
    """
    spark = docs.sparkSession
    rows = written(tokenised(_prepared(docs, id_col, text_col)), "tokens", group=GROUP)
    train = rows.where("NOT held_out").select("tokens")
    table = written(count_words(train), "word-counts")
    counts = frequent(table)
    model = spark.sparkContext.broadcast(fit(train, counts))  # of bounded size: FREQUENT, CLASSED, MOST_BITS
    log_all = float(np.log10(counts.tokens + ADDED * (counts.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        log_count = np.log10(m.counts.counts + ADDED)
        classed, frequent_ones = Lookup(m.words), Lookup(m.counts.hashes)
        for some, t, first in pieces(batches):
            own = classed(t)
            logp = log_probability(m, t, first, own)
            at = frequent_ones(t)
            count = np.where(at >= 0, log_count[at] if len(log_count) else 0, 0)
            logp += np.where(own >= 0, 0, count - m.log_rest)
            text = np.repeat(np.arange(len(some)), np.diff(first))
            rare = np.flatnonzero(at < 0)
            order = np.lexsort((t[rare], text[rare]))
            h, of = t[rare][order], text[rare][order]
            edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(edge, len(h)))
            offsets = np.searchsorted(of[edge], np.arange(len(some) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(h[edge].view(np.int64)), pa.array(times.astype(np.int64))], ["word", "times"]))
            n = np.diff(first)
            known = np.add.reduceat((at >= 0).astype(np.int64), first[:-1])
            base = np.add.reduceat(count, first[:-1]) - n * log_all
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("held_out"), pa.array(n), pa.array(known), pa.array(base), pa.array(np.add.reduceat(logp, first[:-1])), lists], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:bigint,times:bigint>>"
    partly = written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "partly-scored")
    dropped(rows)
    rare = partly.select("row", F.inline("rare")).join(table, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADDED)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return partly.join(rare, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
