"""Quality rules: statistics of whole texts, and decision lists learned from labels by sequential covering.

A rule is a conjunction of thresholds on statistics. Rules are grown by information gain on two thirds of the labelled
rows and pruned on the rest; the rows a rule covers are set aside, and the next rule is learned, until a rule isn't
precise enough. The list is applied as one ordered Spark conditional expression. Rows that no rule covers are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklex.llm.bytewords import Chunk, chunks, covered, window_starts, windows, words

#: Labelled rows that the learner takes at most (those whose ids hash lowest).
LABELLED = 20_000
REPEAT_WINDOW = 8

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOL, _UPPER, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_DIGIT[0x30:0x3A] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_distinct")


def measure(c: Chunk) -> dict[str, np.ndarray]:
    """The counts of each text; see measured()."""
    w = words(c)
    texts = len(c)
    n = w.per_text()

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[at[1:]] - total[at[:-1]]

    letters = (c.data & 0xC0) != 0x80  # first bytes of characters
    total = np.concatenate(([0], np.cumsum(letters)))
    out = {"n_words": n, "word_chars": per_text(total[w.end] - total[w.start], w.first)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT)):
        out[name] = per_text(table[c.data], c.at)
    k = REPEAT_WINDOW
    starts = window_starts(w.first, k)
    h = windows(w.hash, k)
    again = np.zeros(len(w.hash), bool)
    distinct = np.zeros(texts, np.int64)
    for t in np.flatnonzero(n).tolist():
        a, b = w.first[t], w.first[t + 1]
        distinct[t] = len(np.unique(w.hash[a:b]))
        if b - a > k:
            mine = h[a : b - k + 1]
            order = np.argsort(mine)
            same = mine[order][1:] == mine[order][:-1]
            if same.any():
                again[a + order[1:][same]] = again[a + order[:-1][same]] = True
    out["n_repeat_words"] = per_text(covered(np.flatnonzero(again & starts), k, len(again)), w.first)
    out["n_distinct"] = distinct
    raw = c.data.tobytes()
    lines, dup = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    for t, (a, b) in enumerate(zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True)):
        with_word = [x for x in raw[a:b].split(b"\n") if x.strip()]
        lines[t], dup[t] = len(with_word), len(with_word) - len(set(with_word))
    return out | {"n_lines": lines, "n_dup_lines": dup}


def measured(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with one more column, a struct of the COUNTS (longs). A null text counts as empty: all are 0.

    Words are split at ASCII white space. word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines:
    lines with a word that equal an earlier one; n_repeat_words: words in windows of 8 words found twice or more in the text.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name}")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(k, T.LongType()) for k in COUNTS]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, text_col):
            m = measure(c)
            column = pa.StructArray.from_arrays([pa.array(m[k].astype(np.int64)) for k in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*c.rows.columns, column], [*c.rows.schema.names, name])

    return docs.mapInArrow(run, schema)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def statistics(q: Column) -> dict[str, Column]:
    """What rules have thresholds on."""

    def share(a: str, b: str) -> Column:
        return q[a] / F.greatest(q[b], F.lit(1))

    return {
        "words": q["n_words"].cast("double"), "word_length": share("word_chars", "n_words"), "symbols_a_word": share("n_symbols", "n_words"), "repeated_lines": share("n_dup_lines", "n_lines"), "repeated_words": share("n_repeat_words", "n_words"),
        "words_a_line": share("n_words", "n_lines"), "capitals": share("n_upper", "n_letters"), "letters": share("n_letters", "word_chars"), "digits": share("n_digits", "word_chars"), "distinct_words": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Threshold:
    name: str
    above: bool
    value: float

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.value if self.above else x[self.name] <= self.value

    def column(self, stats: dict[str, Column]) -> Column:
        return stats[self.name] > self.value if self.above else stats[self.name] <= self.value


Rule = tuple[Threshold, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.of(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    rule: Rule = ()
    here = np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int((here & bad).sum()), int((here & ~bad).sum())
        if not n or not p:
            break
        best, gain = None, 1e-9
        for name, values in cuts.items():
            order = np.argsort(x[name][here], kind="stable")
            v, b = x[name][here][order], bad[here][order]
            below = np.searchsorted(v, values, "right")
            bads = np.concatenate(([0], np.cumsum(b)))
            for above, pp, all_ in ((False, bads[below], below), (True, p - bads[below], p + n - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / np.maximum(all_, 1)) - np.log2(p / (p + n))), 0.0)
                if len(g) and g.max() > gain:
                    k = int(np.argmax(g))
                    best, gain = Threshold(name, above, float(values[k])), float(g[k])
        if best is None:
            break
        rule += (best,)
        here &= best.of(x)
    return rule


def _centred(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Each threshold moved half way to the nearest bad row, so that it covers the same bad rows and no other good ones."""
    covered_bad = _covers(rule, x, len(bad)) & bad
    if not covered_bad.any():
        return rule
    nearest = {t: (x[t.name][covered_bad].min() if t.above else x[t.name][covered_bad].max()) for t in rule}
    return tuple(Threshold(t.name, t.above, float(t.value + nearest[t]) / 2) for t in rule)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, max_rules: int = 12, max_terms: int = 4, seed: int = 5) -> list[Rule]:
    """Rules for the bad rows, in order. Each covers rows that are bad with at least this precision where it was pruned."""
    rules: list[Rule] = []
    order = np.random.default_rng(seed).permutation(len(bad))
    x, bad = {k: np.nan_to_num(v.astype(float))[order] for k, v in x.items()}, bad[order]
    for_growth = np.arange(len(bad)) % 3 > 0
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 129))) if len(v) else v for k, v in x.items()}
    while len(rules) < max_rules and bad.any():
        part = {k: v[for_growth] for k, v in x.items()}
        rule = _grow(part, bad[for_growth], cuts, max_terms)
        held, truth = {k: v[~for_growth] for k, v in x.items()}, bad[~for_growth]

        def worth(r: Rule, held: dict = held, truth: np.ndarray = truth) -> tuple[float, int, int]:
            c = _covers(r, held, len(truth))
            p, n = int((c & truth).sum()), int((c & ~truth).sum())
            return (p - n) / max(1, p + n), p, n

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        _, p, n = worth(rule)
        if not rule or p < 2 or p < precision * (p + n):
            break
        rule = _centred(rule, x, bad)
        rules.append(rule)
        rest = ~_covers(rule, x, len(bad))
        x, bad, for_growth = {k: v[rest] for k, v in x.items()}, bad[rest], for_growth[rest]
    return rules


def first_rule(rules: list[Rule], stats: dict[str, Column]) -> Column:
    """The number (from 1) of the first rule that covers a row, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        all_ = rule[0].column(stats)
        for t in rule[1:]:
            all_ = all_ & t.column(stats)
        out = F.when(all_, F.lit(k)) if out is None else out.when(all_, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED) -> list[Rule]:
    """Rules from at most so many labelled rows (label 0 is bad, others good, null none). No label or document, no rules."""
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 0).alias("bad"))
    sample = sample.groupBy("id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # of bounded size
    q = F.col("q")
    stats = statistics(q)
    rows = measured(chosen, "q").where(~base_failed(q)).select("id", "bad", *[c.alias(k) for k, c in stats.items()]).toPandas().sort_values("id")
    return learn({k: rows[k].to_numpy(float) for k in stats}, rows["bad"].to_numpy(bool))


def judged(docs: DataFrame, rules: list[Rule], name: str = "quality_counts", text_col: str = "text") -> DataFrame:
    """docs with a struct column: the COUNTS, base_failed, rule (that rejects it, else 0) and kept."""
    out = measured(docs, name, text_col)
    q = F.col(f"`{name}`")
    rule = first_rule(rules, statistics(q))
    return out.withColumn(name, F.struct(*[q[k].alias(k) for k in COUNTS], base_failed(q).alias("base_failed"), rule.alias("rule"), (~base_failed(q) & (rule == 0)).alias("kept")))
