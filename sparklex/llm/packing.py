"""Packing by vector bin packing: a sequence has limits on tokens, segments and loss-bearing tokens at once.

Of the pieces that fit into the open sequence, the one with the largest dot product of its demand and the sequence's
remaining room (both as shares of the limits) is placed. Where none fits, the piece of which most fits is cut to
the room that is left, such as its prompt where no loss-bearing tokens have room (with cut=False the sequence is closed instead). Each task packs its own rows, from a bounded pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklex.llm.bytewords import chunks
from sparklex.llm.wordids import ENCODED_BYTES, word_ids


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


#: Pieces that a task holds back to choose from.
POOL = 2048


@dataclass
class Piece:
    row: int  # number of the document in the task
    start: int
    ids: np.ndarray
    doc_tokens: int
    prompt: int  # the document's tokens before its loss-bearing ones

    def loss(self, n: int | None = None) -> int:
        n = len(self.ids) if n is None else n
        return max(0, self.start + n - max(self.start, self.prompt))

    def halves(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.ids[:n], self.doc_tokens, self.prompt), Piece(self.row, self.start + n, self.ids[n:], self.doc_tokens, self.prompt)

    def largest(self, tokens: int, loss: int) -> int:
        """How many of its first tokens fit."""
        free = max(0, self.prompt - self.start)
        return min(len(self.ids), tokens, free + loss)


class Packer:
    """Places pieces; done() gets each closed sequence, a list of pieces."""

    def __init__(self, limits: Limits, cut: bool, done):
        self.limits, self.cut, self.done = limits, cut, done
        self.pool: list[Piece] = []
        self.open: list[Piece] = []
        self.room = self.full = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.int64)

    def add(self, piece: Piece) -> None:
        while (n := piece.largest(self.limits.tokens, self.limits.loss_tokens)) < len(piece.ids) or n == self.limits.tokens:
            if n < len(piece.ids) and not self.cut:
                raise ValueError("an example is larger than the limits, and cut is False")
            whole, rest = piece.halves(n)
            if n == self.limits.tokens:
                self.done([whole])
            else:  # as many loss-bearing tokens as a sequence takes: others' prompts fill it
                self._hold(whole)
            if not len(rest.ids):
                return
            piece = rest
        self._hold(piece)

    def _hold(self, piece: Piece) -> None:
        self.pool.append(piece)
        if len(self.pool) >= POOL:
            self.place(POOL // 2)

    def place(self, keep: int) -> None:
        """Places pieces until no more than keep are left in the pool."""
        pieces = self.pool
        need = np.array([[len(p.ids), 1, p.loss()] for p in pieces], np.int64).reshape(-1, 3)
        share = need / self.full
        tokens, loss = need[:, 0].copy(), need[:, 2].copy()
        free = np.array([max(0, p.prompt - p.start) for p in pieces], np.int64)
        here = np.ones(len(pieces), bool)
        left = len(pieces)
        while left > keep:
            at = np.flatnonzero(here & (tokens <= self.room[0]) & (loss <= self.room[2])) if self.room[1] else ()
            if len(at):
                k = int(at[np.argmax(share[at] @ (self.room / self.full))])
                self._put(pieces[k])
                here[k] = False
                left -= 1
                continue
            part = np.minimum(np.minimum(tokens, self.room[0]), free + self.room[2]) * here
            k = int(np.argmax(part))
            if self.cut and self.room[1] and part[k]:
                first, pieces[k] = pieces[k].halves(int(part[k]))
                self._put(first)
                tokens[k], loss[k] = len(pieces[k].ids), pieces[k].loss()
                share[k] = np.array([tokens[k], 1, loss[k]]) / self.full
                free[k] = max(0, free[k] - part[k])
            else:
                self._close()
        self.pool = [p for p, h in zip(pieces, here, strict=True) if h]

    def _put(self, p: Piece) -> None:
        self.open.append(p)
        self.room = self.room - (len(p.ids), 1, p.loss())
        if not self.room[0] or not self.room[1]:
            self._close()

    def _close(self) -> None:
        if self.open:
            self.done(self.open)
        self.open, self.room = [], self.full

    def finish(self) -> None:
        """The last sequence isn't full: cut at powers of two, its parts need no padding (with cut=False it stays whole)."""
        self.place(0)
        last, self.open = self.open, []
        while last and self.cut and (total := sum(len(p.ids) for p in last)):
            size, head = 1 << (total.bit_length() - 1), []
            while size:
                p = last.pop(0)
                if len(p.ids) > size:
                    p, rest = p.halves(size)
                    last.insert(0, rest)
                head.append(p)
                size -= len(p.ids)
            self.done(head)
        if last:
            self.done(last)


SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, loss_tokens long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1, cut: bool = True, id_col: str = "doc_id", text_col: str = "text", prompt_words: Column | None = None, prompt_share: float = 0.0) -> DataFrame:
    """A row for each piece: which ids of which document stand where in which sequence.

    prompt_words: how many of a text's first words (split at ASCII white space) bear no loss; where it is not given or null,
    that share of its first ids bears none (rounded down). A null text is empty: one piece with end_id alone. Repeated rows are packed once each; a null id is kept. Ties between pieces go to the one that came first.
    Other columns are left behind. An empty table gives no rows. Sequence ids are the number of the task, times 2**32,
    and a number in the task. Sequences shorter than the limit are padded by the reader, but those at a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = word_ids(tokenizer), []
        sequence = TaskContext.get().partitionId() << 32
        names: dict[int, object] = {}
        waiting: dict[int, int] = {}  # ids of each document not yet placed

        def done(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                blob = p.ids.tobytes()
                made.append((names[p.row], p.start, len(p.ids), blob, zlib.crc32(blob), p.loss(), p.doc_tokens, sequence, offset))
                offset += len(p.ids)
                waiting[p.row] -= len(p.ids)
                if not waiting[p.row]:
                    del names[p.row], waiting[p.row]
            sequence += 1

        def rows() -> pa.RecordBatch:
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 5
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])
            made.clear()
            return out

        packer, row = Packer(limits, cut, done), 0
        for c in chunks(batches, size=ENCODED_BYTES):
            raw = c.data.tobytes()
            texts = [raw[a:b] for a, b in zip(c.at[:-1], c.at[1:], strict=True)]
            prompts = c.rows.column("prompt").to_pylist()
            for name, text, prompt, ids in zip(c.rows.column("doc_id").to_pylist(), texts, prompts, encoder.encode(texts, end_id), strict=True):
                names[row], waiting[row] = name, len(ids)
                free = len(encoder.encode([b" ".join(text.split()[:prompt])], end_id)[0]) - 1 if prompt is not None else int(prompt_share * len(ids))
                packer.add(Piece(row, 0, ids.astype("<u4", copy=False), len(ids), free))
                row += 1
            if made:
                yield rows()
        packer.finish()
        if made:
            yield rows()

    prompt = F.greatest(prompt_words.cast("long"), F.lit(0)) if prompt_words is not None else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), prompt.alias("prompt")).mapInArrow(run, SCHEMA)
