"""Token-ID files: frequency-ranked ids, 1 to 4 bytes each, their lengths in separate control bytes.

A folder holds `ranks` (the id of each rank, most frequent first, little-endian unsigned 32 bits) and files of blocks.
A block: MAGIC, the counts of documents, ids and data bytes (unsigned 64 bits), each document's number and its ids' number
(signed 64 bits), a control byte for each four ids (two bits an id, low bits first: its bytes less one), the data bytes
(an id's rank, low byte first). Documents are in ascending order over files and in them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklex.llm.bytewords import chunks
from sparklex.llm.scratch import by_file, dropped, new_path, written
from sparklex.llm.wordids import ENCODED_BYTES, word_ids

MAGIC = b"RVB1"
#: In the files, the number of a document whose id is null.
NULL_ID = -(1 << 63)
#: Ids in a block, but for one longer document.
BLOCK_IDS = 500_000
#: For each control byte, the bytes of its four ids.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    n, top = len(ranks), int(ranks.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    size = np.ones(n, np.uint8)
    for k in range(1, width):
        size += ranks >= 1 << 8 * k
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    kept = np.empty((n, width), bool)
    for k in range(width):
        kept[:, k] = size > k
    return control.tobytes(), ranks.astype(f"<u{width}").view(np.uint8).reshape(n, width)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that pack() put in."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32 bits, packed as 16 bits where all fit: wide is false) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for c in chunks(batches, size=ENCODED_BYTES):
            raw = c.data.tobytes()
            ids = encoder.encode([raw[a:b] for a, b in zip(c.at[:-1], c.at[1:], strict=True)], end_id)
            wide = [x.itemsize > 2 and int(x.max()) >= 1 << 16 for x in ids]
            blobs = [x.tobytes() if w else x.astype("<u2", copy=False).tobytes() for x, w in zip(ids, wide, strict=True)]
            yield pa.RecordBatch.from_arrays([c.rows.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(wide), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "wide", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, wide boolean, ids binary")


def ids_of(blob: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if wide else "<u2")


def counted(tokens: DataFrame) -> DataFrame:
    """id, n: how often each id occurs; rows are summed up in each task first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, np.int64)
        for f in frames:
            for wide, blobs in f.groupby("wide")["ids"]:
                n = np.bincount(ids_of(b"".join(blobs), wide))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    return tokens.select("wide", "ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of docs in ascending order of ids and returns the manifest: folder, file, part, n_ids.

    A null text counts as empty (end_id alone); a null id comes first; of rows with equal ids, those of fewer tokens
    come first. What goes to the driver is the count of each id of the vocabulary, whose size the tokenizer's file fixes.
    Files that a lost or repeated task left are in no manifest.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    tokens = written(tokenized(docs, tokenizer, end_id, id_col, text_col), "tokens")
    count = counted(tokens).orderBy(F.desc("n"), "id").toPandas()
    by_rank = count["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/ranks") as f:
        f.write(by_rank.astype("<u4").tobytes())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name, out, total = f"part-{part:06d}-{uuid.uuid4().hex}", None, 0
        numbers: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def block() -> None:
            nonlocal out, total, size
            out = out or store.open_output_stream(f"{at}/{name}", compression=None)
            ids = np.concatenate(held)
            control, data = pack(rank_of[ids])
            out.write(MAGIC + struct.pack("<3Q", len(numbers), len(ids), len(data)) + np.array(numbers, "<i8").tobytes() + np.array([len(x) for x in held], "<i8").tobytes() + control + data)
            total += len(ids)
            numbers.clear()
            held.clear()
            size = 0

        for f in frames:
            for number, wide, blob in zip(f["doc_id"], f["wide"], f["ids"], strict=True):
                numbers.append(NULL_ID if pd.isna(number) else int(number))
                held.append(ids_of(blob, wide))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    block()
        if held:
            block()
        if out:
            out.close()
            yield pd.DataFrame({"folder": [folder], "file": [name], "part": [part], "n_ids": [total]})

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens")
    manifest = written(ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "wide", "ids").mapInPandas(run, "folder string, file string, part int, n_ids long"), "token-manifest")
    dropped(tokens)
    return manifest


def blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's document numbers, lengths and ranks."""
    while head := stream.read(28):
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        n, ids, size = struct.unpack("<3Q", head[4:])
        numbers, lengths = (np.frombuffer(stream.read(8 * n), "<i8") for _ in range(2))
        yield numbers, lengths, unpack(stream.read(-(-ids // 4)), stream.read(size), ids)


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the files: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32 bits, not if with_ids is false), ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # a row a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in (row for b in batches for row in b.to_pylist()):
            start = f["start"]
            store, at = fs.FileSystem.from_uri(f["folder"])
            with store.open_input_stream(f"{at}/ranks", compression=None) as s:
                by_rank = np.frombuffer(s.read(), "<u4")
            with store.open_input_stream(f"{at}/{f['file']}", compression=None) as s:
                for numbers, lengths, ranks in blocks(s):
                    ids = memoryview(by_rank[ranks]).cast("B")
                    ends = np.cumsum(lengths)
                    parts = [ids[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                    columns = {"doc_id": pa.array(numbers, mask=numbers == NULL_ID), "start": pa.array(start + ends - lengths), "n_tokens": pa.array(lengths)}
                    if with_ids:
                        columns["ids"] = pa.array(parts, pa.binary())
                    yield pa.RecordBatch.from_pydict(columns | {"ids_crc32": pa.array([zlib.crc32(x) for x in parts], pa.int64())})
                    start += int(lengths.sum())

    return by_file(files).mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids binary, ' * with_ids}ids_crc32 long")
