"""Legacy archives: ARC files of versions 1 and 2, their conversion to WARC, and reading WARC files back.

Archives are files in a shared folder, one gzip member a record. Tables carry their names, places and digests; payloads go
from file to file, never through a shuffle. A file that a lost task left behind is named by no table.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.scratch import by_file, new_path, written

# The ARC and WARC formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a compressed archive before the next one is begun.
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
NULL_PAGE = "-"


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, wbits=31)
    return z.compress(data) + z.flush()


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- ARC


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that an ARC file begins with."""
    body = f"{version} 0 sparklex\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return _arc_line(version, f"filedesc://{name}", date, "text/plain", len(body), "200", name) + body


def _arc_line(version: int, url: str, date: str, kind: str, length: int, code: str = "200", name: str = "-") -> bytes:
    fields = [url, "0.0.0.0", date, kind, str(length)] if version == 1 else [url, "0.0.0.0", date, kind, code, "-", "-", "0", name, str(length)]
    return (" ".join(fields) + "\n").encode()


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    kind: str
    content: bytes
    code: str = "-"
    checksum: str = "-"

    def http(self) -> tuple[dict[str, str], bytes, bytes]:
        """Header fields (small letters), the header with its empty line, the payload; no header if it isn't HTTP."""
        if not self.content.startswith(b"HTTP/"):
            return {}, b"", self.content
        cut, size = min(((k, len(s)) for s in (b"\r\n\r\n", b"\n\n") if (k := self.content.find(s)) >= 0), default=(len(self.content), 0))
        head = self.content[: cut + size]
        fields = dict(x.split(":", 1) for x in head.decode("latin-1").splitlines()[1:] if ":" in x)
        return {k.strip().lower(): v.strip() for k, v in fields.items()}, head, self.content[cut + size :]


def parse_arc(data: bytes, version: int, at: int = 0) -> tuple[ArcRecord, int]:
    """The record whose header line begins at a place of data, and where its declared length ends."""
    end = data.find(b"\n", at)
    if end < 0:
        raise ValueError("an ARC record without a header line")
    fields = data[at:end].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(ARC_FIELDS[version]) - 1)
    if len(fields) != len(ARC_FIELDS[version]) or not fields[-1].isdigit():
        raise ValueError(f"not a header line of ARC version {version}: {data[at:end][:200]!r}")
    length = int(fields[-1])
    if end + 1 + length > len(data):
        raise ValueError("an ARC record is shorter than its declared length")
    code, checksum = fields[4:6] if version == 2 else ("-", "-")
    return ArcRecord(*fields[:4], data[end + 1 : end + 1 + length], code, checksum), end + 1 + length


def arc_version(data: bytes) -> tuple[int, int]:
    """Of the version block that data begins with: the version and where it ends."""
    line = data[: data.find(b"\n")].decode("utf-8", "replace")
    if not line.startswith("filedesc://"):
        raise ValueError("an ARC file without a version block")
    end = len(line.encode()) + 1
    length = int(line.rsplit(" ", 1)[1])
    return int(data[end : end + length].split(b" ", 1)[0]), end + length


def write_arc(pages: DataFrame, version: int = 1, folder: str | None = None, date: str = "20240101000000") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the files: folder, file.

    A null html is an empty payload, a null url "about:blank", white space in urls is quoted; the page's id is a field of
    the HTTP header. Other columns are left behind. An empty table gives no files.
    """
    folder = folder or new_path(pages.sparkSession, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        out, size, names = None, 0, []
        for b in batches:
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.arc.gz")
                    out = store.open_output_stream(f"{at}/{names[-1]}", compression=None)
                    size = out.write(gzipped(arc_head(version, names[-1], date)))
                body = (html or "").encode()
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {NULL_PAGE if page is None else page}\r\n\r\n".encode() + body
                line = _arc_line(version, quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~"), date, "text/html", len(content), "200", names[-1])
                size += out.write(gzipped(line + content + b"\n"))
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out:
            out.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([folder] * len(names)), pa.array(names)], ["folder", "file"])

    return written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "folder string, file string"), "arc-files")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Where each gzip member begins, its size and what it holds."""
    begin, rest = 0, b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        z, parts, size = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(rest))
            size += len(rest) - len(z.unused_data)
            rest = z.unused_data
        yield begin, size, b"".join(parts)
        begin += size


def arc_records(store, path: str) -> Iterator[tuple[int, int, int, ArcRecord]]:
    """place, size (in the file), version and record; a member may hold the version block and records after it."""
    with store.open_input_stream(path, compression=None) as s:
        packed = s.read(2) == b"\x1f\x8b"
    version = 0
    with store.open_input_stream(path, compression=None) as s:
        parts = members(s) if packed else iter([(0, 0, s.read())])
        for begin, size, data in parts:
            at = 0
            if data.startswith(b"filedesc://"):
                version, at = arc_version(data)
            while at < len(data):
                if data[at] in b"\r\n":
                    at += 1
                    continue
                record, end = parse_arc(data, version, at)
                yield (begin, size, version, record) if packed else (at, end - at, version, record)
                at = end


INDEX = "folder string, file string, place long, size long, version int, url string, date string, page_id long, payload_bytes long, payload_digest string, record_id string"


def arc_index(files: DataFrame) -> DataFrame:
    """A row for each record of the ARC files, without its content; record_id is the one its WARC record gets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for folder, file in zip(f["folder"], f["file"], strict=True):
                store, at = fs.FileSystem.from_uri(folder)
                rows = []
                for place, size, version, r in arc_records(store, f"{at}/{file}"):
                    fields, _, payload = r.http()
                    page = fields.get("x-page-id", NULL_PAGE)
                    rows.append((folder, file, place, size, version, r.url, r.date, None if page == NULL_PAGE else int(page), len(payload), digest(payload), record_id(file, place, r.url)))
                    if len(rows) >= 5000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    return by_file(files.select("folder", "file")).mapInPandas(run, INDEX)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
    return out.assign(page_id=out["page_id"].astype("Int64"))


def record_id(file: str, place: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{place} {url}')}>"


# -- WARC


def warc_date(date: str) -> str:
    """ARC's 8, 12 or 14 digits as a WARC date."""
    d = (date + "19700101000000"[len(date) :])[:14] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}.items())
    return gzipped(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n")


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a WARC record is shorter than its declared length")
    return fields, block


def plan(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """index with the response that each revisit refers to: refers_id, refers_page, refers_url, refers_date (else null).

    Of records with equal payloads of at least min_bytes, that with the largest page_id is the response (null ids are
    smaller than others; of equal ids, that with the largest url and then date; what ties still are alike).
    """
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), F.col("url").alias("by_url"), F.col("date").alias("by_date"), F.col("record_id").alias("id"), F.col("page_id").alias("p"), F.col("url").alias("url"), F.col("date").alias("date"))
    key = ["payload_bytes", "payload_digest"]
    best = index.where(F.col("payload_bytes") >= min_bytes).groupBy(*key).agg(F.max(order).alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.col("best.id") != F.col("record_id")
    return index.join(best, key, "left").select(*index.columns, *[F.when(other, F.col(f"best.{k}")).alias(f"refers_{v}") for k, v in (("id", "id"), ("p", "page"), ("url", "url"), ("date", "date"))])


def convert(files: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes a WARC file for each ARC file and returns them: folder, file.

    Each record gets an id made from its file, place and URL, a WARC date from its ARC date, its type (response; resource
    where it isn't HTTP; revisit where another record has the same payload, see plan()), block and payload digests.
    """
    folder = folder or new_path(files.sparkSession, "warc")
    planned = plan(written(arc_index(files), "arc-index"), min_bytes)
    ordered = planned.repartition(max(1, 3 * files.count()), "file").sortWithinPartitions("file", "place", "record_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, to = fs.FileSystem.from_uri(folder)
        store.create_dir(to, recursive=True)
        last, source, out, names = None, None, None, []
        for f in frames:
            for r in f.itertuples(index=False):
                if (r.folder, r.file) != last:
                    for x in (source, out):
                        if x:
                            x.close()
                    last = (r.folder, r.file)
                    from_store, at = fs.FileSystem.from_uri(r.folder)
                    source = from_store.open_input_file(f"{at}/{r.file}")
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = store.open_output_stream(f"{to}/{names[-1]}", compression=None)
                    out.write(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(names[-1], -1, ""), "WARC-Date": warc_date(r.date), "WARC-Filename": names[-1], "Content-Type": "application/warc-fields"}, f"software: sparklex\r\nconformsTo: WARC/1.1\r\nsource: {r.file}\r\n".encode()))
                out.write(_converted(r, source))
        for x in (source, out):
            if x:
                x.close()
        if names:
            yield pd.DataFrame({"folder": folder, "file": names})

    return written(ordered.mapInPandas(run, "folder string, file string"), "warc-files")


def _converted(r, source) -> bytes:
    source.seek(r.place)
    data = source.read(r.size)
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    at = arc_version(data)[1] if data.startswith(b"filedesc://") else 0
    while data[at] in b"\r\n":
        at += 1
    record, _ = parse_arc(data, r.version, at)
    _, head, payload = record.http()
    fields = {"WARC-Type": "response" if head else "resource", "WARC-Record-ID": r.record_id, "WARC-Date": warc_date(record.date), "WARC-Target-URI": record.url, "WARC-IP-Address": record.ip, "WARC-Payload-Digest": f"sha1:{r.payload_digest}", "Content-Type": "application/http; msgtype=response" if head else record.kind, "Page-Id": NULL_PAGE if pd.isna(r.page_id) else str(int(r.page_id))}
    if isinstance(r.refers_id, str):
        refers = {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": r.refers_id, "WARC-Refers-To-Target-URI": r.refers_url, "WARC-Refers-To-Date": warc_date(r.refers_date), "Payload-Length": str(int(r.payload_bytes)), "Refers-To-Page-Id": NULL_PAGE if pd.isna(r.refers_page) else str(int(r.refers_page))}
        return warc_record(fields | refers, head)
    return warc_record(fields, head + payload)


def read_warc(files: DataFrame) -> DataFrame:
    """A row for each response, resource and revisit of the WARC files; digests of payloads that are there are checked."""
    schema = "page_id long, url string, date string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in frames:
            for folder, file in zip(b.column("folder").to_pylist(), b.column("file").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(f"{at}/{file}", compression=None) as s:
                    for _, _, data in members(s):
                        fields, block = parse_warc(data)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        payload = ArcRecord("", "", "", "", block).http()[2]
                        want = fields["warc-payload-digest"].removeprefix("sha1:")
                        if kind != "revisit" and digest(payload) != want:
                            raise ValueError(f"a payload's digest differs in {file}")
                        page, refers = (None if (x := fields.get(k, NULL_PAGE)) == NULL_PAGE else int(x) for k in ("page-id", "refers-to-page-id"))
                        rows.append((page, fields["warc-target-uri"], fields["warc-date"], fields["warc-record-id"], kind, int(fields["payload-length"]) if kind == "revisit" else len(payload), want, refers, None if kind == "revisit" else payload))
                        size += len(payload) + 200
                        if size >= 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return by_file(files.select("folder", "file")).mapInArrow(run, schema)
