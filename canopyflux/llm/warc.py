"""WARC records in ZIP-packaged archives: writing, and reading by byte ranges without extraction.

An archive is a ZIP file with two stored (not deflated) members: ``archive/data.warc.gz``, where every record is a gzip
member of its own, and ``indexes/index.cdxj``, one line for each record with its place in that member. The reader
parses the end record, the ZIP64 end record where there is one, the central directory and the local headers, so that it
knows where a stored member lies in the file; it then reads the index and each record by its range. It needs only an
object that can seek and read.

:func:`write_archives` writes a table's rows to archive files of bounded size in a folder that all executors share, and
returns their paths. :func:`list_records` reads the directories and indexes and returns a row (path, offset, length) for
each record; :func:`read_records` reads these byte ranges and nothing else of the files, ranges that adjoin at once. A
task that is run again writes a file of its own; only files whose tasks have ended are in the table, and others are never
read.

Records with equal payloads are written once: that with the largest id is the response, and the others revisit it. Equal
payloads are found by length, SHA-256 and SHA-1, with partial counts, so a payload that a third of all rows share leaves
each task as one row. Rows are told what they revisit by their ids: digests that many rows share are looked up in a small
broadcast table, all others by a join of digests and ids alone, and payloads are dealt out once, by id.

Defined results: a null payload counts as empty; payloads shorter than ``least`` bytes are all responses; rows that
repeat an id and a payload repeat the record; a null or empty url becomes an empty target; an empty table gives no
archive. Other columns don't matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import core, cut, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of uncompressed records after which an archive is closed.
ARCHIVE_BYTES = 16_000_000

# Fixed values of the ZIP format: signatures, and the header id of the ZIP64 extra field.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
EXTRA64 = 1
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP ---------------------------------------------------------------------------------------------------------------


class ZipWriter:
    """Stores members as they are. With ``zip64`` every size and offset is written in its 64-bit form."""

    def __init__(self, out: BinaryIO, zip64: bool = False) -> None:
        self.out, self.zip64, self.entries = out, zip64, []

    def store(self, name: str, data: bytes) -> None:
        at, crc, raw = self.out.tell(), zlib.crc32(data), name.encode()
        big = self.zip64 or len(data) >= FULL32
        extra = struct.pack("<HHQQ", EXTRA64, 16, len(data), len(data)) if big else b""
        size = FULL32 if big else len(data)
        self.out.write(struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self.out.write(data)
        self.entries.append((raw, crc, len(data), at))

    def close(self) -> None:
        start = self.out.tell()
        for raw, crc, size, at in self.entries:
            big = self.zip64 or size >= FULL32 or at >= FULL32
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, at) if big else b""
            short, place = (FULL32, FULL32) if big else (size, at)
            self.out.write(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, place) + raw + extra)
        size, n = self.out.tell() - start, len(self.entries)
        if self.zip64 or start >= FULL32 or n >= FULL16:
            at = self.out.tell()
            self.out.write(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self.out.write(struct.pack("<4sIQI", LOCATOR64, 0, at, 1))
            n, size, start = FULL16, FULL32, FULL32
        self.out.write(struct.pack("<4sHHHHIIH", END, 0, 0, n, n, size, start, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class ZipReader:
    """The directory of a ZIP file, and ranges of its stored members."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        self.size = file.seek(0, io.SEEK_END)
        self.members = {m.name: m for m in self._directory()}

    def read_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"the archive ends before byte {at + n}")
        return data

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self.read_at(tail_at, self.size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of a central directory: not a ZIP file")
        n, size, start = struct.unpack_from("<HII", tail, at + 10)
        end = tail_at + at
        if end >= 20 and (locator := self.read_at(end - 20, 20))[:4] == LOCATOR64:
            end64 = self.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("the ZIP64 locator leads nowhere")
            n, size, start = struct.unpack_from("<QQQ", end64, 32)
        raw, p = self.read_at(start, size), 0
        for _ in range(n):
            if raw[p : p + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", raw, p + 10)[0]
            packed, plain, ln, lx, lc = struct.unpack_from("<IIHHH", raw, p + 20)
            header = struct.unpack_from("<I", raw, p + 42)[0]
            name, extra = raw[p + 46 : p + 46 + ln], raw[p + 46 + ln : p + 46 + ln + lx]
            q = 0
            while q + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, q)
                if kind == EXTRA64:  # holds, in this order, the fields that are full in the plain entry
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                    plain = next(values) if plain == FULL32 else plain
                    packed = next(values) if packed == FULL32 else packed
                    header = next(values) if header == FULL32 else header
                q += 4 + length
            yield Member(name.decode(), method, packed, header)
            p += 46 + ln + lx + lc

    def place(self, name: str) -> int:
        """Where a stored member's data begin."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored as it is")
        head = self.read_at(m.header_at, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header of {name}")
        return m.header_at + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        return self.read_at(self.place(name) + at, self.members[name].size - at if n is None else n)


# --- WARC --------------------------------------------------------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(doc: int | None) -> str:
    return f"<urn:page:{'' if doc is None else doc}>"


def record(doc: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit if ``refers_to`` names the response that has the payload."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(doc)),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Date", "2026-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[-1:-1] = [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def payload_bytes(self) -> int:
        """Of the full payload: a revisit's HTTP header tells it, too."""
        return int(self.http["content-length"])


def _header(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse_record(raw: bytes) -> Record:
    version, fields, rest = _header(raw)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(fields["content-length"])]
    _, http, payload = _header(block)
    if fields["warc-type"] == "response" and "sha1:" + sha1_base32(payload) != fields["warc-payload-digest"]:
        raise ValueError(f"digest of {fields['warc-record-id']} doesn't match")
    return Record(fields, http, payload)


def archive(records: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of (record id, record)."""
    data, lines = io.BytesIO(), []
    for name, raw in records:
        at = data.tell()
        data.write(gzip.compress(raw, 1, mtime=0))
        lines.append(json.dumps({"id": name, "offset": at, "length": data.tell() - at}))
    out = io.BytesIO()
    z = ZipWriter(out, zip64)
    z.store(INDEX, "\n".join(lines).encode())
    z.store(DATA, data.getvalue())
    z.close()
    return out.getvalue()


def read_archive(file: BinaryIO) -> Iterator[Record]:
    """The records of an archive, each read by its own range."""
    z = ZipReader(file)
    start = z.place(DATA)
    for line in z.read(INDEX).decode().split("\n"):
        if line:
            entry = json.loads(line)
            yield parse_record(gzip.decompress(z.read_at(start + entry["offset"], entry["length"])))


# --- Spark -------------------------------------------------------------------------------------------------------------

#: Copies from which on a payload's digest is broadcast; there is at most one such digest for so many rows.
HOT_COPIES = 10_000
#: Most digests that are broadcast (some 100 bytes each); of more, the ones with the most copies.
HOT_DIGESTS = 50_000
#: Bytes of adjoining ranges that are read at once.
READ_BYTES = 4_000_000


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path is on, and the path there. Spark's names of schemes are taken, too."""
    scheme, sep, rest = uri.partition(":")
    if not sep or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def _revisits(rows: DataFrame, least: int, hot_copies: int) -> DataFrame:
    """(doc, n, sha, refers): for rows that aren't the response of their payload, that response's id. rows: doc, n, sha."""
    copies = cut(
        rows.filter(F.col("n") >= least).groupBy("n", "sha").agg(F.max("doc").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    )
    hot = copies.filter(F.col("copies") >= hot_copies).orderBy(F.desc("copies"), "sha").limit(HOT_DIGESTS)
    hot = cut(hot.select(F.col("n").alias("hot_n"), F.col("sha").alias("hot_sha"), F.col("first").alias("hot_first")))
    named = rows.join(F.broadcast(hot), (F.col("n") == F.col("hot_n")) & (F.col("sha") == F.col("hot_sha")), "left")
    direct = named.filter("hot_n IS NOT NULL").select("doc", "n", "sha", F.col("hot_first").alias("first"))
    others = named.filter("hot_n IS NULL").select("doc", "n", "sha").join(copies.select("n", "sha", "first"), ["n", "sha"])
    found = direct.unionByName(others.select("doc", "n", "sha", "first")).filter(~F.col("doc").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    return found.groupBy("doc", "n", "sha").agg(F.max("first").alias("refers"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, size: int = ARCHIVE_BYTES, hot_copies: int = HOT_COPIES
) -> DataFrame:
    """(path, records): one row for each ZIP archive written below ``folder``, which hold a record for each row of ``pages``."""
    rows = core(pages, id_col, url_col, payload_col).select(
        F.col(id_col).cast("long").alias("doc"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    )
    rows = rows.withColumns({"n": F.octet_length("payload"), "sha": F.concat(F.unhex(F.sha2("payload", 256)), F.unhex(F.sha1("payload")))})
    told = _revisits(rows.select("doc", "n", "sha"), least, hot_copies).hint("shuffle_hash").alias("r")
    same = F.col("l.doc").eqNullSafe(F.col("r.doc")) & (F.col("l.n") == F.col("r.n")) & (F.col("l.sha") == F.col("r.sha"))
    records = rows.alias("l").join(told, same, "left").select("l.doc", "l.url", "l.payload", "r.refers")
    folder = folder.rstrip("/")

    def write(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
        path = f"{folder}/{uuid.uuid4().hex}.zip"
        at, place = store(path)
        at.create_dir(place.rpartition("/")[0], recursive=True)
        with at.open_output_stream(place) as f:
            f.write(archive(held))
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], names=["path", "records"])

    def run(batches):
        held, used = [], 0
        for b in batches:
            docs, urls, payloads, refers = b.columns
            for i in range(b.num_rows):
                doc = docs[i].as_py()
                raw = record(doc, urls[i].as_py(), payloads[i].as_py(), refers[i].as_py())
                held.append((record_id(doc), raw))
                used += len(raw)
                if used >= size:
                    yield write(held)
                    held, used = [], 0
        if held:
            yield write(held)

    return cut(records.mapInArrow(run, "path string, records long"))


def list_records(archives: DataFrame) -> DataFrame:
    """(path, id, offset, length): where in its file each record lies, from the archives' directories and indexes."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                at, place = store(path)
                with at.open_input_file(place) as f:
                    z = ZipReader(f)
                    start = z.place(DATA)
                    found = [json.loads(x) for x in z.read(INDEX).decode().split("\n") if x]
                cols = [[path] * len(found), [x["id"] for x in found], [start + x["offset"] for x in found], [x["length"] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "id", "offset", "length"])

    return archives.select("path").mapInArrow(run, "path string, id string, offset long, length long")


def ranges(places: list[tuple[str, int, int]], most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(path, offset, length) put together where one ends as the next begins: path, offset, length, and the parts in it."""
    held: list[tuple[int, int]] = []
    path, begin, end = "", 0, 0
    for p, at, n in places:
        if held and (p != path or at != end or end + n - begin > most):
            yield path, begin, end - begin, held
            held = []
        if not held:
            path, begin, end = p, at, at
        held.append((at - begin, n))
        end += n
    if held:
        yield path, begin, end - begin, held


def read_records(places: DataFrame, with_payload: bool = True, most: int = READ_BYTES) -> DataFrame:
    """One row for each row (path, offset, length) of ``places``: the record that lies there."""

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        for b in batches:
            wanted = list(zip(*(b.column(x).to_pylist() for x in ("path", "offset", "length")), strict=True))
            last, f = None, None
            try:
                for path, at, n, parts in ranges(wanted, most):
                    if path != last:
                        if f is not None:
                            f.close()
                        system, place = store(path)
                        last, f = path, system.open_input_file(place)
                    f.seek(at)
                    raw, found = f.read(n), []
                    for a, length in parts:
                        r = parse_record(gzip.decompress(raw[a : a + length]))
                        row = (_number(r.fields["warc-record-id"]), r.fields["warc-target-uri"], r.payload_bytes, r.fields["warc-payload-digest"].removeprefix("sha1:"))
                        found.append(row + (r.fields["warc-type"], _number(r.fields.get("warc-refers-to"))) + (r.payload,) * with_payload)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
            finally:
                if f is not None:
                    f.close()

    schema = "doc long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    return places.select("path", "offset", "length").mapInArrow(run, schema)


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for each row into archives in the shared folder, reads the archives back, and returns their records."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder, id_col, url_col, payload_col, least)
    return read_records(list_records(written), with_payload=False).drop("url").withColumnRenamed("doc", id_col)
