"""Legacy archives to WARC: parse ARC files, synthesise equivalent WARC records, write and read archives.

An ARC file opens with a version block that names the fields of its record headers (version 1: URL, IP-address,
Archive-date, Content-type, Archive-length; version 2 adds result code, checksum, location, offset and filename). The
parser follows those fields and each record's declared length. Converted records get a WARC identifier derived from their place and
content, an ISO date, a type by URL scheme and content, and SHA-1 digests of block and payload; content types and addresses are
kept, and each version block becomes the warcinfo record that the archive's other records name.
Archives are written by Spark's own text writer, so they reach any file system that Spark knows and failed tasks leave nothing
behind. Each record is a gzip member: the last byte of a member's length is 0 below 16 MB, and that byte is the writer's line
separator (a longer member is followed by one such byte, which is the padding that gzip allows).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklake.llm._text import pieces, small_batches

#: The fields of both ARC versions, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Records of one archive file, and bytes of payload if none is larger, at most.
FILE_RECORDS, FILE_BYTES = 2000, 256 << 20
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID_HEADER, _SIZE_HEADER, _REFERS_HEADER = "WARC-Source-Row", "WARC-Payload-Length", "WARC-Refers-To-Source-Row"


@dataclass
class ArcRecord:
    version: int
    offset: int
    fields: dict[str, str]
    block: bytes

    @property
    def url(self) -> str:
        return self.fields.get("URL", "")

    @property
    def date(self) -> str:
        """The 14-digit (or shorter) archive date as ISO 8601."""
        digits = re.sub(r"\D", "", self.fields.get("Archive-date", ""))
        d = digits + "00000101000000"[len(digits) :]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"

    def parts(self) -> tuple[bytes, bytes]:
        """HTTP headers and payload; without a status line all is payload."""
        if self.block.startswith(b"HTTP/"):
            found = re.search(rb"\r?\n\r?\n", self.block)
            if found:
                return self.block[: found.end()], self.block[found.end() :]
            return self.block, b""
        return b"", self.block

    @property
    def warc_type(self) -> str:
        if self.url.startswith("filedesc:"):
            return "warcinfo"
        return "response" if self.block.startswith(b"HTTP/") or self.url.startswith("dns:") else "resource"


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """All records of an ARC file, the version block first; gzip members are opened. Raises ValueError on a malformed header or a truncated record."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at, names, version = 0, ARC_FIELDS[1].split(), 1
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        values = raw[at:end].rstrip(b"\r").decode("utf-8", "surrogateescape")
        first = values.startswith("filedesc:")
        own = ARC_FIELDS[1].split() if first else names
        # the URL may hold spaces, so fields count from the right
        cells = values.rsplit(" ", len(own) - 1)
        if len(cells) != len(own) or not cells[-1].isdigit():
            if not first:
                raise ValueError(f"{len(own)} fields expected at byte {at}: {values[:100]!r}")
            cells, own = values.rsplit(" ", len(ARC_FIELDS[2].split()) - 1), ARC_FIELDS[2].split()
        fields = dict(zip(own, cells, strict=True))
        size = int(fields["Archive-length"])
        block = raw[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(block)} are left")
        if first:
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0])
            names = lines[1].split() if len(lines) > 1 else ARC_FIELDS[version].split()
        yield ArcRecord(version, at, fields, block)
        at = end + 1 + size


def build_arc(name: str, version: int, records: list[tuple[str, str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, block)."""
    desc = f"{version} 0 sparklake\n{ARC_FIELDS[version]}\n\n".encode()

    def header(url: str, ip: str, date: str, mime: str, size: int, offset: int) -> bytes:
        middle = f" 200 - - {offset} {name}" if version == 2 else ""
        return f"{url} {ip} {date} {mime}{middle} {size}\n".encode("utf-8", "surrogateescape")

    out, offset = [], 0
    for url, ip, date, mime, block in [(f"filedesc://{name}", "0.0.0.0", "20240101000000", "text/plain", desc), *records]:
        line = header(url, ip, date, mime, len(block), offset)
        out += [line, block, b"\n"]
        offset += len(line) + len(block) + 1
    return b"".join(out)


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}>"


def warc_record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    """The bytes of a WARC record without its closing blank lines."""
    lines = [f"{k}: {v}" for k, v in ({"WARC-Type": kind} | headers | {"WARC-Block-Digest": sha1_digest(block), "Content-Length": str(len(block))}).items() if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8", "surrogateescape") + CRLF + CRLF + block


def members(raw: bytes) -> Iterator[bytes]:
    """The contents of each gzip member, one at a time; plain data as it is."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while at < len(raw):
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:
            if at >= len(raw):
                raise ValueError("a gzip member is cut off")
            chunk = raw[at : at + (1 << 16)]
            parts.append(opened.decompress(chunk))
            at += len(chunk) - len(opened.unused_data)
        yield b"".join(parts)
        while at < len(raw) and raw[at] == 0:
            at += 1


def member(data: bytes) -> bytes:
    """A gzip member that, with one zero byte behind it, is whole; equal data give equal bytes."""
    packed = gzip.compress(data, mtime=0)
    return packed[:-1] if packed[-1] == 0 else packed


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths; header names in lower case. A gzip member holds whole records."""
    for part in members(raw):
        yield from _warc_records(part)


def _warc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(CRLF + CRLF, at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in raw[at:end].split(CRLF)[1:]:
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(block)} are left")
        yield headers, block
        at = end + 4 + size


def _clean(url: str | None) -> str:
    """A URL fit for a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


RECORDS = "row long, url string, date string, type string, mime string, ip string, http binary, payload binary, digest string, record_id string, info_id string"


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(name, content): legacy archives of the pages, versions 1 and 2 in turn, a few MB each. The row's id travels as an HTTP header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part_id = count(), TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, "payload"):
                k = next(number)
                name = f"legacy-{part_id:06d}-{k:06d}.arc"
                records = []
                for row, url, payload in zip(part.column("row").to_pylist(), part.column("url").to_pylist(), part.column("payload").to_pylist(), strict=True):
                    own = b"" if row is None else f"X-Source-Row: {row}\r\n".encode()
                    body = payload or b""
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + f"Content-Length: {len(body)}\r\n\r\n".encode()
                    records.append((_clean(url), "192.0.2.1", "20240101000000", "text/html", http + body))
                yield pa.record_batch([pa.array([name]), pa.array([build_arc(name, 1 + k % 2, records)], pa.binary())], ["name", "content"])

    wanted = small_batches(pages).select(F.col(id_col).cast("long").alias("row"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    return wanted.mapInArrow(run, "name string, content binary")


def convert_arc(archives: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """The WARC equivalents of all records of ARC archives: row (X-Source-Row, if any), url, date, type, mime, ip, http, payload, digest, record_id, info_id.

    A version block becomes a warcinfo record of its lines. Null and empty archives have no records; malformed ones raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out, info = [], None
                for r in parse_arc(raw or b""):
                    record_id = _urn(f"{name}/{r.offset}/{r.url}/{r.date}")
                    mime, ip = r.fields.get("Content-type"), r.fields.get("IP-address")
                    if r.warc_type == "warcinfo":
                        info = record_id
                        lines = r.block.decode("utf-8", "replace").splitlines()
                        fields = {"software": "sparklake", "format": "WARC File Format 1.1", "isPartOf": r.url.removeprefix("filedesc://"), "arc-version-block": " / ".join(x for x in lines if x)}
                        payload = "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode()
                        out.append((None, "-", r.date, "warcinfo", "application/warc-fields", None, b"", payload, sha1_digest(payload), record_id, None))
                        continue
                    http, payload = r.parts()
                    row = re.search(rb"(?im)^X-Source-Row: *(-?\d+)\r?$", http)
                    out.append((int(row[1]) if row else None, r.url, r.date, r.warc_type, mime, ip, http, payload, sha1_digest(payload), record_id, info))
                text, data = pa.string(), pa.binary()
                types = (pa.int64(), text, text, text, text, text, data, data, text, text, text)
                cols = zip(*out, strict=True) if out else [[]] * len(types)
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])

    return archives.select(F.col(name_col).alias("name"), F.col(content_col).alias("content")).mapInArrow(run, RECORDS)


def mark_revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """records with ref_row, ref_id, ref_url, ref_date: of equal payloads of at least ``least`` bytes, the record with the largest row stays.

    Only digests that repeat are joined. Null rows come before all others; records that tie with the largest row all stay.
    Warcinfo records stay as they are.
    """
    large = (F.octet_length("payload") >= least) & (F.col("type") != "warcinfo")
    key = F.struct(F.coalesce("row", F.lit(-(1 << 63))).alias("row"), "record_id", "url", "date")
    kept = records.where(large).groupBy("digest").agg(F.max(key).alias("_kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = records.join(kept, "digest", "left")
    late = F.coalesce(large & (F.coalesce("row", F.lit(-(1 << 63))) < F.col("_kept.row")), F.lit(False))
    return found.select(*records.columns, *[F.when(late, F.col(f"_kept.{c}")).alias(f"ref_{n}") for c, n in (("row", "row"), ("record_id", "id"), ("url", "url"), ("date", "date"))])


def write_warc(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Archives of the marked records under ``path``, a gzip member each: revisits keep their HTTP headers and refer to the stored record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                headers = {
                    "WARC-Record-ID": r["record_id"],
                    "WARC-Date": r["date"],
                    "WARC-Target-URI": None if r["url"] == "-" else r["url"],
                    "WARC-IP-Address": r["ip"] if r["ip"] not in ("", "-", "0.0.0.0") else None,
                    "WARC-Warcinfo-ID": r["info_id"],
                    _ID_HEADER: None if r["row"] is None else str(r["row"]),
                    "WARC-Payload-Digest": r["digest"],
                    _SIZE_HEADER: str(len(r["payload"])),
                    "Content-Type": "application/http; msgtype=response" if r["http"] else r["mime"] if r["mime"] not in (None, "", "-", "no-type") else "application/octet-stream",
                }
                kind, block = r["type"], r["http"] + r["payload"]
                if r["ref_id"] is not None:
                    kind, block = "revisit", r["http"]
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": r["ref_id"], "WARC-Refers-To-Target-URI": r["ref_url"], "WARC-Refers-To-Date": r["ref_date"], _REFERS_HEADER: str(r["ref_row"])}
                out.append(member(warc_record(kind, headers, block) + CRLF + CRLF))
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    lines = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(path)


READ = "row long, url string, record_type string, content_type string, ip string, record_id string, warcinfo_id string, payload_digest string, payload_bytes long, refers_to string, refers_to_row long, payload binary"
#: Records that a reader sends at once.
READ_RECORDS = 200


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(row, url, record_type, content_type, ip, record_id, warcinfo_id, payload_digest, payload_bytes, refers_to, refers_to_row, payload) of each record under ``path``.

    Digest and size of a response are computed from its block and must equal what its headers declare; a revisit has
    those of the payload that it stands for, and no payload.
    """

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        text, size = pa.string(), pa.int64()
        types = (size, text, text, text, text, text, text, text, size, text, size, pa.binary())
        cols = zip(*out, strict=True) if out else [[]] * len(types)
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                out = []
                for h, block in parse_warc(raw):
                    number = lambda name, h=h: int(h[name.lower()]) if name.lower() in h else None
                    _, payload = ArcRecord(0, 0, {}, block).parts()
                    digest, size = h.get("warc-payload-digest", ""), number(_SIZE_HEADER)
                    if h["warc-type"] == "revisit":
                        payload = None
                    elif (sha1_digest(payload), len(payload)) != (digest or sha1_digest(payload), len(payload) if size is None else size):
                        raise ValueError(f"{h.get('warc-record-id')}: payload differs from its digest or length")
                    else:
                        digest, size = sha1_digest(payload), len(payload)
                    hexed = base64.b32decode(digest.partition(":")[2]).hex() if digest else None
                    out.append((number(_ID_HEADER), h.get("warc-target-uri"), h["warc-type"], h.get("content-type"), h.get("warc-ip-address"), h.get("warc-record-id"), h.get("warc-warcinfo-id"), hexed, size, h.get("warc-refers-to"), number(_REFERS_HEADER), payload))
                    if len(out) >= READ_RECORDS:
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, READ)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Convert the pages' legacy archives to WARC files under ``path`` and read the pages' records back: see ``read_warc``.

    Null payloads and URLs are empty; repeated rows are records like others, and rows without an id come back with a null row. Of
    several records of the largest id all are responses. Payloads may be as long as a Spark value (2 GB with their headers): files hold fewer records then.
    Other columns are left out, so none can clash. An empty table gives no rows.
    """
    longest = pages.agg(F.coalesce(F.max(F.octet_length(payload_col)), F.lit(0))).first()[0]
    write_warc(mark_revisits(convert_arc(arc_archives(pages, id_col, url_col, payload_col))), path, max(1, min(FILE_RECORDS, FILE_BYTES // max(longest, 1))))
    return read_warc(pages.sparkSession, path).where("record_type <> 'warcinfo'")
