"""Legacy archive converter: ARC files, version 1 and 2, to WARC, and a reader of both.

An ARC file starts with a version block whose body names the fields of all record headers; a record is a
header line and as many bytes as its last field declares.  The converter reads header lines by the version
found there and writes what WARC asks for instead: a record id derived from the archive's name and the
record's offset, the date in ISO form, the type (warcinfo, response, resource or revisit) and SHA-256 digests of block
and payload.  A revisit names the url and date of the record it refers to.  Record ids and everything else depend on the input only, so a lost task writes the same bytes.

Archives are values of a binary column, written as a table in the shared folder: they can be read from any
executor.  WARC records are gzip members, so that each can be read on its own.

Defined cases: a null html is an empty payload; blanks and control characters in an url are percent-encoded
and a null url is "-"; a row with a null id revisits the page with the smallest id, and is a response where its
payload has none; of rows that share the smallest id of a payload each is a response; rows that share an id and
differ in their payload are decided one by one; blocks that are no HTTP response become resource records; an empty table gives an empty result; a record cut short raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import spread_join
from .common import lean, save, table

#: Header fields of ARC versions 1 and 2, in order, as their version blocks name them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Bytes of payload an archive holds about.
ARCHIVE_BYTES = 2 << 20
#: Payloads that more than one row has, up to which they are broadcast; beyond it the join is shuffled.
SMALL = 200_000
DATE = "20240101000000"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    offset: int
    block: bytes
    version: int


def _url(url: str | None) -> str:
    if not url:
        return "-"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def write_arc(name: str, pages: list[tuple], version: int = 1) -> bytes:
    """An ARC file of (url, http headers, payload) triples."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 listforge\n{' '.join(fields)}\n\n".encode()

    def header(url: str, kind: str, length: int, offset: int) -> bytes:
        values = dict(zip(fields, ["-"] * len(fields), strict=True)) | {"URL": url, "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": kind, "Result-code": "200", "Offset": str(offset), "Filename": name, "Archive-length": str(length)}
        return " ".join(values[f] for f in fields).encode() + b"\n"

    out = bytearray(header(f"filedesc://{name}", "text/plain", len(body), 0) + body)
    for url, head, payload in pages:
        block = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
        block = b"HTTP/1.1 200 OK\r\n" + block + b"\r\n" + payload
        out += b"\n" + header(_url(url), "text/html", len(block), len(out) + 1) + block
    return bytes(out) + b"\n"


def header_values(line: str, fields: list[str]) -> list[str]:
    """The fields of a header line; urls and content types may hold blanks that old crawlers left as they were.

    The date, 14 digits after an address, divides the two: what stands before the address is the url, and what
    stands between the date and as many fields as follow the content type is that.
    """
    words = line.split(" ")
    if len(words) <= len(fields) or "Archive-date" not in fields or "Content-type" not in fields:
        return words
    date, kind = fields.index("Archive-date"), fields.index("Content-type")
    after = len(fields) - kind - 1
    for i in range(date, len(words) - after - 1):
        if len(words[i]) == 14 and words[i].isdigit():
            return [" ".join(words[: i - date + 1]), *words[i - date + 1 : i + 1], " ".join(words[i + 1 : len(words) - after]), *words[len(words) - after :]]
    return words


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, the version block first; its fields hold for all others."""
    at, fields, version = 0, ARC_FIELDS[1], 1
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line cut short at {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not at:  # the version block's own header tells its version by its length
            version = 2 if len(line.split(" ")) == len(ARC_FIELDS[2]) else 1
            fields = ARC_FIELDS[version]
        values = header_values(line, fields)
        if len(values) != len(fields):
            raise ValueError(f"header line at {at} has {len(values)} fields, version {version} has {len(fields)}")
        length = int(values[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are there")
        if not at:
            named = block.split(b"\n")
            if len(named) > 1 and named[1]:
                fields = named[1].decode().split(" ")
                version = int(named[0].split(b" ")[0])
        yield ArcRecord(dict(zip(fields, values, strict=False)), at, block, version)
        at = end + 1 + length


def record_id(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>"


def iso_date(stamp: str) -> str:
    s = (stamp + "00000101000000"[len(stamp) :])[:14] if stamp.isdigit() else DATE
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head, header fields, payload) of an HTTP response; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + gap, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def _known(value: str | None, otherwise: str) -> str:
    return value if value and value != "-" else otherwise


def sha256(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def convert(name: str, data: bytes) -> bytes:
    """The WARC file equivalent to an ARC file."""
    out = bytearray()
    for r in read_arc(data):
        url = r.fields.get("URL", "-")
        head = {"WARC-Record-ID": record_id(name, r.offset), "WARC-Date": iso_date(r.fields.get("Archive-date", ""))}
        block = r.block
        if not r.offset:  # the version block; a page's url may look like its own
            head |= {"WARC-Type": "warcinfo", "WARC-Filename": name, "Content-Type": "application/warc-fields"}
            block = f"format: converted from ARC version {r.version}\r\n".encode()
        else:
            http, fields, payload = http_parts(block)
            # what did not come by HTTP (dns: records, files of other schemes) is a resource of the type declared
            kind = {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"} if http else {"WARC-Type": "resource", "Content-Type": _known(r.fields.get("Content-type"), "application/octet-stream")}
            head |= kind | {"WARC-Target-URI": url, "WARC-Payload-Digest": sha256(payload), "X-Payload-Bytes": str(len(payload))}
            address = r.fields.get("IP-address", "-")
            if address not in ("-", "0.0.0.0"):
                head["WARC-IP-Address"] = address
            if "x-refers-to" in fields:
                head |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To": fields["x-refers-to"], "WARC-Refers-To-Target-URI": fields.get("x-refers-to-url", "-"), "WARC-Refers-To-Date": iso_date(r.fields.get("Archive-date", "")), "WARC-Truncated": "length"}
                block = http
            if "x-page-id" in fields:
                head["X-Page-Id"] = fields["x-page-id"]
        head |= {"WARC-Block-Digest": sha256(block), "Content-Length": str(len(block))}
        record = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += packer.compress(record) + packer.flush()
    return bytes(out)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; digests and lengths are checked."""
    while data:
        z = zlib.decompressobj(31)
        record, data = z.decompress(data), z.unused_data
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or sha256(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
        yield fields, block


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): pages, each with the page that stores its payload if another does.

    Each row is decided by its own payload's digest and page_id, so rows that share an id may differ.
    """
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(data) >= REVISIT_BYTES, F.unhex(F.sha2(data, 256))).alias("sha"))
    first = rows.where("sha is not null").groupBy("sha").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("k"))
    first, _ = save(first.where("k > 1 and first is not null").select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "payloads")
    met = spread_join(rows, first, "sha", "url", "left", SMALL)
    other = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return met.select("page_id", "url", "html", F.when(other, F.col("refers_to")).alias("refers_to"), F.when(other, F.col("refers_url")).alias("refers_url"))


def _pack(held: list[tuple], place: str) -> pa.RecordBatch:
    key = hashlib.sha256(repr([place, *((u, h, hashlib.sha256(p).digest()) for u, h, p in held)]).encode()).hexdigest()[:16]
    version = 1 + int(key, 16) % 2
    return pa.record_batch([pa.array([f"{key}.arc"]), pa.array([version], pa.int32()), pa.array([write_arc(f"{key}.arc", held, version)], pa.binary())], ["name", "version", "arc"])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, refers_to, refers_url) rows to archives of about ``ARCHIVE_BYTES``, named by place and content."""
    held, size, done, task = [], 0, 0, TaskContext.get().partitionId()
    for batch in batches:
        for page, url, html, refers, refers_url in zip(*batch.columns, strict=True):
            payload = (html.as_py() or "").encode()
            head = {"X-Page-Id": page.as_py()} if page.is_valid else {}
            if refers.is_valid:
                head |= {"X-Refers-To": refers.as_py(), "X-Refers-To-Url": _url(refers_url.as_py())}
            held.append((url.as_py(), head, payload))
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield _pack(held, f"{task}.{done}")
                held, size, done = [], 0, done + 1
    if held:
        yield _pack(held, f"{task}.{done}")


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, arc in zip(batch.column("name").to_pylist(), batch.column("arc"), strict=True):
            stem = name.removesuffix(".arc")
            yield pa.record_batch([pa.array([f"{stem}.warc.gz"]), pa.array([convert(f"{stem}.arc", arc.as_py())], pa.binary())], ["name", "warc"])


def archives(pages: DataFrame) -> DataFrame:
    """(name, version, arc): legacy archives of the pages."""
    return marked(pages).mapInArrow(lean(_write), "name string, version int, arc binary")


def converted(arcs: DataFrame) -> DataFrame:
    """(name, warc) of ARC archives (name, arc)."""
    return arcs.select("name", "arc").mapInArrow(lean(_convert), "name string, warc binary")


def rewritten(pages: DataFrame) -> DataFrame:
    """(name, warc): both steps in one Python worker, archive by archive."""
    return marked(pages).mapInArrow(lean(lambda batches: _convert(_write(batches))), "name string, warc binary")


def records(warcs: DataFrame) -> DataFrame:
    """Response, resource and revisit records of WARC archives, one row each."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "payload"]

    def run(batches):
        for batch in batches:
            for warc in batch.column(0):
                rows = []
                for f, block in read_warc(warc.as_py()):
                    if f["WARC-Type"] not in ("response", "revisit", "resource"):
                        continue
                    payload = block if f["WARC-Type"] == "resource" else http_parts(block)[2] if f["WARC-Type"] == "response" else None
                    if payload is not None and sha256(payload) != f["WARC-Payload-Digest"]:
                        raise ValueError(f"payload of {f['WARC-Record-ID']} is damaged")
                    page, refers = (int(f[k]) if k in f else None for k in ("X-Page-Id", "X-Refers-To"))
                    rows.append((page, int(f["X-Payload-Bytes"]), f["WARC-Payload-Digest"].partition(":")[2], f["WARC-Type"], refers, f["WARC-Target-URI"], f["WARC-Record-ID"], payload))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return warcs.select("warc").mapInArrow(lean(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    stored, _ = save(rewritten(table(spark, sf_dir, "pages")), "warc")
    return records(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
