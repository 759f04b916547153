"""Legacy ARC archives, converted to WARC.

ARC files (versions 1 and 2) are read by their version-specific header lines and
declared lengths; each record gets a WARC identifier, timestamp, type and
digests, and records whose payload another one holds already become revisits.
Archives are written by Spark's text sink and read by its ``binaryFile`` source,
so they may lie in any store that Spark reaches; an archive is one task's output
and the unit of parsing, which streams through it.

Every file below the folder is an archive, whatever its name (names that begin with
a dot or an underscore are no archives to Spark).  A record whose header line or
declared length is wrong is kept as a row of the kind ``error`` with its header
line and the reason, and reading goes on at the next line that is a header.

Defined results: a null payload is empty; a null url is ``urn:none``; white
space and other than printable ASCII in urls is percent-encoded; null keys are
kept; repeated rows are records of their own (of equal ones the last in the
archives is the response); an empty table gives no records; payloads may hold
any bytes, line breaks and header lines of archives too, and are as long as an
archive may be (2 GB, Spark's bound for a value); a date of fewer than 14 digits
has its missing months and days as 01, the rest as 00; columns of the input other
than key, url and payload are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake.session import discard, scratch, written

# Header fields of ARC records, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Revisits of up to so many rows are broadcast to the converter (some 100 bytes each).
BROADCAST_REVISITS = 200_000
BATCH_BYTES = 4 << 20
KEY_FIELD, REFERS_FIELD = b"X-Record-Key", "X-Refers-To-Record-Key"


def _safe(url: str | None) -> str:
    if not url:
        return "urn:none"
    if url.isascii() and url.isprintable() and " " not in url:
        return url
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


# ---- writing ARC ------------------------------------------------------------

def write_arc(rows: DataFrame, path: str, *, key: str, url: str, payload: str, date: str = "19960101000000") -> None:
    """Write rows as ARC files below ``path``, those of even partitions in
    version 1, the others in version 2; payloads as HTTP responses."""
    source = rows.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{url}`").alias("url"),
                         F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"), F.spark_partition_id().alias("part"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            if not version:
                part = batch.column(3)[0].as_py()
                version, name = 1 + part % 2, f"part-{part}.arc"
                body = f"{version} 0 quorumlake\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
                middle = "" if version == 1 else f" 200 - - 0 {name}"
                out.append(f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body)
            for k, u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n" % len(p)
                if k is not None:
                    head += KEY_FIELD + b": " + k.encode() + b"\r\n"
                size = len(head) + 2 + len(p)
                middle = "" if version == 1 else f" 200 {hashlib.md5(p).hexdigest()} - 0 {name}"
                out.append(b"%s\n%s\r\n%s" % (f"{_safe(u)} 0.0.0.0 {date} text/html{middle} {size}".encode(), head, p))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    _write_text(source.mapInArrow(work, "value binary"), path, "\n")


def _write_text(rows: DataFrame, path: str, sep: str) -> None:
    """Bytes of each row and the separator, gzipped at the fastest level."""
    (rows.select(F.col("value").cast("string")).write.option("lineSep", sep).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


# ---- reading ----------------------------------------------------------------

def _stream(content: bytes) -> io.BufferedReader:
    if content[:2] == b"\x1f\x8b":
        return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 18)
    return io.BytesIO(content)


def _exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) < n:
        raise ValueError(f"archive ends {n - len(got)} bytes before the declared length")
    return got


#: The end of a header line, by version: from the address on, or from the date on.
_TAIL = {1: re.compile(rb" [0-9A-Fa-f.:]+ \d{4,14} \S+ (\d+)$"), 2: re.compile(rb" [0-9A-Fa-f.:]+ \d{4,14} \S+ \S+ \S+ \S+ \S+ \S+ (\d+)$")}


def _header(line: bytes, version: int | None) -> re.Match | None:
    """The declared length of a header line; before a version block, of any version."""
    return next((m for v in ((version,) if version else (1, 2)) if (m := _TAIL[v].search(line))), None)


class _Source:
    """A stream whose last bytes can be put back."""

    def __init__(self, f):
        self.f, self.held = f, io.BytesIO()

    def read(self, n: int) -> bytes:
        got = self.held.read(n)
        return got + self.f.read(n - len(got)) if len(got) < n else got

    def readline(self) -> bytes:
        got = self.held.readline()
        return got if got.endswith(b"\n") else got + self.f.readline()

    def back(self, data: bytes) -> None:
        self.held = io.BytesIO(data + self.held.read())


def arc_records(f) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(header fields, content, error) of each record of one ARC file; the version
    block at the start says which fields a header line has.  A record that cannot
    be read has its line as URL, its content up to the next header, and the reason."""
    version, f = None, _Source(f)
    while line := f.readline():
        head, reason, content = line.rstrip(b"\r\n"), None, b""
        if not head.strip():
            continue
        found = _header(head, None if head.startswith(b"filedesc:") else version)
        if found is None:
            reason = "no header line"
        else:
            content = f.read(int(found[1]))
            after = f.readline()
            if len(content) < int(found[1]):
                reason = f"archive ends {int(found[1]) - len(content)} bytes before the declared length"
            elif head.startswith(b"filedesc:"):
                first = content.split(b" ", 1)[0]
                version = int(first) if first in (b"1", b"2") else None
                reason = None if version else "unknown version"
            elif version is None:
                reason = "an ARC file begins with its version block"
            elif after.strip() and not (content.endswith(b"\n") and _header(after.rstrip(b"\r\n"), version)):
                reason = "no record begins after the declared length"
            f.back(content + after if reason else after)
        if reason is None:
            # blanks may stand in the url, which comes first
            yield dict(zip(ARC_FIELDS[version], head.decode("latin-1").rsplit(" ", len(ARC_FIELDS[version]) - 1))), content, None
            continue
        rest = []  # what lies before the next header
        while (line := f.readline()) and not _header(line.rstrip(b"\r\n"), version):
            rest.append(line)
        f.back(line)
        yield {"URL": head.decode("latin-1")}, b"".join(rest), reason


def warc_records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of one WARC file."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record begins with its version")
        head = {}
        while (line := f.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, _exactly(f, int(head["content-length"]))


def http_parts(block: bytes) -> tuple[bytes, dict[bytes, bytes], bytes]:
    """(head, its fields by lower-case name, payload) of an HTTP message."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict((a.strip().lower(), b.strip()) for a, _, b in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    return head + mark, fields, payload


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weigh: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded size; weigh: the column that holds most bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[weigh] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _stamp(date: str) -> str:
    """A WARC date from up to 14 digits."""
    d = date + "00000101000000"[len(date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


PARSED = "place string, key string, kind string, uri string, stamp string, ip string, mime string, digest string, payload_bytes long, reason string, head binary, payload binary"


def parse_arc(spark: SparkSession, path: str, *, bodies: bool = True) -> DataFrame:
    """Records of the ARC files below ``path``: place (archive and number of the
    record), key, kind (WARC type, or error), uri, stamp, ip, mime, digest (SHA-1 of
    the payload, hex), payload_bytes, reason (of an error), head (of HTTP) and payload."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    types = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for p, content in zip(batch.column(0), batch.column(1)):
                name = p.as_py()
                for n, (h, block, reason) in enumerate(arc_records(_stream(content.as_buffer()))):
                    url, head, fields, payload = h["URL"], b"", {}, block
                    kind, mime = "resource", h.get("Content-type")
                    if reason:
                        kind = "error"
                    elif url.startswith("filedesc:"):
                        kind, mime = "warcinfo", "application/warc-fields"
                        payload = f"software: quorumlake\r\nformat: WARC File Format 1.1\r\ndescription: converted from {url[11:]}".encode()
                    elif block.startswith(b"HTTP/"):
                        kind, mime = "response", "application/http; msgtype=response"
                        head, fields, payload = http_parts(block)
                    elif url.startswith("dns:"):
                        mime = "text/dns"
                    k = fields.get(KEY_FIELD.lower())
                    yield (f"{name}#{n:012d}", k.decode() if k else None, kind, url, None if reason else _stamp(h["Archive-date"]), h.get("IP-address"), mime,
                           hashlib.sha1(payload).hexdigest(), len(payload), reason, head if bodies else b"", payload if bodies else b"")

    return _archives(spark, path).mapInArrow(lambda b: _batches(rows(b), names, types, 11), PARSED)


def find_revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(place, refers_key, refers_place) of records whose payload the response
    with the largest key holds; only payloads of ``least`` bytes or more."""
    rank = F.struct(F.col("key").isNotNull().alias("has"), F.col("key").cast("decimal(38,0)").alias("number"), "key", "place")
    held = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least)).select("place", "key", "digest", "payload_bytes")
    first = held.groupBy("digest", "payload_bytes").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (held.join(first, ["digest", "payload_bytes"]).where("place <> top.place")
            .select("place", F.col("top.key").alias("refers_key"), F.col("top.place").alias("refers_place")))


def _record_id(place: Column) -> Column:
    """An identifier from the record's place in the archives (name-based)."""
    h = F.sha1(F.concat(F.lit("arc:"), place))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
                    F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def convert(spark: SparkSession, arc: str, warc: str, *, least: int = REVISIT_BYTES) -> DataFrame:
    """Convert the ARC files below ``arc`` to WARC files below ``warc``, and return
    (place, uri, reason) of the records that cannot be read."""
    index = written(parse_arc(spark, arc, bodies=False).drop("head", "payload"), "arc-index")
    revisits = written(find_revisits(index, least), "revisits")
    if revisits.count() <= BROADCAST_REVISITS:
        revisits = F.broadcast(revisits)
    rows = parse_arc(spark, arc).where("kind <> 'error'").join(revisits, "place", "left")
    again = F.col("refers_place").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    some = lambda test, value: F.when(test, value).otherwise(F.lit(""))
    info = F.col("kind") == "warcinfo"
    block = F.concat("head", F.when(again, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise(F.col("kind"))), line("WARC-Record-ID", _record_id(F.col("place"))),
        line("WARC-Date", F.col("stamp")), some(~info, line("WARC-Target-URI", F.col("uri"))), some(~info, line("WARC-IP-Address", F.col("ip"))),
        some(~info, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        some(again, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_place"))), line(REFERS_FIELD, F.coalesce("refers_key", F.lit(""))),
                             F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))),
        line("Content-Type", F.col("mime")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    _write_text(rows.select(F.concat(head.cast("binary"), block).alias("value")), warc, "\r\n\r\n")
    errors = written(index.where("kind = 'error'").select("place", "uri", "reason"), "errors")
    discard(index, revisits)
    return errors


READ = "key string, record_id string, record_type string, uri string, stamp string, refers_key string, digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, path: str, *, bodies: bool = True) -> DataFrame:
    """Records of the WARC files below ``path`` but for warcinfo: payload_bytes
    and digest (SHA-1, hex) are of the full payload, of revisits too."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.string()] * 7 + [pa.int64(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(1):
                for h, block in warc_records(_stream(content.as_buffer())):
                    if h["warc-type"] == "warcinfo":
                        continue
                    head, fields, payload = http_parts(block) if block.startswith(b"HTTP/") else (b"", {}, block)
                    said = h["warc-payload-digest"].partition(":")[2]
                    if h["warc-type"] == "revisit":
                        size = int(fields[b"content-length"])
                    else:
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != said:
                            raise ValueError(f"{h['warc-record-id']}: the payload does not have the digest {said}")
                    k = fields.get(KEY_FIELD.lower())
                    yield (k.decode() if k else None, h["warc-record-id"], h["warc-type"], h["warc-target-uri"], h["warc-date"],
                           h.get(REFERS_FIELD.lower()) or None, said, size, payload if bodies else None)

    return _archives(spark, path).mapInArrow(lambda b: _batches(rows(b), names, types, 8), READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc, key="page_id", url="url", payload="html")
    convert(spark, arc, warc)
    back = read_warc(spark, warc, bodies=False)
    return back.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
                       F.col("refers_key").cast("long").alias("refers_to"))


SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to from g
"""
