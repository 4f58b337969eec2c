"""Legacy web archives: ARC files written, parsed by their declared lengths, and made WARC.

`to_arc` and `to_warc` write gzip text files with Spark's own writer: a record is one row, and
the line separator of the writer is the record separator of the format. `arc_records` and
`warc_records` read whole archives (one row per file, as large as one task of the writer) and
walk through them by declared lengths, so payloads may hold anything, header lines included.

ARC header lines depend on the version block that opens each file: version 1 has URL, IP,
date, type and length; version 2 adds result code, checksum, location, offset and file name.
The fields are counted from the right, as URLs may hold blanks.

Conversion: the WARC id is a UUID made from the archive's name and the record's offset, the
14-digit date becomes ISO, the type is warcinfo for the version block, response for HTTP and
resource for the rest, and digests are base32 SHA-1. Of records with equal payloads the one
with the smallest page id stays a response; the others become revisits that keep their HTTP
head. Minima are taken by digest, with map-side combine; a payload that a third of all pages
share is a skewed join key of small rows. Blocks are compressed while they are shuffled.

Defined cases: NULL html is an empty payload, equal to other empty ones. A NULL page id comes
after all others. Rows that repeat an id with one payload are a response and revisits of it.
A header line that cannot be read is skipped up to the next line; a record cut off by the end
of its file keeps what is there and is marked truncated. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import modest_batches, shared_folder, written

CRAWLED = "20240101000000"
ADDRESS = "0.0.0.0"

# Fixed values of the two formats.
ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
              2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
                 "Filename Archive-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ------------------------------------------------------------------------ ARC

def _arc_line(version: int, url: str, mime: str, length: int, name: str, status: str) -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}" if ord(m[0]) < 128 else m[0], url) or "-"
    more = f" {status} - - 0 {name}" if version == 2 else ""
    return f"{url} {ADDRESS} {CRAWLED} {mime}{more} {length}\n".encode()


def _arc_rows(versions: tuple[int, ...]):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]
        name = f"pages-{part:06d}.arc"
        block = f"{version} 0 bioscore\n{ARC_FIELDS[version]}\n".encode()
        first = _arc_line(version, f"filedesc://{name}", "text/plain", len(block), name, "200")
        # the writer ends every row with the line feed that parts records
        yield pa.record_batch([pa.array([first + block], pa.binary())], ["record"])
        for batch in batches:
            out = []
            for page, url, source in zip(*(batch.column(n).to_pylist()
                                           for n in ("page_id", "url", "html"))):
                payload = (source or "").encode("utf-8", "surrogatepass")
                named = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        f"{named}Content-Length: {len(payload)}\r\n\r\n").encode()
                line = _arc_line(version, url or "", "text/html", len(head) + len(payload), name,
                                 "200")
                out.append(line + head + payload)
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
    return run


def _save(records: DataFrame, folder: str, separator: str) -> None:
    """Bytes of each row and the separator, in gzip files."""
    (records.select(F.col("record").cast("string")).write.option("lineSep", separator)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(folder))


def to_arc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url",
           source: str = "html", versions: tuple[int, ...] = (1, 2)) -> None:
    """One archive per partition, of the versions in turn."""
    rows = modest_batches(pages).select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
                        F.col(source).alias("html"))
    _save(rows.mapInArrow(_arc_rows(versions), "record binary"), folder, "\n")


def _opened(content: bytes):
    plain = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=plain), 1 << 20) \
        if content[:2] == b"\x1f\x8b" else plain


def arc_entries(content: bytes):
    """(offset, version, fields by name, block, truncated) of every record of one archive."""
    stream, offset, version = _opened(content), 0, 1
    while True:
        line = stream.readline()
        if not line:
            return
        at, offset = offset, offset + len(line)
        text = line.decode("utf-8", "replace").strip()
        if not text:
            continue
        names = None
        described = at == 0 and text.startswith("filedesc://")      # later ones are pages
        if described:       # 5 or 10 fields tell the version of this line
            names = ARC_FIELDS[2 if len(text.split(" ")) >= 10 else 1].split(" ")
        names = names or ARC_FIELDS[version].split(" ")
        values = text.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit() or not values[2].isdigit():
            continue
        length = int(values[-1])
        block = stream.read(length)
        offset += len(block)
        if described:
            version = 2 if block[:1] == b"2" else 1
        yield at, version, dict(zip(names, values)), block, len(block) < length


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload; without a head all is payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block[:end + 4], block[end + 4:]) if end >= 0 else (block, b"")


def _header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name).encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def _page_of(head: bytes) -> int | None:
    value = _header(head, "X-Page-Id")
    return int(value) if value and re.fullmatch(r"-?\d+", value) else None


RECORD = ("record_id string, page_id bigint, digest string, bytes bigint, kind string, url string, "
          "address string, date string, mime string, truncated boolean, block binary")


def _arc_parsed(with_blocks: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                name = path.rpartition("/")[2]
                for at, version, fields, block, cut in arc_entries(content.as_py()):
                    head, payload = _split_http(block)
                    described = at == 0 and fields["URL"].startswith("filedesc://")
                    if described and not with_blocks:
                        continue
                    kind = "warcinfo" if described else "response" if head else "resource"
                    code = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}")
                    rows.append((f"urn:uuid:{code}", _page_of(head), base32_sha1(payload),
                                 len(payload), kind, fields["URL"], fields["IP-address"],
                                 fields["Archive-date"], fields["Content-type"], cut,
                                 zlib.compress(block, 1) if with_blocks else None))
                    size += len(rows[-1][-1] or b"")
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield _record_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _record_batch(rows)
    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 5, pa.bool_(),
             pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                           [f.split(" ")[0] for f in RECORD.split(", ")])


def arc_records(spark: SparkSession, folder: str, with_blocks: bool = True) -> DataFrame:
    """The records of all archives of a folder; blocks are zlib-compressed."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_arc_parsed(with_blocks), RECORD)


# ----------------------------------------------------------------------- WARC

def revisits(records: DataFrame) -> DataFrame:
    """record_id and first_id of the records that repeat the payload of another."""
    slim = written(records.where("kind <> 'warcinfo'")
                   .select("record_id", "page_id", "digest", "bytes"), "payloads")
    order = F.struct(F.col("page_id").isNull(), "page_id", "record_id")
    first = (slim.groupBy("digest", "bytes").agg(F.min(order).alias("m"), F.count("*").alias("n"))
             .where("n > 1").select("digest", "bytes", F.col("m.record_id").alias("first_id")))
    first = written(first, "firsts")
    return (slim.join(first, ["digest", "bytes"]).where("record_id <> first_id")
            .select("record_id", "first_id"))


def _warc_head(kind: str, identity: str, date: str, fields: list[tuple[str, str]],
               length: int) -> bytes:
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identity}>"), ("WARC-Date", stamp),
             *fields, ("Content-Length", str(length))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _warc_rows(batches):
    names = [f.split(" ")[0] for f in RECORD.split(", ")] + ["first_id"]
    for batch in batches:
        out = []
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            r = dict(zip(names, row))
            block = zlib.decompress(r["block"])
            date = (r["date"] + "0" * 14)[:14]
            if r["kind"] == "warcinfo":
                out.append(_warc_head("warcinfo", r["record_id"], date, [
                    ("WARC-Filename", r["url"].partition("//")[2] + ".warc.gz"),
                    ("Content-Type", "application/warc-fields"),
                    ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")], len(block)) + block)
                continue
            head, _ = _split_http(block)
            kind = "revisit" if r["first_id"] else r["kind"]
            fields = [("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["address"]),
                      ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
            if r["first_id"]:
                block = head
                fields += [("WARC-Refers-To", f"<{r['first_id']}>"),
                           ("WARC-Profile", REVISIT_PROFILE)]
            fields += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
                       ("Content-Type", "application/http;msgtype=response" if head
                        else r["mime"])]
            if r["truncated"]:
                fields.append(("WARC-Truncated", "unspecified"))
            out.append(_warc_head(kind, r["record_id"], date, fields, len(block)) + block)
        yield pa.record_batch([pa.array(out, pa.binary())], ["record"])


def to_warc(spark: SparkSession, arc_folder: str, folder: str) -> None:
    """Convert all ARC files of a folder to WARC files in another."""
    again = written(revisits(arc_records(spark, arc_folder, with_blocks=False)), "revisits")
    rows = arc_records(spark, arc_folder).join(again, "record_id", "left")
    _save(rows.mapInArrow(_warc_rows, "record binary"), folder, "\r\n\r\n")


def warc_entries(content: bytes):
    """(header bytes, block) of every record of one WARC file, by declared lengths."""
    stream = _opened(content)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head = b""
        while line.strip():
            line = stream.readline()
            head += line
        yield head, stream.read(int(_header(head, "Content-Length") or 0))


def _warc_parsed(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, block in warc_entries(content.as_py()):
                kind = _header(head, "WARC-Type")
                if kind == "warcinfo":
                    continue
                http, payload = _split_http(block)
                digest = (_header(head, "WARC-Payload-Digest") or "").rpartition(":")[2]
                size = len(payload)
                if kind == "revisit":           # the payload is elsewhere; its head is here
                    size = int(_header(http, "Content-Length") or 0)
                elif digest != base32_sha1(payload):
                    raise ValueError(f"payload digest differs: {_header(head, 'WARC-Record-ID')}")
                rows.append((_header(head, "WARC-Record-ID"), _page_of(http), size, digest, kind,
                             _header(head, "WARC-Refers-To")))
            kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                  ["record_id", "page_id", "payload_bytes", "payload_digest",
                                   "record_type", "refers"])


def warc_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all archives."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    rows = files.mapInArrow(_warc_parsed, "record_id string, page_id bigint, payload_bytes bigint, "
                                          "payload_digest string, record_type string, "
                                          "refers string")
    rows = written(rows, "warc-records")
    whole = rows.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    return (rows.join(whole, "refers", "left")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def archived(pages: DataFrame, **columns) -> DataFrame:
    """Pages through ARC and WARC files and back: one row per page."""
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    to_arc(pages, arc, **columns)
    to_warc(spark, arc, warc)
    return warc_records(spark, warc)
