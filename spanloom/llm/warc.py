"""WARC archives: a writer with revisit records and a salvage reader.

Writing: pages whose payload (html as UTF-8) of at least LEAST_REVISIT bytes equals
another's by SHA-1 and length become revisits of the one with the largest id. Each task
writes its pages as gzip members, one record each, to archives of about ROLL bytes in a
folder that all tasks share; an archive appears under its final name only when it is
complete, and a task that runs again writes the same bytes to the same names.

Reading: every archive is walked member by member (or record by record where it is not
compressed). A record must start with a version line, hold exactly the length it states, and
match its block digest. After a failed check the reader searches for the next place where a
valid member or record starts, logs the bytes between as a quarantined gap with the reason,
and goes on; within a member it searches the inflated body for version lines in the same way.
Of a member of several records that is cut short, damaged or fails its checksum, records that
inflated whole and pass their checks stay (unless cut short, with a block digest), and the member
is logged as a gap from its start; a member of one record is quarantined whole. What follows
damage within one deflate stream can't be inflated.

Defined results: null html is an empty payload, and short payloads are always responses;
a null url is written as an empty one; pages with equal ids are records of their own, and
of those that share the largest id of a payload each is a response; a payload whose pages
all have null ids is never revisited; an empty table gives no archive and an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import spread_join

LEAST_REVISIT, ROLL, FEED = 1000, 4 << 20, 1 << 14
#: Fixed values of the format.
VERSION, MEMBER, END = b"WARC/1.1\r\n", b"\x1f\x8b\x08", b"\r\n\r\n"
VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_bytes(page_id, url: str | None, payload: bytes, sha1: bytes, refers_to) -> bytes:
    """A whole record; a revisit (refers_to given) holds the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = lambda d: "sha1:" + base64.b32encode(d).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", digest(sha1)),
        ("WARC-Block-Digest", digest(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[2:2] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(data: bytes, start: int = 0) -> tuple[dict, bytes, int]:
    """(headers in lower case, block, end) of the record at start; ValueError says what is wrong."""
    if not (version := VERSION_LINE.match(data, start)):
        raise ValueError("no version line")
    split = data.find(b"\r\n\r\n", version.end() - 2)
    if split < 0:
        raise ValueError("headers without end")
    headers = {}
    for line in data[version.end() : split].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not (length := headers.get("content-length", "")).isascii() or not length.isdigit():
        raise ValueError("no content length")
    begin, end = split + 4, split + 4 + int(length)
    if data[end : end + 4] != END:
        raise ValueError("record cut short or length wrong")
    block = data[begin:end]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest.upper():
        raise ValueError("block digest differs")
    return headers, block, end + 4


def inflated(data: bytes, start: int) -> tuple[bytes, int, str]:
    """What the gzip member at start holds as far as it inflates, its end (that of the input
    read, if it breaks off) and what is wrong with it, empty if nothing. Fed in small pieces,
    so that what follows the member is never copied whole."""
    inflate, view, parts, at = zlib.decompressobj(31), memoryview(data), [], start
    while not inflate.eof and at < len(data):
        before = inflate.copy()
        try:
            parts.append(inflate.decompress(view[at : at + FEED]))
        except zlib.error as e:
            # a bad piece again, byte by byte, for what comes out before the damage
            for i in range(at, min(at + FEED, len(data))):
                try:
                    parts.append(before.decompress(view[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(parts), at, f"member: {e}"
        at += FEED
    if not inflate.eof:
        return b"".join(parts), len(data), "member cut short"
    return b"".join(parts), min(at, len(data)) - len(inflate.unused_data), ""


def parse_plain(data: bytes):
    """('record', start, end, headers, block) and ('gap', start, end, reason, None) of the body
    of a member, in order of its bytes."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            headers, block, end = parse_record(data, at)
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            line = VERSION_LINE.search(data, at + 1)
            at = line.start() if line else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        yield "record", at, end, headers, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, None


def next_candidate(data: bytes, start: int) -> int:
    """The next place that looks like a member or a version line, or the end."""
    member = data.find(MEMBER, start)
    line = VERSION_LINE.search(data, start)
    return min(x for x in (member if member >= 0 else len(data), line.start() if line else len(data)))


def salvage(data: bytes):
    """('record', start, end, headers, block) and ('gap', start, end, reason, None), in order of
    bytes. Places are those of the file; what lies in a member has the member's, and the reason of
    a gap within a member says where in its body it is. Of a member that breaks off, records that
    inflated whole come with the member's start and the place where the search goes on."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        wrong, records, lost = "", [], []
        if data.startswith(MEMBER, at):
            body, end, wrong = inflated(data, at)
            if not wrong and not body:
                records = None  # an empty member is whole
            else:
                for row in parse_plain(body):
                    (records if row[0] == "record" else lost).append(row)
            if not wrong and lost and not records:
                wrong = lost[0][3]
            if wrong and not lost and len(records) == 1:
                records = []  # a member of one record stands or falls with its checks
            if wrong.startswith("member:"):  # where the damage began is open, so only digests vouch for a record
                records = [x for x in records if x[3].get("warc-block-digest", "").startswith("sha1:")]
        else:
            try:
                headers, block, end = parse_record(data, at)
                records = [("record", at, end, headers, block)]
            except ValueError as e:
                wrong = str(e)
        if wrong and not records:
            if gap is None:
                gap, reason = at, wrong
            at = next_candidate(data, at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, reason, None
            gap = None
        if wrong:
            end = next_candidate(data, at + 1)
        for _, a, b, headers, block in records or []:
            yield "record", at, end, headers, block
        for _, a, b, why, _ in lost if not wrong else []:
            yield "gap", at, end, f"{why} (bytes {a} to {b} of the member's {len(body)})", None
        if wrong:
            gap, reason = at, wrong
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason, None


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha1 (hex), length, refers_to (null for responses)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("length"))
    leaders = own.filter(F.col("length") >= LEAST_REVISIT).groupBy("sha1", "length").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("leader")), F.col("leader"))
    return spread_join(own, leaders, ["sha1", "length"], "left").select("page_id", "url", "html", "sha1", "length", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, level: int = 1) -> None:
    """Write all pages as .warc.gz archives to a folder that driver and executors share.

    A task's pages are sorted by all that a record holds: rows come out of a shuffle in any order, and
    a task that runs again must cut the same archives."""

    def run(batches):
        files, root = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
        files.create_dir(root)
        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0

        def roll():
            nonlocal number, members, size
            if members:
                name = f"{root}/part-{part:05d}-{number:05d}.warc.gz"
                hidden = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(hidden, compression=None) as out:
                    out.write(b"".join(members))
                files.move(hidden, name)
                number, members, size = number + 1, [], 0

        for batch in common.slices(batches, "html"):
            for page_id, url, html, sha1, refers_to in zip(*(batch.column(i).to_pylist() for i in (0, 1)), common.texts_of(batch, "html"), *(batch.column(i).to_pylist() for i in (3, 4)), strict=True):
                members.append(gzip_member(record_bytes(page_id, url, html, bytes.fromhex(sha1), refers_to), level))
                size += len(members[-1])
                if size >= ROLL:
                    roll()
        roll()
        yield from ()

    ordered = roles(pages).select("page_id", "url", "html", "sha1", "refers_to").sortWithinPartitions("page_id", "sha1", "url")
    ordered.mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()


LOG = "archive string, kind string, start bigint, stop bigint, reason string, record_type string, record_id string, url string, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives in a folder, one row each.

    payload_bytes and payload_digest (hex SHA-1) are of the full payload: of a response
    computed, of a revisit as its headers state. digest_ok: the stated digest fits. An archive is one
    value of a task: of 2 GiB at most, and several times its size in memory; `write` cuts at ROLL bytes."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, held = [], 0
                for kind, start, stop, info, block in salvage(content.as_buffer().to_pybytes()):
                    row = dict.fromkeys(x.split()[0] for x in LOG.split(", ")) | {"archive": path, "kind": kind, "start": start, "stop": stop}
                    if kind == "gap":
                        row["reason"] = info
                    else:
                        row |= {"record_type": info.get("warc-type"), "record_id": info.get("warc-record-id"), "url": info.get("warc-target-uri"), "refers_to": info.get("warc-refers-to")}
                        head, _, payload = block.partition(b"\r\n\r\n")
                        scheme, _, stated = info.get("warc-payload-digest", "").partition(":")
                        hexed = base64.b32decode(stated).hex() if scheme == "sha1" and len(stated) == 32 else None
                        if row["record_type"] == "revisit":
                            length = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", head)
                            row |= {"payload_bytes": int(length[1]) if length else None, "payload_digest": hexed}
                        else:
                            own = hashlib.sha1(payload).hexdigest()
                            row |= {"payload_bytes": len(payload), "payload_digest": own, "digest_ok": hexed is None or own == hexed, "payload": payload if payloads else None}
                            held += len(payload) if payloads else 0
                    out.append(row)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in LOG.split(", "))])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content").mapInArrow(run, LOG)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, one row a record."""
    spark = pages.sparkSession
    folder = common.new_folder(spark, "warc")
    kind = dict(pages.dtypes)["page_id"]
    write(pages, folder)
    number = lambda c: F.nullif(F.regexp_extract(F.col(c), r"^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    if pages.isEmpty():  # no archive, no folder
        return spark.createDataFrame([], f"page_id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}, digest_ok boolean")
    return read(spark, folder, payloads=False).filter("kind = 'record'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "digest_ok")
