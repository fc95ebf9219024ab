"""WARC archives: writing with segmentation, reading with reassembly.

A page becomes a ``response`` record whose block is an HTTP answer in chunked framing. A block
above SEGMENT_BYTES is cut: later parts are ``continuation`` records that name the first one as
origin, number themselves and, in the last, state the total length. Pages with an equal payload
of at least REVISIT_BYTES become ``revisit`` records of the smallest page id.

Files are written by Spark's text writer, one record a line with a blank line between records
as line separator, so a lost task leaves no half file behind.

Archives of other writers are read too: plain or gzip in any number of members, records of other
types beside pages, and damage. What is cut short or has no readable head comes back as a row of
type DAMAGED, and reading goes on with the next record.
"""

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.llm.common import rows_of

REVISIT_BYTES = 100
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 4 * 1024
FILE_RECORDS = 1000  # a file is held whole by the task that reads it: 33 MB at most

END = b"\r\n\r\n"
DAMAGED = "damaged"
PAGES = ("response", "revisit", DAMAGED)  # other types hold no page
NEXT = re.compile(rb"(?:\A|\r?\n\r?\n)(?=WARC/\d+\.\d+\r?\n)")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload, size=CHUNK_BYTES):
    """Chunked transfer framing of a payload."""
    parts = []
    for start in range(0, len(payload), size):
        piece = payload[start : start + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body):
    """The payload inside chunked framing; None where the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            return None
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block):
    """Payload of an HTTP answer, its framing removed; None where it is broken."""
    head, mark, body = block.partition(END)
    if not mark:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields, block):
    lines = [f"{name}: {value}" for name, value in fields if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + END + block


def _target(url):
    return None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%~")


def records_of(page, url, payload, digest, first, segment, first_url=None):
    """Records of one page, without the blank line after each."""
    name = f"<urn:uuid:{uuid.uuid4()}>"
    target = _target(url)
    shared = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Page-ID", page),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if first is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *shared]
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To-Page-ID", first),
            ("WARC-Refers-To-Target-URI", _target(first_url)),
            ("WARC-Refers-To-Date", DATE),
            ("WARC-Payload-Length", len(payload)),
        ]
        return [_record(fields, HTTP)]
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), *shared]
    if len(parts) > 1:
        fields.append(("WARC-Segment-Number", 1))
    out = [_record(fields, parts[0])]
    for number, part in enumerate(parts[1:], start=2):
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", name),
            ("WARC-Segment-Number", number),
        ]
        if number == len(parts):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(fields, part))
    return out


def write_archive(pages, path, segment=SEGMENT_BYTES):
    """Write a record for each row of ``pages`` (page_id, url, html) to a new folder.

    A null html is an empty payload, a null url or page_id has no header line. Among rows with
    equal payloads of REVISIT_BYTES or more, those with the smallest page_id are responses and
    the rest revisits; where all ids are null, all are responses. Repeated rows are written
    each. Further columns are ignored, whatever their names.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    copies = (
        rows.filter(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(
            F.min("page_id").alias("first"),
            F.min_by("url", "page_id").alias("first_url"),
            F.count("*").alias("n"),
        )
        .filter("n > 1")
        .select("digest", "first", "first_url")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    planned = rows.join(copies, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "html",
        "digest",
        refers.cast("string").alias("first"),
        F.when(refers.isNotNull(), F.col("first_url")).alias("first_url"),
    )

    def run(batches):
        for batch in rows_of(batches, 64):
            out = []
            for row in batch.to_pylist():
                payload = row["html"].encode()
                names = (row["page_id"], row["url"], payload, row["digest"], row["first"], segment)
                out += records_of(*names, row["first_url"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = planned.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string")).write.option(
        "lineSep", END.decode()
    ).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def unpacked(content):
    """Bytes of an archive file: of all its gzip members, as far as they are whole."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(content))
        except zlib.error:
            # what came before the damage, then the next member
            member = zlib.decompressobj(31)
            for byte in range(0, len(content), 4096):
                try:
                    parts.append(member.decompress(content[byte : byte + 4096]))
                except zlib.error:
                    break
            content = content[max(content.find(b"\x1f\x8b\x08", 1), 0) or len(content) :]
            continue
        content = member.unused_data
    return b"".join(parts)


def _head(lines):
    """Header fields by lower-case name; a line that begins with a blank continues the last."""
    fields, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += f" {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def number(text):
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def parse_file(content):
    """(header fields by lower-case name, block) of each record of an archive file.

    A record without a readable head, id, type or length, one that is cut short, and one after
    whose block no record or end of file comes, has the type DAMAGED, with the fields and the
    bytes there are up to the next line of a version after a blank line.
    """
    raw = unpacked(content)
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":  # more blank lines than there should be
            at += 2
            continue
        head = re.compile(rb"\r?\n\r?\n").search(raw, at)
        text = raw[at : head.start()] if head and raw.startswith(b"WARC/", at) else b""
        fields = _head(text.decode("utf-8", "replace").splitlines()[1:])
        size = number(fields.get("content-length"))
        known = size is not None and {"warc-type", "warc-record-id"} <= fields.keys()
        if known and fields["warc-type"] == "continuation":
            known = {"warc-segment-origin-id", "warc-segment-number"} <= fields.keys()
        if known:
            start, stop = head.end(), head.end() + size
            after = raw[stop : stop + len(END)]
            if stop <= len(raw) and (after == END or after.strip() == b"" and stop + len(after) == len(raw)):
                yield fields, raw[start:stop]
                at = stop + len(after)
                continue
        following = NEXT.search(raw, at + 1)
        stop = following.start() if following else len(raw)
        yield fields | {"warc-type": DAMAGED}, raw[head.end() : stop] if text else raw[at:stop]
        at = following.end() if following else len(raw)


RECORD = (
    "origin string, segment int, total bigint, type string, page_id string, url string, "
    "digest string, refers_to string, refers_to_uri string, length bigint, block binary"
)


def read_segments(spark, path):
    """A row for each record of the archives under ``path``, in RECORD's columns.

    ``segment`` is null for records that are whole, ``origin`` is the id of the first segment.
    A file is held whole by its task.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [part.split()[0] for part in RECORD.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def rows(content):
        for f, block in parse_file(content):
            damaged = f["warc-type"] == DAMAGED
            yield (
                f.get("warc-segment-origin-id", f.get("warc-record-id")),
                None if damaged else number(f.get("warc-segment-number")),
                number(f.get("warc-segment-total-length")),
                f["warc-type"],
                f.get("warc-page-id"),
                f.get("warc-target-uri"),
                (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                f.get("warc-refers-to-page-id"),
                f.get("warc-refers-to-target-uri"),
                number(f.get("warc-payload-length")),
                block,
            )

    def batch_of(held):
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    def run(batches):
        held = []
        for batch in batches:
            for content in batch.column("content"):
                for row in rows(content.as_py()):
                    held.append(row)
                    if len(held) == 128:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return files.mapInArrow(run, RECORD)


def agrees(stated, payload):
    """Whether a payload has the stated digest; one of another algorithm, or none, tells nothing."""
    kind, mark, value = (stated or "").partition(":")
    if stated and not mark:
        return value == "" and hashlib.sha256(payload).hexdigest() == kind.lower()
    if kind.lower() != "sha1":
        return True
    own = hashlib.sha1(payload)
    return value.lower() == own.hexdigest() or value.upper() == base64.b32encode(own.digest()).decode()


def read_archive(spark, path):
    """Responses and revisits under ``path`` with their payloads put together, and damaged records.

    Columns: page_id, url, record_type, refers_to, refers_to_uri (all as written, text), payload
    (null for a revisit), payload_digest and payload_length (of the full payload), intact. A
    response is intact if its segments are numbered 1 to n, have the stated total length, their
    framing is whole and the payload has the stated digest, if one is stated by SHA-256 or SHA-1;
    otherwise its payload is null or as found. Records of other types are left out. A damaged
    record is a row of type ``damaged``, not intact, without payload; page_id and url are null
    where its head is lost. Of a record whose first segment is lost no row is left but for
    damaged ones. Records of other writers have no page_id. Repeated files repeat rows.
    Continuations are grouped by the record they continue, so only cut records are shuffled.
    """
    segments = read_segments(spark, path)
    kept = ["type", "page_id", "url", "digest", "refers_to", "refers_to_uri", "length"]
    whole = segments.filter("segment is null").filter(F.col("type").isin(*PAGES))
    whole = whole.select(*kept, "block", F.lit(True).alias("joined"))
    parts = F.sort_array(F.collect_list(F.struct("segment", "block")))
    cut = (
        segments.filter("segment is not null")
        .groupBy("origin")
        .agg(
            *[
                F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
                for c in kept
            ],
            F.max("total").alias("total"),
            F.max("segment").alias("top"),
            F.count("*").alias("n"),
            F.countDistinct("segment").alias("kinds"),
            F.sum(F.octet_length("block")).alias("size"),
            parts.alias("parts"),
        )
        .filter(F.col("type").isin(*PAGES))  # null if the first segment is lost, and with it the page
        .select(
            *kept,
            "parts",
            F.expr("n = top and kinds = n and size <=> total").alias("joined"),
        )
    )

    def decode(blocks_of):
        def run(batches):
            for batch in rows_of(batches, 64):
                rows = batch.to_pylist()
                payloads, digests, lengths, intact = [], [], [], []
                for row in rows:
                    payload = None
                    if row["type"] == "response" and row["joined"]:
                        payload = payload_of(blocks_of(row))
                    found = row["digest"] if payload is None else hashlib.sha256(payload).hexdigest()
                    payloads.append(payload)
                    digests.append(found)
                    lengths.append(row["length"] if payload is None else len(payload))
                    intact.append(
                        row["type"] == "revisit" or payload is not None and agrees(row["digest"], payload)
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"),
                        batch.column("url"),
                        batch.column("type"),
                        batch.column("refers_to"),
                        batch.column("refers_to_uri"),
                        pa.array(payloads, pa.binary()),
                        pa.array(digests, pa.string()),
                        pa.array(lengths, pa.int64()),
                        pa.array(intact, pa.bool_()),
                    ],
                    names=RESULT,
                )

        return run

    return whole.mapInArrow(decode(lambda row: row["block"]), RESULT_DDL).unionByName(
        cut.mapInArrow(
            decode(lambda row: b"".join(part["block"] for part in row["parts"])), RESULT_DDL
        )
    )


RESULT_DDL = (
    "page_id string, url string, record_type string, refers_to string, refers_to_uri string, payload binary, "
    "payload_digest string, payload_length bigint, intact boolean"
)
RESULT = [part.split()[0] for part in RESULT_DDL.split(", ")]
