"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing. Each page becomes a response record, or a revisit of the response with the equal
payload. Responses carry an HTTP head and the payload, in chunked transfer framing if it is longer
than one chunk. A record block longer than `segment_bytes` is cut: the first part stays a
response record with segment number 1, the others are continuation records that name the origin,
their number and, the last, the total length. Every record is a gzip member of its own. A row
holds a few MB of members and Spark's text sink puts the rows into files: gzip members of under
16 MB end in a zero byte, which is left to the sink as its line end, so the files are valid and
go to any store that Spark can write.

Reading. Every member begins with the same ten bytes (member_start), which serve as the line separator of
Spark's text source: files of any size are split, and a task holds one member at a time. Archives of
other writers, whose members begin otherwise, are read file by file. Records are parsed once, into
a table. Whole records are decoded where they are read; segments meet by origin identifier, are
ordered by number, checked against the total length and joined. Then the transfer framing is undone.

Defined results: a null payload is empty; a null URL gives no target; control characters and
spaces in URLs are percent-encoded; rows that repeat an id and payload are all responses, and
revisits refer to the record of the first of them; a group of segments with gaps, without its first
one, with repeats of a number or a wrong total length gives one row with a null payload and
`complete` false (its record is the origin named by its segments); chunked framing that is broken
gives a null payload. Other columns are ignored. An empty table writes no record and reads as an
empty table.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import new_path, written

#: Field names and line forms of the file format (fixed values).
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

SCHEMA = "record_id string, record_type string, page_id long, url string, refers_to long, declared_digest string, declared_bytes long, origin string, segment int, total_bytes long, block binary"


def roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int) -> DataFrame:
    """page_id, url, payload, digest, ordinal, winner (the page whose response stands for it, or null), winner_ordinal (of its first row)."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("ordinal", F.monotonically_increasing_id())  # the same in each reading of a table's files
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long"), "check": F.xxhash64("payload")})
    keys = ["digest", "bytes", "check"]
    groups = rows.where(F.col("bytes") >= min_revisit).groupBy(*keys).agg(F.max(F.struct("page_id", -F.col("ordinal"))).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select(*keys, F.col("top.page_id").alias("winner"), (-F.col("top.col2")).alias("winner_ordinal"))
    return rows.join(written(groups, "warc-copies", small=True), keys, "left").drop("check")


def _quoted(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _head(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields] + [f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + END


def chunked(payload: bytes, chunk: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + chunk]), p) for i in range(0, len(payload), chunk)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if the framing is broken."""
    at, parts = 0, []
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, begin = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[begin + n : begin + n + 2] != b"\r\n":
            return None
        parts.append(body[begin : begin + n])
        at = begin + n + 2
    return None


def page_records(page_id: int | None, row: int, url: str | None, payload: bytes, digest: str, winner: int | None, winner_row: int | None, segment_bytes: int, chunk: int) -> list[bytes]:
    """The records of one page, uncompressed."""
    name = "null" if page_id is None else str(page_id)
    urn = f"<urn:page:{name}:{row}>"
    common = [("WARC-Date", "2026-01-01T00:00:00Z")] + ([("WARC-Target-URI", _quoted(url))] if url is not None else [])
    mark = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if winner is not None and winner != page_id:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", urn), *common, *mark, ("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{winner}:{winner_row}>"), ("Content-Type", "application/http; msgtype=response")]
        return [_head(fields, block) + block + END]
    if len(payload) > chunk:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = []
    for k, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", urn if k == 1 else f"<urn:page:{name}:{row}:{k}>"), *common]
        if k == 1:
            fields += [*mark, ("Content-Type", "application/http; msgtype=response")]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", str(k)))
        if k > 1:
            fields.append(("WARC-Segment-Origin-ID", urn))
        if 1 < k == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_head(fields, part) + part + END)
    return out


def member_start(level: int = 2) -> bytes:
    """The ten bytes with which every member begins that is written at that level."""
    return _member(b"", level)[:10]


def _member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, segment_bytes: int = 32 << 10, chunk: int = 8 << 10, level: int = 2, row_bytes: int = 4 << 20) -> str:
    """Writes files of gzip members under path (by default in the shared folder), named as Spark's text sink names them; returns the path."""
    if not 256 <= segment_bytes < 15 << 20:
        raise ValueError("segment_bytes must lie between 256 bytes and 15 MB")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        held = 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                page_id, url, payload, digest, winner, winner_row, ordinal = row
                for r in page_records(page_id, ordinal, url, payload, digest, winner, winner_row, segment_bytes, chunk):
                    members.append(_member(r, level))
                    held += len(members[-1])
                if held >= row_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]])], ["value"])
                    members, held = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]])], ["value"])

    path = path or new_path(pages.sparkSession, "warc")
    rows = roles(pages, id_col, url_col, payload_col, min_revisit).select("page_id", "url", "payload", "digest", "winner", "winner_ordinal", "ordinal")
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 4).text(path)
    return path


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts, start = zlib.decompressobj(31), [], at
        while not z.eof and at < len(view):
            parts.append(z.decompress(view[at : at + step]))
            at += step
        if not z.eof:
            raise ValueError(f"gzip member at byte {start} is cut off")
        at = min(at, len(view)) - len(z.unused_data)
        yield b"".join(parts)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """The fields (names in lower case) and block of a record."""
    end = record.find(END)
    lines = record[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    n = int(fields["content-length"])
    block = record[end + 4 : end + 4 + n]
    if len(block) != n:
        raise ValueError("a record is shorter than its Content-Length")
    return fields, block


def _page(urn: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?\d+)", urn or "")
    return int(m[1]) if m else None


_KINDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total_bytes", pa.int64()), ("block", pa.binary())])


def _row(record: bytes) -> tuple:
    f, block = parsed(record)
    digest = f.get("warc-payload-digest", "")
    length = re.search(rb"\r\ncontent-length: *(\d+)", block[:4096].lower()) if f["warc-type"] == "revisit" else None
    number = lambda name: int(f[name]) if name in f else None
    return (
        f["warc-record-id"],
        f["warc-type"],
        _page(f["warc-record-id"]),
        f.get("warc-target-uri"),
        _page(f.get("warc-refers-to")),
        base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None,
        int(length[1]) if length else None,
        f.get("warc-segment-origin-id"),
        number("warc-segment-number"),
        number("warc-segment-total-length"),
        block,
    )


def _held(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS.types, strict=True)], schema=_KINDS)


def read_archives(spark: SparkSession, path: str, level: int | None = 2) -> DataFrame:
    """The records of all files under path, as they stand (SCHEMA).

    level: at which the members were written, or None for archives whose members begin in several
    ways; those are read a file at a time.
    """
    member = None if level is None else member_start(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                if not data:  # before the first separator of a file
                    continue
                for record in members(data if member is None else member + data):
                    rows.append(_row(record))
                    held += len(rows[-1][-1])
                    if held > 8 << 20:
                        yield _held(rows)
                        rows, held = [], 0
        if rows:
            yield _held(rows)

    if member is None:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
    pieces = spark.read.option("lineSep", member.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return pieces.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA)


def http_payload(block: bytes | None) -> bytes | None:
    """The payload of an HTTP response without its head and transfer framing."""
    if block is None or (end := block.find(END)) < 0:
        return None
    head, body = block[:end].lower(), block[end + 4 :]
    return unchunked(body) if re.search(rb"\r\ntransfer-encoding: *chunked", head) else body


_FIELDS = ["record_id", "page_id", "url", "record_type", "refers_to", "declared_digest", "declared_bytes"]


def reassembled(records: DataFrame) -> DataFrame:
    """One row per origin of segments: the fields of its first segment and block (null if not complete)."""
    have = [f for f in _FIELDS if f in records.columns]

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by("segment")
        numbers, total = g["segment"].to_pylist(), [t for t in g["total_bytes"].to_pylist() if t is not None]
        block = b"".join(g["block"].to_pylist())
        good = numbers == list(range(1, len(numbers) + 1)) and total[-1:] == [len(block)] and len(total) == 1
        first = g.slice(0, 1).select(have)
        if numbers[0] != 1:  # what the lost first segment said is not known
            origin = g["origin"][0].as_py()
            known = {"record_id": origin, "page_id": _page(origin), "record_type": "response"}
            known |= {c: g[c][0].as_py() for c in have if c == "url"}
            first = pa.table([pa.array([known.get(c)], first.schema.field(c).type) for c in have], schema=first.schema)
        return first.append_column(pa.field("block", pa.binary()), pa.array([block if good else None], pa.binary()))

    parts = records.where("segment is not null").select(F.coalesce("origin", "record_id").alias("origin"), "segment", "total_bytes", *have, "block")
    schema = T.StructType([records.schema[f] for f in [*have, "block"]])
    return parts.groupBy("origin").applyInArrow(run, schema)


def responses(spark: SparkSession, path: str, level: int | None = 2) -> DataFrame:
    """One row per page of the archives: record_id, page_id, url, record_type, refers_to, declared_digest, declared_bytes, complete, payload (null for revisits)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if kind == "revisit" else http_payload(block) for kind, block in zip(b.column("record_type").to_pylist(), b.column("block").to_pylist(), strict=True)]
            yield b.set_column(b.schema.get_field_index("block"), "block", pa.array(out, pa.binary()))

    records = written(read_archives(spark, path, level), "warc-records")
    whole = records.where("segment is null").select(*_FIELDS, "block")
    done = whole.unionByName(reassembled(records)).mapInArrow(decode, whole.schema)
    return done.withColumnRenamed("block", "payload").withColumn("complete", (F.col("record_type") == "revisit") | F.col("payload").isNotNull())
