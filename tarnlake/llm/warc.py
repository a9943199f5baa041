"""WARC archives: a sink with revisit records and a splittable reader.

The sink deals one gzip member per record over Spark's text writer, so archives are committed like any
other output and need no file system access from Python.  The reader cuts files into byte ranges.  The
task of a range looks for the gzip magic, accepts a candidate only if it decodes to a WARC header, and
owns every record that starts inside its range, reading past the end of the range to finish the last one.

Cases: null payloads are empty payloads; a null id gives a record without id, which is always a response;
rows that repeat an id and its payload are all written in the same form; an empty table gives an archive
without records; a null or blank target is left out of the header; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import text_batches

MEMBER_SCHEMA = "member binary"
RECORD_SCHEMA = (
    "path string, offset long, next_offset long, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)
# fixed value: profile of revisit records
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_key, refers_to) of every page that repeats the payload of a page with a smaller id."""
    narrow = pages.filter(F.col("payload_size") >= min_bytes).select("page_id", "payload_key")
    first = (
        narrow.groupBy("payload_key").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"))
        .filter(F.col("refers_to") < F.col("_last")).drop("_last")
    )
    return narrow.join(first, "payload_key").filter(F.col("page_id") != F.col("refers_to")).distinct()


def write_warc(
    pages: DataFrame, path: str, page_id: Column, target: Column, payload: Column, min_bytes: int = 0, level: int = 6,
) -> None:
    """One record per row: the first of equal payloads of ``min_bytes`` or more in full, the others as revisits."""
    text_batches(pages.sparkSession, 1000)
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    keyed = pages.select(
        page_id.alias("page_id"), target.cast("string").alias("target"), body.alias("payload"),
        F.sha2(body, 256).alias("payload_key"), F.octet_length(body).alias("payload_size"),
    )
    rows = keyed.join(revisits(keyed, min_bytes), ["page_id", "payload_key"], "left").select(
        F.col("page_id").cast("string").alias("page_id"), "target", "payload", F.col("refers_to").cast("string").alias("refers_to")
    )
    members = rows.mapInArrow(_encoder(level), MEMBER_SCHEMA)
    # every member ends in a zero byte, which the writer puts back as its line separator
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _encoder(level: int):
    def encode(batches: Iterator) -> Iterator:
        import base64
        import hashlib
        import re
        import zlib

        import pyarrow as pa

        def gz(data: bytes) -> bytes:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            return z.compress(data) + z.flush()

        def uri(ident: str) -> str:
            return f"<urn:page:{ident}>"

        def record(ident, target, payload: bytes, refers) -> bytes:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            block = http + (payload if refers is None else b"")
            lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}"]
            if ident is not None:
                lines.append(f"WARC-Record-ID: {uri(ident)}")
            clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", target or "")
            if clean:
                lines.append(f"WARC-Target-URI: {clean}")
            lines.append(f"WARC-Date: {DATE}")
            if refers is not None:
                lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {uri(refers)}"]
            lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
            member = gz("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
            if member[-1]:  # a record of 16 MiB or more: an empty member follows, which ends in a zero byte
                member += gz(b"")
            return member[:-1]

        for batch in batches:
            ids, targets, payloads, refs = (batch.column(i) for i in range(4))
            out, held = [], 0
            for i in range(batch.num_rows):
                out.append(record(ids[i].as_py(), targets[i].as_py(), payloads[i].as_py(), refs[i].as_py()))
                held += len(out[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    return encode


def read_warc(spark: SparkSession, path: str, range_bytes: int = 8 << 20, keep_payload: bool = True) -> DataFrame:
    """Records of all archives below ``path``, one row each, with byte offsets; files are split at any size."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
        .filter(F.col("length") > 0)
    )
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    dealt = ranges.repartition(n, "path", "start")
    return dealt.mapInArrow(_scanner(range_bytes, keep_payload), RECORD_SCHEMA)


def _scanner(range_bytes: int, keep_payload: bool):
    def scan(batches: Iterator) -> Iterator:
        import re
        import zlib

        import pyarrow as pa
        from pyarrow.fs import FileSystem

        block, magic = 1 << 20, b"\x1f\x8b\x08"
        names = ["path", "offset", "next_offset", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def find(src, size: int, at: int, end: int) -> int:
            """Offset of the next magic that starts in [at, end), or -1."""
            while at < end:
                src.seek(at)
                data = src.read(min(block, end - at) + len(magic) - 1)
                hit = data.find(magic)
                if hit >= 0 and at + hit < end:
                    return at + hit
                at += min(block, end - at)
            return -1

        def inflate(src, at: int):
            """(content, offset behind the member), or None if no WARC record or empty member starts at ``at``."""
            z, parts, pos, seen = zlib.decompressobj(31), [], at, False
            src.seek(at)
            try:
                while not z.eof:
                    data = src.read(block if seen else 1 << 14)
                    if not data:
                        return None
                    pos += len(data)
                    if not seen:
                        head = z.decompress(data, 5)
                        if head and not b"WARC/".startswith(head[:5]):
                            return None
                        parts.append(head)
                        data, seen = z.unconsumed_tail, True
                    parts.append(z.decompress(data))
            except zlib.error:
                return None
            content = b"".join(parts)
            if content and not content.startswith(b"WARC/"):
                return None
            return content, pos - len(z.unused_data)

        def behind_filler(src, at: int) -> int:
            """Where the next record may start: behind the empty member that the sink puts after very large records."""
            src.seek(at)
            z = zlib.decompressobj(31)
            try:
                empty = z.decompress(src.read(20)) == b"" and z.eof and not z.unused_data
            except zlib.error:
                empty = False
            return at + 20 if empty else at

        def ident(value):
            m = re.fullmatch(r"<urn:page:(.*)>", value or "")
            return m[1] if m else value

        def parse(content: bytes):
            head, _, rest = content.partition(b"\r\n\r\n")
            fields = {}
            for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                fields[k.strip().lower()] = v.strip()
            body = rest[: int(fields.get("content-length", len(rest)))]
            size = len(body)
            if fields.get("content-type", "").startswith("application/http"):
                http, _, body = body.partition(b"\r\n\r\n")
                size = len(body)
                if fields.get("warc-type") == "revisit":
                    m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                    size = int(m[1]) if m else 0
            digest = fields.get("warc-payload-digest")
            return (
                fields.get("warc-type"), ident(fields.get("warc-record-id")), fields.get("warc-target-uri"), ident(fields.get("warc-refers-to")),
                digest.removeprefix("sha1:") if digest else None, size, body,
            )

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                fs, place = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", row["path"]))
                end, at, rows, held = min(row["length"], row["start"] + range_bytes), row["start"], [], 0
                with fs.open_input_file(place) as src:
                    while 0 <= (at := find(src, row["length"], at, end)):
                        got = inflate(src, at)
                        if got is None:
                            at += 1
                            continue
                        content, behind = got
                        if len(content) >= 1 << 24:
                            behind = behind_filler(src, behind)
                        if content:
                            *fields, body = parse(content)
                            rows.append((row["path"], at, behind, *fields, body if keep_payload and fields[0] != "revisit" else None))
                            held += len(body)
                        at = behind
                        if held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return scan


def broken_chains(records: DataFrame) -> DataFrame:
    """Records that do not start where another one of the file ends (nor at its begin): none in a sound reading.

    An archive inside a payload that gzip stored without compression could start a false chain; this shows it.
    """
    ends = records.select("path", F.col("next_offset").alias("offset"))
    return records.filter(F.col("offset") > 0).select("path", "offset").join(ends, ["path", "offset"], "left_anti")
