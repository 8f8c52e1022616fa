"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own.  The reader is given byte ranges; a task scans its range
for the gzip magic, takes a place for a member only if its first bytes decode to a WARC header,
decodes members from there on, and owns the records that start inside its range (the last may
run past the end).  False magic inside compressed data fails the header test and scanning goes on.

Archives lie in the shared folder; a task writes under a name of its own and renames, so a task
that is run again replaces its file with an equal one.  Paths are opened by their scheme with
Arrow's file systems.

Of records with equal payloads of REVISIT_FROM bytes or more, the one with the smallest page id
is a response and the others revisit it; a revisit has the HTTP header (with the payload's length)
but no payload.  Defined results: null html is an empty payload; rows that repeat the smallest id
are all responses; a null id sorts last (a response only if no equal payload has an id), null urls
are written as none; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

REVISIT_FROM = 100
RANGE_BYTES = 8 << 20
SALTS = 16
LENGTH = re.compile(rb"^content-length:\s*(\d+)", re.I | re.M)
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {url}"] if url and "\n" not in url and "\r" not in url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        fs, final = _open_fs(name)
        own, out, size, n = f"{final}.{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            for pid, url, html, digest, to in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], batch[3].to_pylist(), batch[4].to_pylist(), strict=True):
                if out is None:
                    fs.create_dir(final.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(own)
                raw = record(pid, url, html.as_buffer().to_pybytes() if html.is_valid else b"", digest, to)
                out.write(raw)
                size += len(raw)
                n += 1
        if out is not None:
            out.close()
            fs.move(own, final)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]})

    return run, "path string, bytes long, records long"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Writes the archives; returns (path, bytes, records) of each.  Equal payloads are found by digest alone;
    pages meet what was found by digest and one of SALTS salts, so a payload with countless copies spreads over tasks."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    digest = F.sha2(html.cast("binary"), 256)
    ident = F.col(id_col).cast("long")
    # Payloads that occur more than once: partial aggregation, a row each.
    first = pages.where(F.octet_length(html) >= REVISIT_FROM).select(digest.alias("d"), ident.alias("i")).groupBy("d").agg(F.min("i").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL").drop("c")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select(ident.alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"), digest.alias("d"), F.pmod(F.xxhash64(ident, F.col(url_col)), F.lit(SALTS)).cast("int").alias("salt"))
    rows = rows.join(salted, ["d", "salt"], "left")
    to = F.when(F.col("first").isNotNull() & ~F.col("i").eqNullSafe(F.col("first")), F.col("first"))
    run, schema = _write(scratch.path("archives"))
    return scratch.cut(rows.select("i", "u", "h", "d", to.alias("to")).mapInArrow(run, schema), "manifest")


def _head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Named fields of a WARC header and where its block starts; None if it isn't one."""
    if not raw.startswith(b"WARC/1."):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode()
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def members(source, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records that start in [start, end) of a file."""
    at, buffer, base = start, b"", start  # buffer holds bytes base.. of the file

    def fill(upto: int) -> None:
        nonlocal buffer
        while base + len(buffer) < min(upto, size):
            source.seek(base + len(buffer))
            more = source.read(max(_READ, upto - base - len(buffer)))
            if not more:
                return
            buffer += more

    while at < end:
        if at - base > 4 * _READ:
            buffer, base = buffer[at - base :], at
        fill(at + _READ)
        found = buffer.find(MAGIC, at - base)
        if found < 0 or base + found >= end:
            if base + len(buffer) >= min(end + 2, size):
                return
            at = max(at, base + len(buffer) - 2)
            fill(base + len(buffer) + _READ)
            continue
        at = base + found
        unpack, parts, pos, head = zlib.decompressobj(31), [], at, None
        try:
            while not unpack.eof:
                fill(pos + 1)
                piece = buffer[pos - base : pos - base + 65536]
                if not piece:
                    raise zlib.error("cut short")
                parts.append(unpack.decompress(piece))
                pos += len(piece)
                if head is None and (b"\r\n\r\n" in parts[0] or len(parts) > 1):
                    parts = [b"".join(parts)]
                    if (head := _head(parts[0])) is None and len(parts[0]) > 1 << 16:
                        raise zlib.error("no header")
            pos -= len(unpack.unused_data)
            raw = b"".join(parts)
            head = _head(raw)
            if head is None or len(raw) < head[1] + int(head[0]["content-length"]):
                raise zlib.error("no record")
        except zlib.error:
            at += 1
            continue
        yield at, head[0], raw[head[1] : head[1] + int(head[0]["content-length"])]
        at = pos


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    rows, held = [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    for batch in batches:
        for path, start, end, size in zip(*[batch[k].to_pylist() for k in ("path", "start", "end", "bytes")], strict=True):
            fs, where = _open_fs(path)
            with fs.open_input_file(where) as source:
                for _, fields, block in members(source, start, end, size):
                    kind, payload = fields["warc-type"], block
                    if fields.get("content-type", "").lower().startswith("application/http"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                    length, digest = len(payload), None
                    if kind == "revisit":  # length and digest are the full payload's, where the record tells them
                        told = LENGTH.search(http) if payload is not block else None
                        length, payload = int(told[1]) if told else None, None
                        digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
                    else:
                        digest = hashlib.sha256(payload).hexdigest()
                    rows.append((fields.get("warc-record-id"), fields.get("warc-target-uri"), kind, fields.get("warc-refers-to"), length, digest, payload))
                    held += len(block)
                    if held > 4 << 20 or len(rows) > 5000:
                        yield flush()
                        rows, held = [], 0
    if rows:
        yield flush()


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(record_id, url, record_type, refers_to, payload_bytes, digest, payload) of every record of archives
    (path, bytes, ...), whoever wrote them: ids as they stand there, of HTTP records the payload, of others
    (warcinfo, metadata) the block.  A revisit lacks its payload; length and digest are of the full one, null where not told."""
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("start"))
    ranges = ranges.select("path", "bytes", F.col("start").cast("long").alias("start"), F.least("bytes", F.col("start") + range_bytes).cast("long").alias("end"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = ranges.repartition(parts, "path", "start")
    return ranges.mapInArrow(_read, "record_id string, url string, record_type string, refers_to string, payload_bytes long, digest string, payload binary")


def page_number(urn) -> Column:
    """The page id in a record id of `write_archives`."""
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
f AS (SELECT sha256(x) AS d, min(page_id) AS first FROM p WHERE strlen(x) >= 100 GROUP BY 1)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha256(x) AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON f.d = sha256(x) AND strlen(x) >= 100
"""
