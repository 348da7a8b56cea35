"""WARC archives as a chunked record table.

The writer streams each payload in chunks: a payload longer than a chunk
becomes a first record and ``continuation`` records (WARC record
segmentation), each with its own block digest.  The reader gives one row per
record identifier and chunk number, carrying the SHA-1 of the payload up to and
including that chunk; it never holds more than one chunk of a record.  Files are
written and read by Spark's text source, so any file system Spark knows will do,
and uncompressed archives are split among tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsleuth.llm.util import settle, table_partitions

CHUNK_BYTES = 1 << 18
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: What divides two records of a file; the writer cuts blocks that contain it.
BETWEEN = END + VERSION
DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile("[\x00-\x20\x7f]")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _cuts(block, size: int):
    """(start, stop) of the chunks of a block: at most ``size`` bytes each; no
    chunk holds the record boundary or begins like a record."""
    start, n = 0, len(block)
    if bytes(block[:len(VERSION)]) == VERSION:
        yield 0, 2
        start = 2
    while True:
        stop = min(n, start + size)
        hit = bytes(block[start:stop + len(BETWEEN)]).find(BETWEEN)
        if hit >= 0 and start + hit + len(END) + 2 < stop:
            stop = start + hit + len(END) + 2
        if stop < n and bytes(block[stop:stop + len(VERSION)]) == VERSION:
            stop = min(n, stop + 2)
        yield start, stop
        if stop >= n:
            return
        start = stop


def _http_head(length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def _fields(pairs) -> bytes:
    return VERSION + b"".join(b"%s: %s\r\n" % (k.encode(), v if isinstance(v, bytes) else str(v).encode()) for k, v in pairs) + b"\r\n"


def page_records(page_id, row: int, url: str | None, payload, sha1: str, refers, chunk_bytes: int = CHUNK_BYTES, date: str = DATE):
    """Records (header and block) of one page; ``refers``: (page_id, row) of
    the response that a revisit points to, or None."""
    name = f"<urn:x-page:{'null' if page_id is None else page_id}:{row}>"
    uri = "urn:x-page:unknown" if url is None else _UNSAFE.sub(lambda m: "%%%02X" % ord(m[0]), url)
    whole = "sha1:" + base32_sha1(bytes.fromhex(sha1))
    http = _http_head(len(payload))
    same = [("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        other = f"<urn:x-page:{'null' if refers[0] is None else refers[0]}:{refers[1]}>"
        yield _fields([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *same, ("WARC-Payload-Digest", whole),
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", other), ("Content-Length", len(http))]) + http
        return
    if len(payload) + len(http) <= chunk_bytes:
        block = http + bytes(payload)
        cuts = list(_cuts(block, chunk_bytes))
    else:  # the head is a chunk of its own, the payload is cut where it lies
        block, cuts = payload, [(None, None), *_cuts(payload, chunk_bytes)]
    for k, (a, b) in enumerate(cuts, 1):
        part = http if a is None else bytes(block[a:b])
        head = [("WARC-Type", "response" if k == 1 else "continuation"),
                ("WARC-Record-ID", name if k == 1 else f"{name[:-1]}:{k}>"), *same,
                ("WARC-Block-Digest", "sha1:" + base32_sha1(hashlib.sha1(part).digest()))]
        if k == 1:
            head.append(("WARC-Payload-Digest", whole))
        if len(cuts) > 1:
            head.append(("WARC-Segment-Number", k))
            if k > 1:
                head.append(("WARC-Segment-Origin-ID", name))
            if k == len(cuts):
                head.append(("WARC-Segment-Total-Length", len(http) + len(payload)))
        yield _fields([*head, ("Content-Length", len(part))]) + part


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = DATE, compression: str = "none") -> None:
    """One record per row of ``pages`` below ``path``.

    The payload is the text in UTF-8 (or the bytes), null is empty.  Of equal
    payloads of ``min_bytes`` or more, the row with the smallest id (nulls last,
    then table order) is a response and the others revisit it.  Repeated rows
    and null ids have records of their own, a null url an ``unknown`` one; other
    columns are ignored; an empty table writes no record.  Payloads are grouped
    by their digest and length, counted before they are shuffled; payloads
    themselves move only if the table of revisits is too large to broadcast."""
    rows = pages.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).cast("long").alias("id"),
                        F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.length("payload").cast("long"))
    narrow = rows.where(F.col("bytes") >= min_bytes).select("_rid", "id", "sha1", "bytes")
    groups = (narrow.groupBy("sha1", "bytes")
              .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "_rid")).alias("first"))
              .where("n > 1").select("sha1", "bytes", F.col("first.id").alias("to_id"), F.col("first._rid").alias("to_rid")))
    again = settle(narrow.join(groups, ["sha1", "bytes"]).where("_rid <> to_rid").select("_rid", "to_id", "to_rid"), "warc-revisits")
    ready = rows.join(again, "_rid", "left").select("id", "_rid", "url", "payload", "sha1", "to_id", "to_rid")

    def run(batches):
        for b in batches:
            out, size = [], 0
            cols = [b.column(c) for c in ("id", "_rid", "url", "payload", "sha1", "to_id", "to_rid")]
            for i in range(b.num_rows):
                page, row, url, payload, sha1, to_id, to_rid = (c[i] for c in cols)
                refers = None if not to_rid.is_valid else (to_id.as_py(), to_rid.as_py())
                for rec in page_records(page.as_py(), row.as_py(), url.as_py(), memoryview(payload.as_buffer()), sha1.as_py(),
                                        refers, chunk_bytes, date):
                    out.append(rec)
                    size += len(rec)
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    (ready.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("compression", compression).text(path))


def parse_records(data: bytes):
    """(fields, block, complete) of the records in a stretch of an archive that
    begins at, or just behind, a version line."""
    while data:
        at = len(VERSION) if data.startswith(VERSION) else 0
        stop = data.find(END, at)
        if stop < 0:
            return
        fields = dict(x.split(b": ", 1) for x in data[at:stop].split(b"\r\n") if b": " in x)
        fields = {k.decode().lower(): v.decode() for k, v in fields.items()}
        size = int(fields.get("content-length", 0))
        block = data[stop + 4:stop + 4 + size]
        yield fields, block, len(block) == size
        data = data[stop + 4 + size:]
        data = data[4:] if data.startswith(END) else data
        if not data.startswith(VERSION):
            return


_CHUNKS = ("record_id string, page_id long, record_type string, refers_to long, chunk_no int, last boolean, complete boolean, "
           "block binary, payload_digest string, payload_bytes long")
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.string(), pa.int64()]
_NAMES = ["record_id", "page_id", "record_type", "refers_to", "chunk_no", "last", "complete", "block", "payload_digest", "payload_bytes"]


def _page_of(urn: str | None):
    if not urn:
        return None
    x = urn.strip("<>").split(":")[2]
    return None if x == "null" else int(x)


def _batch(rows, names, kinds):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives: identifier, chunk number, block, and what
    its header says of the whole payload."""
    def run(batches):
        for b in batches:
            rows, size = [], 0
            for raw in b.column("value"):
                for f, block, complete in parse_records(raw.as_py()):
                    kind = f.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    name = f.get("warc-segment-origin-id") or f["warc-record-id"]
                    number = int(f.get("warc-segment-number", 1))
                    last = "warc-segment-number" not in f or "warc-segment-total-length" in f
                    length = None
                    if kind == "revisit":
                        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", block)
                        length = int(m[1]) if m else None
                    rows.append((name, _page_of(name), kind, _page_of(f.get("warc-refers-to")), number - 1, last, complete, block,
                                 f.get("warc-payload-digest", "").removeprefix("sha1:") or None, length))
                    size += len(block)
                if size > 1 << 23:
                    yield _batch(rows, _NAMES, _KINDS)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, _NAMES, _KINDS)

    return (spark.read.option("lineSep", BETWEEN.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
            .mapInArrow(run, _CHUNKS))


def read_chunks(spark: SparkSession, path: str, with_chunks: bool = True) -> DataFrame:
    """``(record_id, page_id, record_type, refers_to, chunk_no, last, chunk,
    payload_bytes, payload_digest, intact)``: one row per chunk of each record.

    ``payload_bytes`` and ``payload_digest`` (bare base32 SHA-1) are those of
    the payload up to and including the chunk; at the ``last`` chunk they are
    the whole payload's, and ``intact`` says whether that agrees with the
    header.  A revisit is one row without bytes that carries what its header
    says.  Records of one segment are read where they lie; the segments of
    others are brought together by identifier and stream by in order."""
    segments = _segments(spark, path)
    names = ["record_id", "page_id", "record_type", "refers_to", "chunk_no", "last", "chunk", "payload_bytes", "payload_digest", "intact"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    schema = ("record_id string, page_id long, record_type string, refers_to long, chunk_no int, last boolean, chunk binary, "
              "payload_bytes long, payload_digest string, intact boolean")

    def carry(batches):
        now, sha, total, told, head, good, at = None, None, 0, None, b"", True, 0
        for b in batches:
            rows, size = [], 0
            for name, page, kind, refers, no, last, complete, block, said, length in zip(*(c.to_pylist() for c in b.columns)):
                if kind == "revisit":
                    rows.append((name, page, kind, refers, 0, True, None, length, said, complete))
                    continue
                if no == 0:
                    now, sha, total, told, head, good, at = name, hashlib.sha1(), 0, said, b"", True, 0
                good = good and complete and name == now and no == at
                at += 1
                if head is not None:  # the HTTP head ends at the first empty line
                    head += block
                    stop = head.find(END)
                    block, head = (head[stop + 4:], None) if stop >= 0 else (b"", head)
                sha.update(block)
                total += len(block)
                digest = base32_sha1(sha.copy().digest())
                rows.append((name, page, "response", None, no, last, block if with_chunks else None, total, digest,
                             good and (not last or digest == told)))
                size += len(block) * with_chunks
                if size > 1 << 23:
                    yield _batch(rows, names, kinds)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, names, kinds)

    alone = F.col("last") & (F.col("chunk_no") == 0)
    several = (segments.where(~alone).repartition(table_partitions(segments), "record_id")
               .sortWithinPartitions("record_id", "chunk_no"))
    return segments.where(alone).mapInArrow(carry, schema).unionByName(several.mapInArrow(carry, schema))
