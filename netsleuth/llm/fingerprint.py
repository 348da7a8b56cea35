"""Document fingerprints: quartile bucket digest.

Byte triplets out of a sliding window of five bytes are hashed into 256
buckets.  The digest holds the length (on a logarithmic scale), the two ratios
of the bucket quartiles, and for each bucket the quartile its count lies in.
Two digests are compared bucket by bucket; the difference score is bounded by
what unrelated digests have, so that a likeness of 0 to 1 follows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.util import settle, table_partitions, with_row_id, worker_cache

BUCKETS = 256
#: Triplets of a five-byte window that hold its first byte: places of the other two.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
PIECE = 1 << 20
#: Difference of two quartile codes by their distance; the mean of that for
#: independent codes, which bounds the score; weights of length and ratios.
CODE_DIFFERENCE = (0, 1, 2, 6)
UNRELATED = 26 / 16
LENGTH_WEIGHT, LENGTH_MOST, RATIO_WEIGHT = 4, 16, 2


def hash_tables() -> list[np.ndarray]:
    """Three random permutations of the bytes (tabulation hashing)."""
    rng = np.random.default_rng(20240229)
    return [rng.permutation(256).astype(np.uint8) for _ in range(3)]


def bucket_counts(data: bytes, tables) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    buf = np.frombuffer(data, np.uint8)
    for s in range(0, max(0, len(buf) - 2), PIECE):
        part = buf[s:s + PIECE + 4]
        last = min(PIECE, len(buf) - s)
        a, b, c = (t[part] for t in tables)
        vals = []
        for k, (i, j) in enumerate(TRIPLETS):
            n = min(last, len(part) - j)
            if n > 0:
                vals.append(a[:n] ^ b[i:i + n] ^ c[j:j + n] ^ np.uint8(37 * k))
        out += np.bincount(np.concatenate(vals), minlength=BUCKETS)
    return out


def digest(data: bytes, tables) -> str:
    """Hex digits: length (2), quartile ratios (2), codes of the buckets (128).
    Equal bytes give equal digests; an empty text is all zeros."""
    counts = bucket_counts(data, tables)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, None] > q).sum(1).astype(np.uint8)
    body = (code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6).tobytes().hex()
    size = min(255, round(math.log(len(data) + 1) / math.log(1.1)))
    top = int(q[2])
    ratios = [int(16 * int(q[i]) / (top + 1)) for i in (0, 1)] if top else [0, 0]
    return f"{size:02x}{min(15, ratios[0]):x}{min(15, ratios[1]):x}{body}"


def _codes(d: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(d[4:]), np.uint8)
    return np.stack([raw >> s & 3 for s in (0, 2, 4, 6)], axis=1).astype(np.int8)


_DIFF = np.array(CODE_DIFFERENCE)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the score of unrelated ones on."""
    if a == b:
        return 1.0
    score = int(_DIFF[np.abs(_codes(a) - _codes(b))].sum())
    score += LENGTH_WEIGHT * min(LENGTH_MOST, max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1))
    score += RATIO_WEIGHT * sum(abs(int(x, 16) - int(y, 16)) for x, y in zip(a[2:4], b[2:4]))
    return max(0.0, 1.0 - score / (BUCKETS * UNRELATED))


def _tables():
    cache = worker_cache()
    return cache.get("digest") or cache.setdefault("digest", hash_tables())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every whole text (null: empty)."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: digest((t or "").encode(), _tables()))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col).cast("string")).alias("fingerprint"))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair(doc, text, own, following, next_digest):
    new = _edited(text, following).encode()
    changed = digest(new, _tables())
    return (doc, len(text), hashlib.sha256(new).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_digest))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, in the order of descending doc_id: its digest,
    the digest of its text with the second half replaced by the beginning of
    the next document, and the likeness to that and to the next document.

    Null texts are empty; equal ids follow each other in table order; null ids
    come last; after the last document comes the first; a table of one
    document is its own next; an empty table gives an empty one; other columns
    are ignored.

    Documents are range-partitioned once.  Within a partition neighbours meet
    as the rows stream by; only the first and last row of each partition leave
    it with their texts, and meet in a join on the partition number."""
    rows = with_row_id(docs, id_col, text_col).select("_rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("_rid")]

    def run(batches):
        from pyspark import TaskContext
        part, held, first, out, size = TaskContext.get().partitionId(), None, True, [], 0

        def flush():
            cols = list(zip(*out))
            names = [n for n, _ in _FIELDS] + ["part", "role", "text"]
            kinds = [k for _, k in _FIELDS] + [pa.int32(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()
            return batch
        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                text = t.as_py()
                own = digest(text.encode(), _tables())
                if first:
                    out.append((doc, None, None, own, None, None, None, part, "head", text))
                    first = False
                else:
                    out.append((*_pair(held[0], held[1], held[2], text, own), part, "done", None))
                held = (doc, text, own)
            if len(out) >= 1000:
                yield flush()
        if held:
            out.append((held[0], None, None, held[2], None, None, None, part, "tail", held[1]))
            yield flush()

    met = settle(rows.repartitionByRange(table_partitions(docs), *order).sortWithinPartitions(*order)
                 .mapInArrow(run, f"{_SCHEMA}, part int, role string, text string"), "fingerprint-pairs")
    parts = sorted(r[0] for r in met.where("role = 'head'").select("part").collect())  # a number per partition
    pairs = zip(parts, parts[1:] + parts[:1])
    follow = F.create_map(*[F.lit(x) for ab in pairs for x in ab])[F.col("part")] if parts else F.lit(-1)
    heads = met.where("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                                              F.col("fingerprint").alias("next_fp"))
    ends = met.where("role = 'tail'").withColumn("next_part", follow).join(heads, "next_part") \
        .select("doc_id", "text", "fingerprint", "next_text", "next_fp")

    def close(batches):
        for b in batches:
            got = [_pair(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            cols = list(zip(*got)) if got else [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS)], [n for n, _ in _FIELDS])

    return met.where("role = 'done'").select(*[n for n, _ in _FIELDS]).unionByName(
        ends.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(close, _SCHEMA))
