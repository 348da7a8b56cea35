"""Source divergence audit by chunk factorization.

Which sources of a language use its words unlike the others?  Terms are runs of
letters and non-ASCII characters, lower-cased in A-Z.

1. *Chunks.*  A scan task reads its documents in blocks of ``BLOCK_BYTES``.
   Within a block every whitespace chunk gets a number, and each document's
   chunks are counted.  The counts stay in the block's own row; only the
   (block, chunk) pairs leave it, with their number of documents.
2. *Terms.*  The pairs are dealt by chunk and sorted by its hash, so equal
   chunks follow each other and each is tokenized once, whatever its number of documents.
   The documents of all chunks of a term bound its own from above: terms below
   the limit by this bound cannot be kept and end here.
3. *Join back.*  The other terms return to their blocks, where they meet the
   counts: per (document, term) once, then per (language, term) the number of
   distinct documents and each source's occurrences, summed over the blocks.
4. *Divergence.*  Shares of every kept term, the triangular discrimination of
   each pair of sources of a language, and each source's most telling terms.

The sum over all kept terms of a pair splits into the terms that neither has
(one value), that one of them has (a histogram of its shares) and that both
have (one join by term), so absent terms are never spelled out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsleuth.llm.util import as_bytes, settle

#: Documents of a language that a kept term occurs in, at least.
MIN_DOCS = 10
#: Terms reported per source.
TOP_TERMS = 10
#: Shares are whole numbers of this unit.
SCALE = 1_000_000_000
#: Text of a block, and its documents (their numbers take two bytes).
BLOCK_BYTES = 1 << 25
BLOCK_DOCS = 1 << 16

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Bits of the filter of terms that may be kept.
FILTER_BITS = 1 << 24

_BLOCK = pa.schema([("block", pa.int64()), ("cid", pa.int32()), ("chunk", pa.binary()), ("n_docs", pa.int32()), ("starts", pa.binary()),
                    ("docs", pa.binary()), ("counts", pa.binary()), ("large", pa.list_(pa.int64())), ("doc_group", pa.binary()),
                    ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string()))])
_BLOCK_DDL = ("block long, cid int, chunk binary, n_docs int, starts binary, docs binary, counts binary, large array<long>, doc_group binary, "
              "langs array<string>, sources array<string>")
_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("by_source", pa.string())])
_COUNTS_DDL = "lang string, term string, n_docs long, by_source string"


def _pack(v: np.ndarray) -> pa.Array:
    """One row: the array's length and its compressed bytes."""
    raw = v.tobytes()
    return pa.array([len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())


def _unpack(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd"), kind)


class _Block:
    """Chunk counts of consecutive documents."""

    def __init__(self, first: int):
        self.first, self.bytes = first, 0
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__        # a new chunk gets the next number
        self.ids: list[np.ndarray] = []
        self.groups: dict[tuple, int] = {}
        self.doc_group: list[int] = []

    def add(self, text: bytes, lang: str, source: str) -> None:
        words = text.split()
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.doc_group.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.bytes += len(text) + 16

    def full(self, block_bytes: int) -> bool:
        return self.bytes >= block_bytes or len(self.ids) == BLOCK_DOCS

    def rows(self):
        """The chunks, then one row with the counts of each (chunk, document),
        in the order of the chunks' numbers; counts over 254 go to ``large``."""
        chunks, n = list(self.number), len(self.ids)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(i) for i in self.ids])
        key = np.concatenate(self.ids).astype(np.int64)
        key *= n
        key += doc
        key.sort()
        first = _runs(key)
        key, count = key[first], np.diff(np.append(first, len(key)))
        n_docs = np.bincount(key // n, minlength=len(chunks)).astype(np.int32)
        for a in range(0, len(chunks), 100_000):
            part = pa.array(chunks[a:a + 100_000], pa.binary())
            yield _batch(len(part), _BLOCK, block=pa.array(np.full(len(part), self.first)), chunk=part,
                         cid=pa.array(np.arange(a, a + len(part), dtype=np.int32)), n_docs=pa.array(n_docs[a:a + len(part)]))
        langs, sources = zip(*self.groups)
        yield _batch(1, _BLOCK, block=pa.array([self.first]), starts=_pack(np.concatenate([[0], np.cumsum(n_docs)]).astype(np.int32)),
                     docs=_pack((key % n).astype(np.uint16)), counts=_pack(np.minimum(count, 255).astype(np.uint8)),
                     large=pa.array([count[count >= 255]], pa.list_(pa.int64())), doc_group=_pack(np.array(self.doc_group, np.int32)),
                     langs=pa.array([list(langs)]), sources=pa.array([list(sources)]))


def _batch(n: int, schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def chunk_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``_Block`` for a table ``(_rid, lang, source, text)``."""
    def go(batches):
        block = None
        for b in batches:
            for rid, lang, source, text in zip(b.column("_rid").to_pylist(), b.column("lang").to_pylist(),
                                               b.column("source").to_pylist(), as_bytes(b.column("text"))):
                if block is None:
                    block = _Block(rid)
                block.add(text, lang, source)
                if block.full(block_bytes):
                    yield from block.rows()
                    block = None
        if block is not None:
            yield from block.rows()
    return docs.mapInArrow(go, _BLOCK_DDL)


def tokenize_chunks(pairs: DataFrame) -> DataFrame:
    """``(block, cid, n_docs, term)`` of ``(block, cid, chunk, n_docs)``, one
    row per term of the chunk; chunks without a term go.  Each distinct chunk is tokenized once: equal ones
    come one after the other, and the last one is carried on."""
    term, lower = TERM, _LOWER

    def go(batches):
        find = re.compile(term).findall
        last, terms = None, None
        for b in batches:
            chunk = b.column("chunk")
            n = len(chunk)
            if n == 0:
                continue
            fresh = np.ones(n, bool)
            if n > 1:
                fresh[1:] = pc.not_equal(chunk.slice(1), chunk.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            distinct = chunk.filter(pa.array(fresh)).to_pylist()
            lists = [find(c.translate(lower)) for c in distinct[1:]]
            if distinct[0] != last:
                terms = find(distinct[0].translate(lower))
            lists.insert(0, terms)
            last, terms = distinct[-1], lists[-1]
            out = pa.array(lists, pa.list_(pa.binary())).take(pa.array(np.cumsum(fresh) - 1))
            at = pc.list_parent_indices(out)
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("block", "cid", "n_docs")] + [pc.list_flatten(out).cast(pa.string())],
                                             ["block", "cid", "n_docs", "term"])
    return pairs.repartition("chunk").sortWithinPartitions(F.xxhash64("chunk")).mapInArrow(go, "block long, cid int, n_docs int, term string")


def _maybe_among(rows: DataFrame, col: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``col`` may be in ``wanted``: a bitmap of ``FILTER_BITS``
    hashes, whatever their number; none that is in ``wanted`` is lost."""
    slot = (F.pmod(F.xxhash64(col), F.lit(FILTER_BITS)) + 1).cast("long")
    parts = (wanted.select(slot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        at = (r["b"] - 1) * len(r["m"])
        bits[at:at + len(r["m"])] = np.frombuffer(bytes(r["m"]), np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)      # FILTER_BITS / 8 bytes

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        x = p.to_numpy() - 1
        return pd.Series((sent.value[x >> 3] >> (x & 7) & 1).astype(bool))
    return rows.where(there(slot))


def _runs(key: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _block_counts(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of each (language, term) of one block, and its occurrences
    source by source."""
    if left.num_rows == 0 or right.num_rows == 0:
        return _COUNTS.empty_table()
    row = left.to_pylist()[0]
    starts, docs, group = _unpack(row["starts"], np.int32), _unpack(row["docs"], np.uint16), _unpack(row["doc_group"], np.int32)
    counts = _unpack(row["counts"], np.uint8).astype(np.int64)
    counts[counts == 255] = row["large"]
    cid = right.column("cid").to_numpy()
    coded = right.column("term").combine_chunks().dictionary_encode()
    tid = coded.indices.to_numpy()
    # every (chunk, term) with every document of the chunk
    num = (starts[1:] - starts[:-1])[cid].astype(np.int64)
    at = np.repeat(starts[:-1][cid] - (np.cumsum(num) - num), num) + np.arange(num.sum())
    key = np.repeat(tid.astype(np.int64), num) * len(group) + docs[at]
    order = np.argsort(key, kind="stable")
    key, n = key[order], counts[at[order]]
    first = _runs(key)
    key, n = key[first], np.add.reduceat(n, first)
    # distinct (term, document) to (term, language, source); groups are put in the order of their languages
    langs, lang_of = np.unique(row["langs"], return_inverse=True)
    by_lang = np.argsort(lang_of, kind="stable")
    rank = np.empty(len(by_lang), np.int64)
    rank[by_lang] = np.arange(len(by_lang))
    key = key // len(group) * len(rank) + rank[group[key % len(group)]]
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = _runs(key)
    n_docs, n, key = np.diff(np.append(first, len(key))), np.add.reduceat(n, first), key[first]
    source = by_lang[key % len(rank)]
    pair = key // len(rank) * len(langs) + lang_of[source]
    cut = _runs(pair)
    names = pa.array([quote(s, safe="") + ":" for s in row["sources"]], pa.string())
    entry = pc.binary_join_element_wise(names.take(pa.array(source)), pa.array(n).cast(pa.string()), "")
    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(pair)).astype(np.int32)), entry)
    return pa.table([pa.array(langs, pa.string()).take(pa.array(pair[cut] % len(langs))), coded.dictionary.take(pa.array(pair[cut] // len(langs))),
                     pa.array(np.add.reduceat(n_docs, cut)), pc.binary_join(lists, ",")], schema=_COUNTS)


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, lang_col, source_col))
    return docs.select(F.monotonically_increasing_id().alias("_rid"), lang.alias("lang"), source.alias("source"), text.alias("text"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, term, source, n)``: occurrences in each source of the terms
    that are in at least ``min_docs`` documents of the language.

    Null texts, languages and sources count as empty ones.  Every row is a
    document of its own, repeated rows and ids too; texts without a term give
    no row; other columns are ignored."""
    blocks = settle(chunk_blocks(_plain(docs, text_col, lang_col, source_col), block_bytes), "audit-chunks", "zstd")
    pairs = blocks.where("chunk is not null").select("block", "cid", "chunk", "n_docs")
    tokens = settle(tokenize_chunks(pairs), "audit-terms", "zstd")
    bound = tokens.groupBy("term").agg(F.sum("n_docs").alias("n"))
    terms = _maybe_among(tokens.select("block", "cid", "term"), "term", bound.where(F.col("n") >= min_docs))
    counts = blocks.where("starts is not null").drop("cid", "chunk", "n_docs")
    found = counts.groupBy("block").cogroup(terms.groupBy("block")).applyInArrow(_block_counts, _COUNTS_DDL)
    return merge_counts(found.repartition("lang", "term").sortWithinPartitions("lang", "term"), min_docs)


def merge_counts(found: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, source, n)`` from rows of the blocks, sorted by language
    and term: those of a term follow each other and are added up."""
    names, schema = ("lang", "term", "source", "n"), pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])

    def go(batches):
        key, docs, texts, plain = (None, None), 0, [], {}
        for b in batches:
            out = ([], [], [], [])
            for lang, term, n_docs, text in zip(*(c.to_pylist() for c in b.columns)):
                if term != key[1] or lang != key[0]:
                    if texts and docs >= min_docs:
                        add(out, key, texts, plain)
                    key, docs, texts = (lang, term), 0, []
                docs += n_docs
                texts.append(text)
            yield batch(out)
        out = ([], [], [], [])
        if texts and docs >= min_docs:
            add(out, key, texts, plain)
        yield batch(out)

    def add(out, key, texts, plain):
        counts = defaultdict(int)
        for e in ",".join(texts).split(","):
            s, _, n = e.partition(":")
            counts[s] += int(n)
        for s in counts:
            if s not in plain:
                plain[s] = unquote(s)
        out[0].extend([key[0]] * len(counts))
        out[1].extend([key[1]] * len(counts))
        out[2].extend(map(plain.__getitem__, counts))
        out[3].extend(counts.values())

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], names)
    return found.mapInArrow(go, "lang string, term string, source string, n long")


def _share(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact."""
    return F.expr(f"1 + CAST({n} + 2 AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0)) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    ``part`` 'pair': ``item`` is each other source of the language, ``value``
    the divergence of their shares summed over all kept terms (0 if the
    language keeps none).  'term': the ``top`` terms that the source uses more
    than its language does.  Ranks run by value, then by item.

    Every (language, source) that occurs has its pairs, with texts or without;
    a language with one source has none.  An empty table gives an empty one."""
    kept = settle(term_counts(docs, min_docs, text_col, lang_col, source_col, block_bytes), "audit-kept")
    of_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    size = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    groups = _plain(docs, text_col, lang_col, source_col).select("lang", "source").distinct()
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    groups = settle(groups.join(used, ["lang", "source"], "left").join(size, "lang", "left")
                    .select("lang", "source", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("v", F.lit(0)).alias("v"), "total")
                    .withColumn("p0", F.when(F.col("v") > 0, _share("0", "used", "v"))), "audit-groups")
    terms = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "used", "v"))

    share = of_lang.join(size, "lang").select("lang", "term", _share("n", "total", "v").alias("q"))
    over = terms.join(share, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    a = groups.select("lang", "source", "v", F.col("p0").alias("pa"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("pb"))
    neither = a.join(b, "lang").where("source <> item") \
        .select("lang", "source", "item", F.expr(f"coalesce(v * {_gap('pa', 'pb')}, 0L)").alias("value"))
    shares = terms.groupBy("lang", "source", F.col("p0").alias("pa"), "p").agg(F.count(F.lit(1)).alias("m"))
    one = shares.join(b, "lang").where("source <> item").groupBy("lang", "source", "item") \
        .agg(F.sum(F.expr(f"m * ({_gap('p', 'pb')} - {_gap('pa', 'pb')})")).alias("value"))
    x = terms.select("lang", "term", "source", F.col("p0").alias("pa"), F.col("p").alias("p"))
    y = terms.select("lang", "term", F.col("source").alias("item"), F.col("p0").alias("pb"), F.col("p").alias("q"))
    both = x.join(y, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item") \
        .agg(F.sum(F.expr(f"{_gap('p', 'q')} - {_gap('p', 'pb')} - {_gap('pa', 'q')} + {_gap('pa', 'pb')}")).alias("value"))

    def swapped(df):
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = neither.unionByName(one).unionByName(swapped(one)).unionByName(both).unionByName(swapped(both)) \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by)).withColumn("part", F.lit("pair"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(cols).unionByName(telling.select(cols))
