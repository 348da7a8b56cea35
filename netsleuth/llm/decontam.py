"""Benchmark decontamination with a distributed positional inverted index.

1. *Index.*  A scan task reads its documents in blocks.  Per block and term one
   row is stored: the places of the term, as differences in variable-length
   bytes.  The row of the empty term holds the block's documents.  Every word
   of every document is in the index; it serves any number of test sets.
2. *Test terms.*  An item gives every window of ``WINDOW`` consecutive words
   (all of its words if it has fewer).  Equal windows are searched once.  The
   index says how often each test term occurs; a window's terms are put in
   that order, rarest first, and a window with a term that nowhere occurs ends.
3. *Intersection.*  A window goes to the blocks that hold its two rarest terms.
   There the places of its rarest term, less its offset, are the candidate
   starts; they are intersected with the offset-adjusted places of the other
   terms, the next rarest first.  What is left are exact phrases.  The places
   of the rarest term that have every other term within ``NEAR`` words on
   either side, in the same document, are proximity matches.
4. *Documents.*  A document lies in one block, so the words that windows cover
   are counted there.  Windows with the same items share a class; documents
   with the same classes share one digest of item ids.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.util import as_bytes, join_counted, joined_sha256, settle

WINDOW = 10
#: Words on either side of the rarest term for a proximity match.
NEAR = 15
#: Text of a block.
BLOCK_BYTES = 1 << 24
#: Candidate starts that are intersected at a time.
CANDIDATES = 1 << 21

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, digits and bytes of non-ASCII characters stay, A-Z in lower case;
#: all others part words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_INDEX_DDL = "block long, term string, n long, places binary, ids array<long>"


# --- index ------------------------------------------------------------------

def pack_ints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative whole numbers as bytes of seven bits, low ones first, and
    the bytes that each takes."""
    v = v.astype(np.int64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        size += v >= 1 << 7 * k
    out = np.empty(size.sum(), np.uint8)
    at = np.cumsum(size) - size
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[some] + k] = (v[some] >> 7 * k) & 127 | (size[some] > k + 1).astype(np.int64) << 7
    return out, size


def unpack_ints(data: np.ndarray) -> np.ndarray:
    stop = np.flatnonzero(data < 128) + 1
    start = np.concatenate([[0], stop[:-1]])
    out = np.zeros(len(stop), np.int64)
    for k in range(int((stop - start).max(initial=0))):
        some = stop - start > k
        out[some] |= (data[start[some] + k].astype(np.int64) & 127) << 7 * k
    return out


def _index_rows(block: int, number: dict, ids: list, doc_ids: list):
    """Rows of a block's terms, then the row of its documents."""
    if number:
        words = np.concatenate(ids)
        count = np.bincount(words, minlength=len(number))
        place = np.argsort(words, kind="stable")
        first = np.cumsum(count) - count
        step = np.diff(place, prepend=0)
        step[first] = place[first]
        data, size = pack_ints(step)
        stop = np.cumsum(size)[first + count - 1]
        terms = list(number)
        for a in range(0, len(terms), 50_000):
            z = min(a + 50_000, len(terms))
            lo = int(stop[a - 1]) if a else 0
            offsets = np.concatenate([[lo], stop[a:z]]) - lo
            places = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets.astype(np.int32)),
                                                                      pa.py_buffer(np.ascontiguousarray(data[lo:int(stop[z - 1])]))])
            yield _rows([block] * (z - a), pa.array(terms[a:z], pa.binary()).cast(pa.string()), count[a:z], places, pa.nulls(z - a, pa.list_(pa.int64())))
    data, _ = pack_ints(np.array([len(i) for i in ids]))
    yield _rows([block], pa.array([""]), [len(ids)], pa.array([data.tobytes()], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64())))


def _rows(block, term, n, places, ids):
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), term, pa.array(n, pa.int64()), places, ids],
                                      ["block", "term", "n", "places", "ids"])


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, term, n, places, ids)``: for each block and term the number of
    places and the places, counted in words from the block's start; for the
    empty term the number of documents, their lengths and their ids.  Null texts
    have no words; every row is a document, repeated and null ids too."""
    plain = _PLAIN

    def numbering():
        d = defaultdict()
        d.default_factory = d.__len__                 # a new word gets the next number
        return d

    def go(batches):
        block, number, ids, doc_ids, size = None, numbering(), [], [], 0
        for b in batches:
            for rid, doc, text in zip(b.column("_rid").to_pylist(), b.column("doc_id").to_pylist(), as_bytes(b.column("text"))):
                if block is None:
                    block = rid
                words = (text or b"").translate(plain).split()
                ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc)
                size += len(text or b"") + 16
                if size >= block_bytes:
                    yield from _index_rows(block, number, ids, doc_ids)
                    block, number, ids, doc_ids, size = None, numbering(), [], [], 0
        if block is not None:
            yield from _index_rows(block, number, ids, doc_ids)
    return docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(go, _INDEX_DDL)


# --- test windows -----------------------------------------------------------

def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(item_id, words)``; a null id counts as an empty one."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words.alias("all")).where("size(all) > 0")
    return rows.select("item_id", F.explode(F.expr(
        f"CASE WHEN size(all) <= {window} THEN array(all) ELSE transform(sequence(0, size(all) - {window}), i -> slice(all, i + 1, {window})) END"
    )).alias("words")).distinct()


def ranked_windows(windows: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(wid, cls, tids, offsets)`` of each distinct window of which every
    term occurs, rarest term first (ties by term), and ``(term, tid)``.

    ``cls`` is the same for windows with the same items: one of their ids."""
    distinct = windows.groupBy("words").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")).alias("s"),
                                            F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("x"))
    distinct = settle(distinct.withColumn("wid", F.monotonically_increasing_id()), "decontam-windows")
    rep = distinct.groupBy("k", "s", "x").agg(F.min("wid").alias("cls"))
    known = settle(distinct.join(rep, ["k", "s", "x"]).select("wid", "cls", "words"), "decontam-classes")
    spots = known.select("wid", "cls", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    seen = index.join(spots.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    terms = settle(seen.withColumn("tid", F.monotonically_increasing_id()), "decontam-terms")
    ranked = spots.join(terms, "term").groupBy("wid", "cls", "len").agg(F.sort_array(F.collect_list(F.struct("n", "term", "off", "tid"))).alias("r")) \
        .where("size(r) = len").select("wid", "cls", F.col("r.tid").alias("tids"), F.col("r.off").alias("offsets"))
    return settle(ranked, "decontam-ranked"), terms.select("term", "tid"), known


# --- intersection -----------------------------------------------------------

class BlockSearch:
    """Places of the test terms of one block, and its documents."""

    def __init__(self, tids: np.ndarray, places: list, lengths: np.ndarray):
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(tids)
        self.tids = tids[order]
        raw = [np.frombuffer(places[i], np.uint8) for i in order]
        step = unpack_ints(np.concatenate(raw)) if raw else np.zeros(0, np.int64)
        self.n = np.array([np.count_nonzero(r < 128) for r in raw], np.int64)
        self.first = np.cumsum(self.n) - self.n
        run = np.cumsum(step)
        base = run[self.first] - step[self.first] if len(step) else step
        self.place = run - np.repeat(base, self.n)
        self.size = int(self.starts[-1])
        #: term at each place, and (term, place) as one ordered number
        self.at = np.full(self.size, -1, np.int32)
        self.at[self.place] = np.repeat(np.arange(len(self.tids), dtype=np.int32), self.n)
        self.keys = np.repeat(np.arange(len(self.tids)), self.n) * (self.size + 1) + self.place

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def number(self, tids: np.ndarray) -> np.ndarray:
        """Local numbers of terms, -1 if the block lacks them."""
        if not len(self.tids):
            return np.full(len(tids), -1)
        at = np.minimum(np.searchsorted(self.tids, tids), len(self.tids) - 1)
        return np.where(self.tids[at] == tids, at, -1)

    def candidates(self, anchor: np.ndarray):
        """(window, place) of every place of each window's rarest term, some
        ``CANDIDATES`` at a time; one window's places may be split."""
        ok = np.flatnonzero(anchor >= 0)
        n = self.n[anchor[ok]]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        for a in range(0, total, CANDIDATES):
            i = np.arange(a, min(a + CANDIDATES, total))
            w = np.searchsorted(stop, i, side="right")
            yield ok[w], self.place[self.first[anchor[ok[w]]] + i - (stop[w] - n[w])]

    def exact(self, w, place, term, off, size):
        """(window, start) of the candidates that are whole phrases; ``term``
        and ``off`` hold the windows' terms and offsets, rarest first."""
        start = place - off[w, 0]
        ok = (start >= 0) & (start + size[w] <= self.size)
        w, start = w[ok], start[ok]
        ok = self.doc(start) == self.doc(start + size[w] - 1)
        w, start = w[ok], start[ok]
        for k in range(1, term.shape[1]):
            more = size[w] > k
            ok = ~more
            ok[more] = self.at[start[more] + off[w[more], k]] == term[w[more], k]
            w, start = w[ok], start[ok]
        return w, start

    def near(self, w, place, term, size, reach):
        """(window, place) of the candidates with every other term of the
        window within ``reach`` words in the same document."""
        for k in range(1, term.shape[1]):
            doc = self.doc(place)
            lo, hi = np.maximum(place - reach, self.starts[doc]), np.minimum(place + reach, self.starts[doc + 1] - 1)
            base = term[w, k] * (self.size + 1)
            at = np.searchsorted(self.keys, base + lo)
            ok = (size[w] <= k) | (np.append(self.keys, np.iinfo(np.int64).max)[at] <= base + hi)
            w, place = w[ok], place[ok]
        return w, place


def _per_doc(docs: np.ndarray, cls: np.ndarray, n: int) -> pa.ListArray:
    """Distinct classes of each document, in order."""
    order = np.lexsort((cls, docs))
    docs, cls = docs[order], cls[order]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (cls[1:] != cls[:-1])
    docs, cls = docs[fresh], cls[fresh]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)).astype(np.int32)), pa.array(cls, pa.int64()))


def _search(left: pa.Table, right: pa.Table, reach: int | None):
    """(block documents, exact, near): arrays of (window row, place)."""
    tid = left.column("tid").to_numpy()
    places = left.column("places").to_pylist()
    head = int(np.flatnonzero(tid < 0)[0])
    lengths = unpack_ints(np.frombuffer(places[head], np.uint8))
    rows = np.flatnonzero(tid >= 0)
    b = BlockSearch(tid[rows], [places[i] for i in rows], lengths)
    lists = right.column("tids").combine_chunks()
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    width = int(size.max(initial=1))
    fill = np.arange(width) < size[:, None]
    term, off = np.full((len(size), width), -1, np.int64), np.zeros((len(size), width), np.int64)
    term[fill] = b.number(lists.flatten().to_numpy())
    off[fill] = right.column("offsets").combine_chunks().flatten().to_numpy()
    term[((term < 0) & fill).any(axis=1), 0] = -1      # a term is missing here: no candidate
    exact, near = [], []
    for w, place in b.candidates(term[:, 0]) if len(size) else ():
        exact.append(b.exact(w, place, term, off, size))
        if reach is not None:
            near.append(b.near(w, place, term, size, reach))

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 2
    return b, left.column("ids")[head].as_py(), lengths, size, joined(exact), joined(near)


def _block_input(index: DataFrame, ranked: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The test terms' rows of each block (and its documents), and the windows
    of which the block holds the two rarest terms."""
    heads = index.where("term = ''").select("block", F.lit(-1).cast("long").alias("tid"), "places", "ids")
    rows = index.join(terms, "term").select("block", "tid", "places", F.lit(None).cast("array<long>").alias("ids"))
    held = index.select("block", "term").join(terms, "term")
    first, second = (held.select(F.col("block").alias(b), F.col("tid").alias(t)) for b, t in (("at", "t1"), ("also", "t2")))
    sent = ranked.withColumn("second", F.element_at("tids", F.least(F.size("tids"), F.lit(2)))).join(first, F.col("tids")[0] == F.col("t1")) \
        .join(second, (F.col("at") == F.col("also")) & (F.col("second") == F.col("t2")), "left_semi")
    return heads.unionByName(rows), sent.select("at", "wid", "cls", "tids", "offsets")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, reach: int | None = NEAR, index: DataFrame | None = None,
                id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, kind, place, length)``: every exact phrase ('exact',
    with the place of its first word) and every proximity match ('near', with
    the place of its rarest term) of every window, for each item that has it."""
    index = index if index is not None else settle(positional_index(docs, id_col, text_col), "decontam-index")
    windows = settle(item_windows(items, window, item_col, item_text), "decontam-items")
    ranked, terms, known = ranked_windows(windows, index)
    left, right = _block_input(index, ranked, terms)

    def go(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("wid", pa.int64()), ("kind", pa.string()), ("place", pa.int64()), ("length", pa.int64())])
        if a.num_rows == 0 or b.num_rows == 0:
            return schema.empty_table()
        s, ids, _, size, exact, near = _search(a, b, reach)
        wid, ids = b.column("wid").to_numpy(), pa.array(ids, pa.int64())
        parts = []
        for kind, (w, place) in (("exact", exact), ("near", near)):
            doc = s.doc(place)
            parts.append(pa.table([ids.take(pa.array(doc)), pa.array(wid[w]), pa.array([kind] * len(w), pa.string()),
                                   pa.array(place - s.starts[doc]), pa.array(size[w])], schema=schema))
        return pa.concat_tables(parts)
    found = left.groupBy("block").cogroup(right.groupBy("at")).applyInArrow(go, "doc_id long, wid long, kind string, place long, length long")
    return found.join(windows.join(known, "words").select("wid", "item_id"), "wid").drop("wid")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, reach: int = NEAR, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    n_near)``, one row per row of ``docs``.

    ``n_hit``: words inside an occurrence of a window; ``n_items``: items with
    an occurring window, ``items_sha256`` the digest of their ids as strings in
    order; ``n_near``: items with an occurring window or a proximity match.

    Null and empty texts have no words, on either side; an item of fewer words
    than a window is one window; repeated rows and equal ids each keep their
    row; repeated items count once; other columns are ignored; empty tables
    give clean documents or none."""
    index = settle(positional_index(docs, id_col, text_col, block_bytes), "decontam-index")
    windows = settle(item_windows(items, window, item_col, item_text), "decontam-items")
    ranked, terms, known = ranked_windows(windows, index)
    left, right = _block_input(index, ranked, terms)

    def go(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0:
            return schema.empty_table()
        s, ids, lengths, size, (w, start), (v, place) = _search(a, b, reach)
        cls = b.column("cls").to_numpy()
        n = len(lengths)
        cover = np.zeros(s.size + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size[w], -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
        return pa.table([pa.array(ids, pa.int64()), pa.array(lengths), pa.array(hit[s.starts[1:]] - hit[s.starts[:-1]]),
                         _per_doc(s.doc(start), cls[w], n),
                         _per_doc(s.doc(np.concatenate([start, place])), np.concatenate([cls[w], cls[v]]), n)], schema=schema)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("exact", pa.list_(pa.int64())),
                        ("near", pa.list_(pa.int64()))])
    found = left.groupBy("block").cogroup(right.groupBy("at")) \
        .applyInArrow(go, "doc_id long, n_words long, n_hit long, exact array<long>, near array<long>")
    found = settle(found.withColumn("key", F.array_join("near", ",")).withColumn("own", F.array_join("exact", ",")), "decontam-documents")
    members = windows.join(known.where("wid = cls").select("words", "cls"), "words").select("cls", "item_id")

    def sets(key: str, classes: str) -> DataFrame:
        each = found.where(F.col(key) != "").groupBy(key, classes).agg(F.count(F.lit(1)).alias("_n"))
        return each.select(key, "_n", F.explode(classes).alias("cls")).join(members, "cls").groupBy(key, "_n", "item_id").agg(F.lit(1).alias("_"))
    own = settle(sets("own", "exact"), "decontam-sets")
    ids = own.select("own", F.col("item_id").alias("text"))
    digest = joined_sha256(ids, "own", "text").withColumnsRenamed({"n": "n_items", "sha256": "items_sha256"})
    digest = settle(digest.join(own.select("own", "_n").distinct(), "own"), "decontam-digests")
    near = settle(sets("key", "near").groupBy("key", "_n").agg(F.count(F.lit(1)).alias("n_near")), "decontam-near")

    hit = settle(join_counted(found.where("key <> ''").drop("exact", "near"), near, "key", "_n"), "decontam-near-documents")
    zero, none = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    exact = join_counted(hit.where("own <> ''"), digest, "own", "_n")
    rest = hit.where("own = ''").unionByName(found.where("key = ''").drop("exact", "near").withColumn("n_near", zero)) \
        .withColumn("n_items", zero).withColumn("items_sha256", none)
    return exact.unionByName(rest).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "n_near")
