"""Exact repeated substrings by suffix arrays of shards.

A document byte is removed if it lies in a string of ``LENGTH`` bytes that also
starts anywhere else.

1. *Regions.*  Every window of ``LENGTH`` bytes is known by the least hash of
   its ``GRAM``-byte grams; equal windows agree in it.  Consecutive starts with
   the same value form a region.  Only regions whose value occurs twice or more,
   there or elsewhere, can hold a repeat.
2. *Shards.*  Regions of one value meet in one shard; equal regions are counted
   first and travel once, with their number.  A value with more different
   regions than a shard holds is split: within its regions, windows are told
   apart by the least gram under a second hash, then a third, and so on.  Equal
   windows agree in each of them.
3. *Suffix array* of each shard by induced sorting: suffixes are classified,
   the leftmost-smaller substrings sorted by recursion, and the rest induced in
   linear time.  The permuted common-prefix array follows from its irreducible
   values.  A run of suffixes with common prefixes of ``LENGTH`` or more and
   more than one occurrence is a repeat.
4. The repeated starts go back to all copies of their region, and each document
   joins its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.rolling import Prefix, mix, sliding_min
from netsleuth.llm.util import as_bytes, settle, table_partitions, with_row_id

LENGTH = 400
GRAM = 160
#: Bytes of a shard's array, and different regions of one value beyond which it
#: is split by a further hash; hashes before what is left is compared window by
#: window (windows that differ, but share the least gram under every hash).
SHARD_BYTES = 1 << 20
SHARD_REGIONS = 1500
SPLITS = 6
#: Bits of the filter that keeps documents without candidates out of a join.
FILTER_BITS = 1 << 24


# --- suffix array -----------------------------------------------------------

def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor (the last is)."""
    n = len(t)
    up = np.empty(n, bool)
    up[-1] = True
    if n > 1:
        change = np.flatnonzero(t[1:] != t[:-1])
        rise = t[change] < t[change + 1]
        spans = np.diff(np.concatenate([[-1], change]))
        body = np.repeat(rise, spans)
        up[:len(body)] = body
        up[len(body):n - 1] = True
    return up


def _induce_blocks(t, up, seeds, size):
    """Suffixes in the order induced from the ordered leftmost-smaller
    ``seeds``, one bucket at a time: all of a bucket's entries that are known
    induce their predecessors at once."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.full(n, -1, np.int64)
    seed_char = t[seeds]
    by = seeds[np.argsort(seed_char, kind="stable")]
    seed_stop = np.cumsum(np.bincount(seed_char, minlength=size))
    seed_start = np.concatenate([[0], seed_stop[:-1]])
    at = heads.copy()

    def place(p, down):
        c = t[p]
        order = np.argsort(c, kind="stable")
        c, p = c[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        num = np.diff(np.concatenate([first, [len(c)]]))
        rank = np.arange(len(c)) - np.repeat(first, num)
        if down:
            sa[at[c] - 1 - rank] = p
            at[c[first]] -= num
        else:
            sa[at[c] + rank] = p
            at[c[first]] += num

    used = np.flatnonzero(counts)
    for c in used:
        done = heads[c]
        while done < at[c]:
            stop = at[c]
            p = sa[done:stop] - 1
            done = stop
            p = p[p >= 0]
            p = p[~up[p]]
            if len(p):
                place(p, False)
        p = by[seed_start[c]:seed_stop[c]] - 1
        p = p[p >= 0]
        if len(p):
            place(p[~up[p]], False)
    larger = at
    at = tails.copy()
    sa[0] = n - 1
    for c in used[::-1]:
        done = tails[c]
        while done > at[c]:
            start = at[c]
            p = sa[start:done][::-1] - 1
            done = start
            p = p[p >= 0]
            p = p[up[p]]
            if len(p):
                place(p, True)
        p = sa[heads[c]:larger[c]][::-1] - 1
        p = p[p >= 0]
        p = p[up[p]]
        if len(p):
            place(p, True)
    sa[0] = n - 1
    return sa


def _induce_steps(t, up, seeds, size):
    """The same, entry by entry, for large alphabets of short buckets."""
    n = len(t)
    counts = np.bincount(t, minlength=size)
    tails = np.cumsum(counts)
    heads = (tails - counts).tolist()
    text, small = t.tolist(), up.tolist()
    sa = [-1] * n
    end = tails.tolist()
    spots = []
    for p in seeds.tolist()[::-1]:
        c = text[p]
        end[c] -= 1
        sa[end[c]] = p
        spots.append(end[c])
    for i in range(n):
        p = sa[i] - 1
        if p >= 0 and not small[p]:
            c = text[p]
            sa[heads[c]] = p
            heads[c] += 1
    for i in spots:
        sa[i] = -1
    sa[0] = n - 1
    end = tails.tolist()
    for i in range(n - 1, -1, -1):
        p = sa[i] - 1
        if p >= 0 and small[p]:
            c = text[p]
            end[c] -= 1
            sa[end[c]] = p
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``t`` (values below ``size``, the last one the only and
    smallest of its kind)."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    up = suffix_types(t)
    is_seed = np.zeros(n, bool)
    is_seed[1:] = up[1:] & ~up[:-1]
    seeds = np.flatnonzero(is_seed)
    induce = _induce_blocks if size <= 1024 else _induce_steps
    order = induce(t, up, seeds, size)
    ranked = order[is_seed[order]]
    # equal substrings from one seed to the next get the same name
    nth = np.empty(n, np.int64)
    nth[seeds] = np.arange(len(seeds))
    stop = np.append(seeds[1:], n - 1)[nth[ranked]] + 1
    mark = Prefix(t).spans(ranked, stop)
    length = stop - ranked
    new = np.concatenate([[True], (mark[1:] != mark[:-1]) | (length[1:] != length[:-1])])
    names = np.cumsum(new) - 1
    if names[-1] + 1 < len(seeds):
        reduced = np.empty(len(seeds), np.int64)
        reduced[nth[ranked]] = names
        ranked = seeds[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(t, up, ranked, size)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common-prefix array: for each suffix, in text order, how much
    it shares with the one before it in the suffix array.

    A value is irreducible if the preceding symbols of both suffixes differ;
    all others are one less than the value to their left."""
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    whole = (before <= 0) | (i == 0)
    whole[1:] |= t[:-1] != t[before[1:] - 1]
    at = np.flatnonzero(whole & (before >= 0))
    value = np.zeros(n, np.int64)
    text = np.concatenate([t.astype(np.uint16), np.arange(1, 9, dtype=np.uint16) + np.uint16(60000)])
    words = np.ndarray((n + 4,), np.uint64, buffer=text.tobytes(), strides=(2,))
    a, b, live, got = at.copy(), before[at], np.arange(len(at)), np.zeros(len(at), np.int64)
    while len(live):
        x = words[np.minimum(a, n + 3)] ^ words[np.minimum(b, n + 3)]
        same = x == 0
        end = ~same
        y = x[end]
        got[live[end]] += (((y & np.uint64(0xFFFF)) == 0).astype(np.int64) + ((y & np.uint64(0xFFFFFFFF)) == 0)
                           + ((y & np.uint64(0xFFFFFFFFFFFF)) == 0))
        live, a, b = live[same], a[same] + 4, b[same] + 4
        got[live] += 4
    value[at] = got
    base = np.where(whole, i, -1)
    base = np.maximum.accumulate(base)
    return np.maximum(0, value[base] - (i - base))


def repeated_starts(regions: list[bytes], starts: list[int], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each region, which of its first ``starts`` windows occur more than
    once among all, counting a region ``weights`` times."""
    sizes = np.array([len(r) for r in regions]) + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    t = np.ones(first[-1] + 1, np.int64)
    for r, f in zip(regions, first):
        t[f:f + len(r)] = np.frombuffer(r, np.uint8)
        t[f:f + len(r)] += 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    shared = common_prefixes(t, sa)
    weight = np.zeros(len(t), np.int64)
    for f, n, w in zip(first, starts, weights):
        weight[f:f + n] = w
    run = np.cumsum(np.concatenate([[True], shared[sa[1:]] < length])) - 1
    total = np.bincount(run, weights=weight[sa])
    often = np.zeros(len(t), bool)
    often[sa] = total[run] >= 2
    return [np.flatnonzero(often[f:f + n]) for f, n in zip(first, starts)]


def intervals(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of consecutive sorted numbers."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


# --- the job ----------------------------------------------------------------

def regions_of(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(value, region hash, first start, number of starts, inner) arrays;
    ``inner``: the gram of the value lies at more than one place of the text,
    so that windows of one region may equal each other."""
    buf = np.frombuffer(data, np.uint8)
    if len(buf) < length:
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, bool),)
    prefix, width = Prefix(buf), length - gram + 1
    grams = prefix.windows(gram)
    least = sliding_min(grams, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    stop = np.append(first[1:], len(least))
    value = least[first]
    # a gram is the least of some window if it equals the greatest minimum around it
    edge = np.full(width - 1, np.iinfo(np.uint64).max, np.uint64)
    places = np.flatnonzero(~sliding_min(np.concatenate([edge, ~least, edge]), width) == grams)
    names, times = np.unique(grams[places], return_counts=True)
    inner = np.isin(value, names[times > 1]) if (times > 1).any() else np.zeros(len(value), bool)
    return value.view(np.int64), prefix.spans(first, stop - 1 + length).view(np.int64), first, stop - first, inner


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of regions, and one row (``starts`` = -1) for each document."""
    def run(batches):
        for b in batches:
            rid_col, doc_col = b.column("_rid").to_pylist(), b.column("doc_id").to_pylist()
            cols, docs_out, size = [], [], 0

            def out():
                parts = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*cols)) or [()] * 6)]
                k, m = len(parts[0]), len(docs_out)
                none = lambda kind, c: pa.nulls(c, kind)
                return pa.RecordBatch.from_arrays([
                    pa.concat_arrays([pa.array(parts[0], pa.int64()), none(pa.int64(), m)]),
                    pa.concat_arrays([pa.array(parts[1], pa.int64()), none(pa.int64(), m)]),
                    pa.concat_arrays([pa.array(parts[2], pa.int64()), pa.array([d[0] for d in docs_out], pa.int64())]),
                    pa.concat_arrays([pa.array(parts[3], pa.int64()), pa.array([d[2] for d in docs_out], pa.int64())]),
                    pa.concat_arrays([pa.array(parts[4], pa.int64()), pa.array([-1] * m, pa.int64())]),
                    pa.concat_arrays([none(pa.int64(), k), pa.array([d[1] for d in docs_out], pa.int64())]),
                    pa.concat_arrays([none(pa.string(), k), pa.array([d[3] for d in docs_out], pa.string())]),
                    pa.concat_arrays([pa.array(parts[5].astype(bool)), none(pa.bool_(), m)])],
                    ["value", "region", "_rid", "first", "starts", "doc_id", "sha256", "inner"])
            for rid, doc, text in zip(rid_col, doc_col, as_bytes(b.column("text"))):
                text = text or b""
                v, r, f, n, inner = regions_of(text, length, gram)
                if len(v):
                    cols.append((v, r, np.full(len(v), rid), f, n, inner))
                docs_out.append((rid, doc, len(text), hashlib.sha256(text).hexdigest()))
                size += len(v)
                if size > 200_000:
                    yield out()
                    cols, docs_out, size = [], [], 0
            yield out()
    return docs.mapInArrow(run, "value long, region long, _rid long, first long, starts long, doc_id long, sha256 string, inner boolean")


def _among(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` that may be among ``rows(_rid)``: a bitmap of ``FILTER_BITS``
    hashed row numbers, whatever their number; none that is among them is lost."""
    place = (F.pmod(F.xxhash64("_rid"), F.lit(FILTER_BITS)) + 1).cast("long")
    parts = (rows.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect())
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts:
        at = (r["b"] - 1) * len(r["m"])
        bits[at:at + len(r["m"])] = np.frombuffer(bytes(r["m"]), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes

    @F.pandas_udf("boolean")
    def there(p: pd.Series) -> pd.Series:
        x = p.to_numpy() - 1
        return pd.Series((sent.value[x >> 3] >> (x & 7) & 1).astype(bool))
    return docs.where(there(place))


def _array_starts(pieces: DataFrame, length: int) -> DataFrame:
    """``(value, region, lo, hi)``: repeated starts in each region, by suffix
    arrays of shards of whole values."""
    def run(batches):
        held: list[tuple] = []
        size = 0

        def solve(rows):
            found = repeated_starts([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], length)
            out = [[], [], [], []]
            for r, at in zip(rows, found):
                if len(at):
                    lo, hi = intervals(at)
                    for x, y in zip(out, ([r[0]] * len(lo), [r[1]] * len(lo), lo.tolist(), hi.tolist())):
                        x.extend(y)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["value", "region", "lo", "hi"])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield solve(held)
    cols = ["value", "region", "bytes", "starts", "copies"]
    return (pieces.select(*cols).repartition(table_partitions(pieces), "value").sortWithinPartitions("value", "region")
            .mapInArrow(run, "value long, region long, lo long, hi long"))


def _split_again(pieces: DataFrame, length: int, gram: int, level: int) -> DataFrame:
    """``(whole, part, off, value, region, copies, starts, bytes)``: the regions
    (``whole``, ``part``) cut where the least gram under hash ``level`` changes;
    ``off``: windows before the cut."""
    names = ["whole", "part", "off", "value", "region", "copies", "starts", "bytes"]
    salt = mix(np.array([level], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))

    def run(batches):
        for b in batches:
            out, size = [], 0
            for value, region, data, starts, copies in zip(*(c.to_pylist() for c in b.columns)):
                prefix = Prefix(np.frombuffer(data, np.uint8))
                least = sliding_min(mix(prefix.windows(gram) ^ salt), length - gram + 1)[:starts]
                first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                stop = np.append(first[1:], len(least))
                key = mix(least[first] ^ mix(np.array([value], np.int64).view(np.uint64))).view(np.int64)
                for f, z, v, r in zip(first.tolist(), stop.tolist(), key.tolist(), prefix.spans(first, stop - 1 + length).view(np.int64).tolist()):
                    out.append((value, region, f, v, r, copies, z - f, data[f:z - 1 + length]))
                    size += z - f + length
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 7 + [pa.binary()])], names)
    return pieces.select("value", "region", "bytes", "starts", "copies").mapInArrow(
        run, "whole long, part long, off long, value long, region long, copies long, starts long, bytes binary")


def _starts(pieces: DataFrame, length: int, gram: int, level: int = 1) -> DataFrame:
    """``(value, region, lo, hi)``: repeated starts in each region of
    ``pieces``; those of ``many`` regions a value are split first."""
    few = _array_starts(pieces.where("not many"), length)
    many = pieces.where("many")
    if not many.limit(1).count():
        return few
    if level > SPLITS:
        return few.unionByName(_window_starts(many, length))
    parts = settle(_split_again(many, length, gram, level), f"repeat-split-{level}")
    kinds = parts.groupBy("value", "region").agg(F.sum("copies").alias("copies"), F.first("starts").alias("starts"), F.first("bytes").alias("bytes"))
    crowd = kinds.groupBy("value").agg((F.count(F.lit(1)) > SHARD_REGIONS).alias("many"))
    found = settle(_starts(settle(kinds.join(crowd, "value"), f"repeat-pieces-{level}"), length, gram, level + 1), f"repeat-starts-{level}")
    back = parts.select("whole", "part", "off", "value", "region").join(found, ["value", "region"]) \
        .select(F.col("whole").alias("value"), F.col("part").alias("region"), (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    return few.unionByName(back)


def _window_starts(pieces: DataFrame, length: int) -> DataFrame:
    """The same for what no further hash splits: windows are hashed (128 bits)
    and counted one by one."""
    def run(batches):
        for b in batches:
            for value, region, data, starts, copies in zip(*(c.to_pylist() for c in b.columns)):
                buf = np.frombuffer(data, np.uint8)
                one, two = Prefix(buf).windows(length)[:starts], Prefix(buf[::-1]).windows(length)[::-1][:starts]
                k = len(one)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, value)), pa.array(np.full(k, region)), pa.array(np.arange(k)), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64)), pa.array(np.full(k, copies))], ["value", "region", "lo", "w1", "w2", "copies"])
    cols = ["value", "region", "bytes", "starts", "copies"]
    each = settle(pieces.select(*cols).mapInArrow(run, "value long, region long, lo long, w1 long, w2 long, copies long"), "repeat-windows")
    often = each.groupBy("value", "w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("value", "w1", "w2")
    return each.join(often, ["value", "w1", "w2"]).select("value", "region", "lo", F.col("lo").alias("hi"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"):
    """(documents, spans): ``documents(_rid, doc_id, n_bytes, sha256)`` of every
    row, and ``spans(_rid, cuts)`` with the merged byte intervals to remove, as
    an array of (start, stop), of those rows that have any."""
    texts = with_row_id(docs, id_col, text_col)
    scan = settle(_scan(texts, length, gram), "repeat-regions")
    found = scan.where("starts >= 0").select("value", "region", "_rid", "first", "starts", "inner")
    groups = (found.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("a"), F.max("region").alias("b"),
                                         F.max("inner").alias("inner"))
              .where("n > 1 or inner").select("value", F.expr("n > 1 and a = b").alias("alike")))
    near = settle(found.drop("inner").join(groups, "value"), "repeat-candidates")
    # a value with one region only, found twice or more: all its windows repeat
    whole = near.where("alike").select("_rid", F.col("first").alias("lo"), (F.col("first") + F.col("starts") - 1).alias("hi"))
    kinds = settle(near.where("not alike").groupBy("value", "region")
                   .agg(F.min(F.struct("_rid", "first", "starts")).alias("r"), F.count(F.lit(1)).alias("copies"))
                   .select("value", "region", "copies", "r._rid", "r.first", "r.starts"), "repeat-kinds")
    many = settle(kinds.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_REGIONS)
                  .select("value", F.lit(True).alias("many")), "repeat-many")
    wanted = (kinds.join(many, "value", "left").groupBy("_rid")
              .agg(F.collect_list(F.struct("value", "region", "copies", "first", "starts", F.coalesce("many", F.lit(False)).alias("many"))).alias("k")))
    pieces = settle(_cut_pieces(_among(texts.select("_rid", "text"), kinds.select("_rid")).join(wanted, "_rid"), length), "repeat-pieces")
    starts = _starts(pieces, length, gram)
    back = (near.where("not alike").select("value", "region", "_rid", "first").join(settle(starts, "repeat-starts"), ["value", "region"])
            .select("_rid", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi")))
    spans = settle(_merge(whole.unionByName(back).groupBy("_rid").agg(F.collect_list(F.struct("lo", "hi")).alias("s")), length), "repeat-spans")
    documents = scan.where("starts < 0").select("_rid", "doc_id", F.col("first").alias("n_bytes"), "sha256")
    return documents, spans


def _cut_pieces(rows: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted regions of each text."""
    names = ["value", "region", "copies", "starts", "many", "bytes"]
    kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]

    def run(batches):
        for b in batches:
            out, size = [], 0
            for text, want in zip(as_bytes(b.column("text")), b.column("k")):
                for k in want.as_py():
                    data = text[k["first"]:k["first"] + k["starts"] - 1 + length]
                    out.append((k["value"], k["region"], k["copies"], k["starts"], k["many"], data))
                    size += len(data)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    return rows.select("text", "k").mapInArrow(run, "value long, region long, copies long, starts long, many boolean, bytes binary")


def _merge(rows: DataFrame, length: int) -> DataFrame:
    """Byte intervals covered by the windows that start in [lo, hi]."""
    def run(batches):
        for b in batches:
            out = []
            for s in b.column("s"):
                lo, hi = (s.values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(lo, kind="stable")
                lo, stop = lo[order], np.maximum.accumulate(hi[order] + length)
                first = np.concatenate([[0], np.flatnonzero(lo[1:] > stop[:-1]) + 1])
                last = np.append(first[1:] - 1, len(lo) - 1)
                out.append([{"start": x, "stop": y} for x, y in zip(lo[first].tolist(), stop[last].tolist())])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("_rid"), pa.array(out, kind)], ["_rid", "cuts"])
    return rows.select("_rid", "s").mapInArrow(run, "_rid long, cuts array<struct<start: bigint, stop: bigint>>")


def keep_outside(text: bytes, cuts) -> bytes:
    """The bytes outside the (start, stop) intervals."""
    at, out = 0, []
    for c in cuts:
        out.append(text[at:c["start"]])
        at = c["stop"]
    out.append(text[at:])
    return b"".join(out)


def dedup_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, cuts)``, one row per
    row of ``docs``.

    Texts are compared as UTF-8 bytes; null is empty; texts shorter than
    ``length`` keep all.  Repeated rows are copies of each other; null and
    repeated ids stay rows of their own; other columns are ignored; an empty
    table gives an empty one.  Only texts that lose a part are read again."""
    documents, spans = repeated_spans(docs, length, gram, id_col, text_col)
    gone = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["stop"] - c["start"])
    facts = settle(documents.join(spans, "_rid", "left")
                   .withColumn("n_removed", F.coalesce(gone, F.lit(0).cast("long"))), "repeat-facts")
    partly = facts.where("n_removed > 0 and n_removed < n_bytes").select("_rid", "cuts")
    texts = with_row_id(docs, id_col, text_col).select("_rid", "text")

    def run(batches):
        for b in batches:
            got = [hashlib.sha256(keep_outside(t, c.as_py())).hexdigest() for t, c in zip(as_bytes(b.column("text")), b.column("cuts"))]
            yield pa.RecordBatch.from_arrays([b.column("_rid"), pa.array(got, pa.string())], ["_rid", "kept"])
    kept = settle(_among(texts, partly.select("_rid")).join(partly, "_rid").select("_rid", "text", "cuts")
                  .mapInArrow(run, "_rid long, kept string"), "repeat-kept")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return facts.join(kept, "_rid", "left").select(
        "doc_id", "n_bytes", "n_removed", F.coalesce(F.size("cuts"), F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("n_removed") == 0, F.col("sha256")).when(F.col("n_removed") == F.col("n_bytes"), empty)
        .otherwise(F.col("kept")).alias("kept_sha256"), "cuts")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                    count_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; characters cut
    through go with them.  All rows and columns stay; null texts stay null;
    ``count_col``, if there is such a column, becomes the new text's length in
    characters where something was cut."""
    _, spans = repeated_spans(docs, length, gram, id_col, text_col)
    row = "_rid" if "_rid" not in docs.columns else "_rid_" + "_".join(docs.columns)
    cuts = "cuts" if "cuts" not in docs.columns else "cuts_" + "_".join(docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else keep_outside(t.encode(), s).decode("utf-8", "ignore")
                          for t, s in zip(texts, spans)], dtype=object)
    joined = (docs.withColumn(row, F.monotonically_increasing_id())
              .join(spans.select(F.col("_rid").alias(row), F.col("cuts").alias(cuts)), row, "left"))
    kept = F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col).cast("string"), F.col(cuts)))
    out = joined.withColumn(text_col, kept)
    if count_col in docs.columns:
        kind = docs.schema[count_col].dataType
        out = out.withColumn(count_col, F.when(F.col(cuts).isNull(), F.col(count_col)).otherwise(F.length(text_col).cast(kind)))
    return out.select(*docs.columns)
