"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed, and more of them where
they are very short; runs found more than once
anywhere keep their first occurrence, and the sentences of all others go.
"""

from __future__ import annotations

import re
from itertools import accumulate, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.rolling import sliding_min
from netsleuth.llm.util import join_counted, settle, with_row_id

#: Sentences of a run, and words that a run has at least: a run of a few very
#: short sentences says nothing alone and goes on, forwards and backwards.
RUN, MIN_WORDS = 3, 10
#: Sentences of more words are cut behind commas, semicolons and colons, and
#: before each word whose hash is the least among NEAR words on either side: the
#: words around a cut decide on it, not where the sentence starts or ends.  Only
#: stretches without such a word are cut by number, from the cut before them on.
LONG_SENTENCE, NEAR = 25, 3
_ENDS = re.compile(r"[.!?]+(?=\s)|\n")
_WORD = re.compile(r"\S+")
_RARE_SPACE = re.compile(r"[^\S \n]")


_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)       # odd multipliers that mix a word and the next


def _least(words: list[str], sizes: list[int]) -> list[list[int]]:
    """For each of several sentences of ``sizes`` words: numbers of the words
    that, with the next one, have a smaller hash than the NEAR words before and
    no greater one than those behind, all within the sentence."""
    w = np.fromiter((crc32(x.encode("utf-8", "surrogatepass")) for x in words), np.uint64, len(words))
    stop = np.cumsum(sizes)
    after = np.append(w[1:], np.uint64(0))
    after[stop - 1] = 0                                             # a sentence's last word has no next one
    h = (w + np.uint64(1)) * _PAIR[0] + after * _PAIR[1]
    h = (h ^ h >> np.uint64(29)) * _PAIR[1]
    n, least = len(h), sliding_min(h, NEAR)
    mid = h[NEAR:n - NEAR]
    at = np.flatnonzero((mid < least[:n - 2 * NEAR]) & (mid <= least[NEAR + 1:])) + NEAR
    which = np.searchsorted(stop, at, side="right")
    place = at - (stop - sizes)[which]
    inside = (place >= NEAR) & (place < np.asarray(sizes)[which] - NEAR)
    out: list[list[int]] = [[] for _ in sizes]
    for k, i in zip(which[inside].tolist(), place[inside].tolist()):
        out[k].append(i)
    return out


def _parts(text: str, a: int, b: int, words: list[str], least: list[int]) -> list[tuple[int, int]]:
    """The pieces of a long sentence."""
    n = len(words)
    first = {0, n, *least, *[i for i, w in enumerate(words, 1) if w[-1] in ",;:"]}
    cuts = [i for x, z in pairwise(sorted(first)) for i in range(x, z, LONG_SENTENCE) if i]
    stops = list(accumulate(map(len, words)))                      # ends of the words, were there no blanks
    whole = text[a:b]
    if stops[-1] + n - 1 == len(whole.strip()):                    # one blank between words
        lead = a + len(whole) - len(whole.lstrip())
        cuts = [lead + stops[i - 1] + i - 1 for i in cuts]
    else:
        ends = [m.end() for m in _WORD.finditer(text, a, b)]
        cuts = [ends[i - 1] for i in cuts]
    return list(zip([a, *cuts], [*cuts, b]))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the sentences; together they are the whole text.  A
    sentence ends behind its mark or line break; blanks belong to the next."""
    out, long, at, count = [], [], 0, text.count
    plain = not _RARE_SPACE.search(text)
    for z in [*[m.end() for m in _ENDS.finditer(text)], len(text)]:
        if z > at:
            # too few blanks for more words, or few words
            if not (plain and count(" ", at, z) < LONG_SENTENCE) and len(words := text[at:z].split()) > LONG_SENTENCE:
                long.append((len(out), words))
            out.append((at, z))
            at = z
    if long:
        lower = [text[a:z].lower().split() for a, z in (out[i] for i, _ in long)]
        least = _least([w for ws in lower for w in ws], [len(ws) for ws in lower])
        done, whole = 0, out
        out = []
        for (i, words), places in zip(long, least):
            out += whole[done:i]
            out += _parts(text, *whole[i], words, places)
            done = i + 1
        out += whole[done:]
    return out


def _bounds(words: list[int], run: int, min_words: int) -> list[tuple[int, int]]:
    """[first, stop) of each run: the shortest of ``run`` sentences and
    ``min_words`` words from each first sentence on, and up to each last one.
    All of a text with fewer words is one run."""
    n = len(words)
    if n < run:
        return []
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n + 1)
    stop = np.maximum(np.searchsorted(total, total[:-1] + min_words), at[:-1] + run)          # from each first sentence
    first = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at[1:] - run)
    key = np.unique(np.concatenate([(at[:-1] * (n + 1) + stop)[stop <= n], (first * (n + 1) + at[1:])[first >= 0]]))
    return list(zip((key // (n + 1)).tolist(), (key % (n + 1)).tolist())) or [(0, n)]


def runs(text: str, run: int = RUN, min_words: int = MIN_WORDS) -> tuple[int, list[int], list[int], list[bytes]]:
    """The number of sentences, and of each run the first and the last sentence
    and a 128-bit hash; sentences without a word are passed over, so that empty
    lines do not matter.  Words are compared in lower case, white space does not
    matter."""
    import xxhash
    digest = xxhash.xxh3_128_digest
    parts = sentences(text)
    at, size, plain = [], [], []
    for k, (a, b) in enumerate(parts):
        if w := text[a:b].lower().split():
            at.append(k)
            size.append(len(w))
            plain.append(" ".join(w).encode("utf-8", "surrogatepass"))
    found = _bounds(size, run, min_words)
    return len(parts), [at[i] for i, _ in found], [at[z - 1] for _, z in found], [digest(b" ".join(plain[i:z])) for i, z in found]


def sentence_runs(texts: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``(_rid, doc_id, k, last, h1, h2)`` of every run of every text, and a row
    for each text with ``k`` -1, its number of sentences in ``last`` and no hash."""
    def go(batches):
        for b in batches:
            rids, ids, ks, lasts, hashes, sizes = [], [], [], [], [], []
            for rid, doc, text in zip(b.column("_rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                n, k, last, h = runs(text.as_py() or "", run, min_words)
                rids.append(rid)
                ids.append(doc)
                sizes.append(len(k) + 1)
                ks.append(-1)
                ks += k
                lasts.append(n)
                lasts += last
                hashes.append(bytes(16))
                hashes += h
                if len(ks) > 100_000:
                    yield out(rids, ids, ks, lasts, hashes, sizes)
                    rids, ids, ks, lasts, hashes, sizes = [], [], [], [], [], []
            yield out(rids, ids, ks, lasts, hashes, sizes)

    def out(rids, ids, ks, lasts, hashes, sizes):
        row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        k, h = np.array(ks, np.int64), np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(rids, pa.int64()).take(row), pa.array(ids, pa.int64()).take(row), pa.array(k), pa.array(lasts, pa.int64()),
             *[pa.array(np.ascontiguousarray(h[:, i]), pa.int64(), mask=k < 0) for i in (0, 1)]], ["_rid", "doc_id", "k", "last", "h1", "h2"])
    return texts.mapInArrow(go, "_rid long, doc_id long, k long, last long, h1 long, h2 long")


def repeated_sentences(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``(_rid, n_sentences, gone)`` of every row; ``gone``: (first, last)
    sentence numbers of its runs that are not the first occurrence.  First is
    the smallest doc_id (nulls last), then table order, then place.

    Hashes are counted before they are shuffled; only runs whose first half of
    the hash repeats go on to the exact grouping by all 128 bits.  The counts
    tell the hot hashes, whose runs are not sent to one task."""
    found = settle(sentence_runs(with_row_id(docs, id_col, text_col), run, min_words), "sentence-runs")
    each = found.where("k >= 0")
    twice = settle(each.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sentence-twice")
    near = settle(join_counted(each, twice, "h1", "n"), "sentence-candidates")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "_rid", "k")
    first = settle(near.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")).where("n > 1")
                   .select("h1", "h2", "n", F.col("p._rid").alias("r0"), F.col("p.k").alias("k0")), "sentence-firsts")
    again = join_counted(near, first, ["h1", "h2"], "n").where("_rid <> r0 or k <> k0")
    count = found.where("k < 0").select("_rid", F.lit(None).cast("struct<k: bigint, last: bigint>").alias("g"), F.col("last").alias("n"))
    rows = again.select("_rid", F.struct("k", "last").alias("g"), F.lit(None).cast("long").alias("n")).unionByName(count)
    return settle(rows.groupBy("_rid").agg(F.max("n").alias("n_sentences"), F.collect_list("g").alias("gone")), "sentence-repeats")


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``(doc_id, n_sentences, n_removed, kept_text, removed_spans)``, one row
    per row of ``docs``; ``removed_spans``: (start, stop) in characters.

    Null texts have no sentence and stay null; texts of fewer sentences than a
    run stay whole; repeated rows lose what they share with the first of them;
    other columns are ignored; an empty table gives an empty one."""
    gone = repeated_sentences(docs, run, min_words, id_col, text_col)
    texts = with_row_id(docs, id_col, text_col).join(gone, "_rid").select("doc_id", "text", "n_sentences", "gone")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = ["doc_id", "n_sentences", "n_removed", "kept_text", "removed_spans"]

    def go(batches):
        for b in batches:
            rows, size = [], 0
            for doc, t, n, g in zip(b.column("doc_id"), b.column("text"), b.column("n_sentences").to_pylist(), b.column("gone").to_pylist()):
                text = t.as_py()
                parts = sentences(text) if g else []               # only texts that lose something are split again
                out = bytearray(len(parts))
                for x in g:
                    out[x["k"]:x["last"] + 1] = b"\1" * (x["last"] + 1 - x["k"])
                cut: list[dict] = []
                for (a, z), o in zip(parts, out):
                    if o and cut and cut[-1]["stop"] == a:
                        cut[-1]["stop"] = z
                    elif o:
                        cut.append({"start": a, "stop": z})
                kept = text if not cut else "".join(text[a:z] for (a, z), o in zip(parts, out) if not o)
                rows.append((doc.as_py(), n, sum(out), kept, cut))
                size += len(kept or "")
                if size > 1 << 22:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return texts.mapInArrow(go, "doc_id long, n_sentences long, n_removed long, kept_text string, "
                                "removed_spans array<struct<start: bigint, stop: bigint>>")
