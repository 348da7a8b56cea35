"""Cross-entropy difference scores.

A target and a background bigram model share one vocabulary of words and
bigrams, order and smoothing; the background counts are scaled to the target's
number of words, so that neither gains by its size.  Each word of a document
costs its negative log probability under both; the mean difference is the
score: negative means closer to the target.  A document's own counts are taken
out of the model it belongs to.

Every distinct word and bigram of the corpus is counted, by a hash of 63 bits
and its kind; the vocabulary grows with the corpus and is never in one place.
Documents travel in chunks.  A chunk sends each of its distinct n-grams with
its own counts, once, to the bucket that the hash belongs to; the bucket adds
them up and answers every chunk in the order of its question.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.rolling import Prefix, mix
from netsleuth.llm.util import as_bytes, settle, table_partitions

#: Bytes of text of a chunk (a longer document is a chunk by itself) and, about, of a bucket.
CHUNK, BUCKET = 1 << 22, 1 << 23
#: Weight of the word model in the bigram model, and of each word in the word model.
PAIR_PRIOR, WORD_PRIOR = 4.0, 0.5
PIECE = 1 << 22
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of each word (A-Z lower-cased, ASCII white space between)."""
    out = []
    at = 0
    while at < len(text):  # pieces end at white space, so that no word is cut
        stop = len(text)
        if stop - at > PIECE:
            stop = next((i + 1 for i in range(at + PIECE, len(text)) if IS_SPACE[text[i]]), len(text))
        buf = LOWER[np.frombuffer(text[at:stop], np.uint8)]
        space = np.concatenate([[True], IS_SPACE[buf], [True]])
        start = np.flatnonzero(space[:-1] & ~space[1:])
        end = np.flatnonzero(~space[:-1] & space[1:])
        out.append(Prefix(buf).spans(start, end))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _ngrams(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of (word, pair, context) of each word.  The first word follows an
    empty word."""
    h = word_hashes(text)
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if len(h) else h
    return h, mix(before * np.uint64(0x9FB21C651E98DF25) ^ h), before


def _losses(found, own, target: bool, totals, vocabulary: int) -> tuple[float, float]:
    """Mean loss under the target and the background model.  ``found``: counts
    (word, pair, context) of each word in either; ``own``: in the document."""
    n = len(own[0])
    size = max(1, totals[0] - (n if target else 0))
    out = []
    for (word, pair, context), total, mine in zip(found, totals, (target, not target)):
        m = 1 if mine else 0
        total = total - n * m
        scale = size / max(1, total)
        p_word = ((word - m * own[0]) * scale + WORD_PRIOR) / (total * scale + WORD_PRIOR * vocabulary)
        follow = np.maximum(context - m * own[2], 0) * scale
        both = np.minimum((pair - m * own[1]) * scale, follow)
        out.append(float(-np.log((both + PAIR_PRIOR * p_word) / (follow + PAIR_PRIOR)).mean()))
    return out[0], out[1]


def _own(x: np.ndarray) -> np.ndarray:
    """How often each value occurs among all."""
    _, inv, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[inv]


def _among(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each value of ``x`` occurs in ``of``."""
    names, n = np.unique(of, return_counts=True)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return np.where(names[at] == x, n[at], 0)


def _pack(*columns: np.ndarray) -> bytes:
    """64-bit columns of one length, compressed byte by byte of equal weight."""
    x = np.stack([c.astype(np.uint64) for c in columns])  # one by one: together they would become floats
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(*x.shape, 8).transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, k: int, n: int) -> np.ndarray:
    """The ``k`` columns of ``n`` values that were packed."""
    raw = np.frombuffer(pa.decompress(data, decompressed_size=k * n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(k, 8, n).transpose(0, 2, 1)).view(np.uint64).reshape(k, n)


def _chunks(marked: DataFrame) -> DataFrame:
    """``(chunk, n_bytes, doc_ids, targets, sizes, texts)``: documents of a
    task, about CHUNK bytes a row; ``texts`` are compressed."""
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        rows, size = [], 0
        for b in batches:
            for row in zip(b.column("doc_id").to_pylist(), b.column("target").to_pylist(), as_bytes(b.column("text"))):
                more = len(row[2] or b"")
                if rows and size + more > CHUNK:
                    yield chunk((task << 33) + k, rows, size)
                    rows, size, k = [], 0, k + 1
                rows.append(row)
                size += more
        if rows:
            yield chunk((task << 33) + k, rows, size)

    def chunk(k, rows, size):
        ids, targets, texts = zip(*rows)
        data = pa.compress(b"".join(t or b"" for t in texts), codec="zstd", asbytes=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([targets], pa.list_(pa.bool_())),
             pa.array([[len(t or b"") for t in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())],
            ["chunk", "n_bytes", "doc_ids", "targets", "sizes", "texts"])
    return marked.mapInArrow(run, "chunk long, n_bytes long, doc_ids array<long>, targets array<boolean>, sizes array<long>, texts binary")


def _read(batch):
    """(chunk, doc_ids, targets, n-grams of each document, distinct n-grams,
    place among them of each word and then of each pair) of each row."""
    for i in range(batch.num_rows):
        at = {c: batch.column(c)[i].as_py() for c in ("chunk", "n_bytes", "doc_ids", "targets", "sizes", "texts")}
        data = pa.decompress(at["texts"], decompressed_size=at["n_bytes"], codec="zstd", asbytes=True) if at["n_bytes"] else b""
        stop = np.cumsum(at["sizes"])
        docs = [_ngrams(data[z - n:z]) for z, n in zip(stop.tolist(), at["sizes"])]
        words, pairs = (np.concatenate([d[j] for d in docs]) for j in (0, 1))
        # the lowest bit tells words from pairs
        names, place = np.unique(np.concatenate([words & ~np.uint64(1), pairs | np.uint64(1)]), return_inverse=True)
        yield at["chunk"], at["doc_ids"], at["targets"], docs, names, place


def _parts(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur among sorted hashes, and where each begins, with
    the end behind: as long as the hashes at most, however many buckets."""
    of = ((names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return of[first], np.append(first, len(of))


def _answers(chunks: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, chunk, reply, words, t, b)``.  ``reply``: target and background
    counts of the chunk's distinct n-grams of the bucket, in the order of their
    hashes; and for each bucket one row without a chunk: its distinct words and
    the words of either model."""
    def ask(batches):
        for batch in batches:
            for chunk, _, targets, docs, names, place in _read(batch):
                of = np.repeat(np.array(targets, bool), [len(d[0]) for d in docs])
                t = np.bincount(place[np.concatenate([of, of])], minlength=len(names))
                b = np.bincount(place, minlength=len(names)) - t
                bucket, edge = _parts(names, buckets)
                for some in np.array_split(np.arange(len(bucket)), max(1, len(bucket) // 1000)):
                    sent = [_pack(np.diff(names[x:z], prepend=np.uint64(0)), t[x:z], b[x:z]) for x, z in zip(edge[some], edge[some + 1])]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[some], pa.int32()), pa.array([chunk] * len(some), pa.int64()),
                                                      pa.array(edge[some + 1] - edge[some], pa.int64()), pa.array(sent, pa.binary())],
                                                     ["bucket", "chunk", "n", "grams"])

    def add(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        got = [_unpack(g, 3, n) for g, n in zip(rows.column("grams").to_pylist(), sizes)]
        names, place = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), return_inverse=True)
        t, b = (np.zeros(len(names), np.int64) for _ in range(2))
        at = np.cumsum([0, *sizes])
        for x, z, g in zip(at, at[1:], got):  # an n-gram is once in a chunk
            t[place[x:z]] += g[1].view(np.int64)
            b[place[x:z]] += g[2].view(np.int64)
        replies = [_pack(t[place[x:z]], b[place[x:z]]) for x, z in zip(at, at[1:])]
        word = (names & np.uint64(1)) == 0
        none, bucket = [0] * len(sizes), rows.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * (len(sizes) + 1), pa.int32()), "chunk": pa.array([*rows.column("chunk").to_pylist(), None], pa.int64()),
                         "reply": pa.array([*replies, None], pa.binary()), "words": pa.array([*none, int(word.sum())], pa.int64()),
                         "t": pa.array([*none, int(t[word].sum())], pa.int64()), "b": pa.array([*none, int(b[word].sum())], pa.int64())})
    return (chunks.mapInArrow(ask, "bucket int, chunk long, n long, grams binary").groupBy("bucket")
            .applyInArrow(add, "bucket int, chunk long, reply binary, words long, t long, b long"))


def with_target(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, target, text)``: whether the id is among ``target_ids(doc_id)``."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(True))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.join(ids.hint("shuffle_hash"), "doc_id", "left").select("doc_id", F.coalesce("target", F.lit(False)).alias("target"), "text")


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, target, target_loss, background_loss, score)``.

    The target corpus are the documents of ``target_ids``, the background all
    others; counts cover all of both.  Null, empty and wordless texts have no
    words and null losses.  Without any target document its model is uniform.
    Repeated rows count as often as they occur; a null id is background; other
    columns are ignored; an empty table gives an empty one."""
    chunks = settle(_chunks(with_target(docs, target_ids, id_col, text_col)), "lm-chunks")
    n_bytes = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    answers = settle(_answers(chunks, buckets := max(table_partitions(docs), -(-n_bytes // BUCKET))), "lm-answers")
    words, *totals = (x or 0 for x in answers.where("chunk is null").agg(F.sum("words"), F.sum("t"), F.sum("b")).first())
    vocabulary = max(1, words)                       # the words counted, at every size
    replies = (answers.where("chunk is not null").groupBy("chunk")
               .agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias("replies")))

    def run(batches):
        for batch in batches:
            for (_, ids, targets, grams, names, place), got in zip(_read(batch), batch.column("replies")):
                sizes = np.diff(_parts(names, buckets)[1])        # each bucket asked has answered, in this order
                counts = [_unpack(r["reply"], 2, n) for r, n in zip(got.as_py() or (), sizes, strict=True)]
                counts = np.concatenate([np.zeros((2, 0), np.uint64), *counts], axis=1).astype(np.int64)
                n_words, at, out = len(place) // 2, 0, []
                for (word, pair, context), target in zip(grams, targets):
                    n = len(word)
                    if n:
                        w, p = counts[:, place[at:at + n]], counts[:, place[n_words + at:n_words + at + n]]
                        before = np.concatenate([np.zeros((2, 1), np.int64), w[:, :-1]], axis=1)
                        x, y = _losses(list(zip(w, p, before)), (_own(word), _own(pair), _among(context, word)), target, totals, vocabulary)
                        out.append((n, x, y, x - y))
                    else:
                        out.append((0, None, None, None))
                    at += n
                n, x, y, diff = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(targets, pa.bool_()), pa.array(x, pa.float64()),
                                                  pa.array(y, pa.float64()), pa.array(diff, pa.float64())],
                                                 ["doc_id", "n_words", "target", "target_loss", "background_loss", "score"])
    return chunks.join(replies.hint("merge"), "chunk", "left").mapInArrow(
        run, "doc_id long, n_words long, target boolean, target_loss double, background_loss double, score double")
