"""Quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are
compared with the reference of its language by Jensen-Shannon distance.  The
references are exact counts over all documents of the language.  A histogram
only counts from a minimum length on, as short texts diverge by chance.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsleuth.llm.util import as_bytes, settle

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Common words of a language, and the lengths from which distances count.
COMMON_WORDS = 64
CHAR_MIN_WORDS, WORD_MIN_WORDS = 50, 50
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.30
#: The word limit of a text of n words is at least this base plus slope / sqrt(n):
#: a sample of n words diverges by about so much from its own distribution.
WORD_LIMIT_BASE, WORD_LIMIT_SLOPE = 0.12, 3.1
SYMBOLS = b"#*$%&|<>"
#: Character classes of UTF-8 bytes: lower case, upper case, digit, blank,
#: line break, sentence mark, symbol, other ASCII, byte of another letter.
CLASSES = 9
CLASS = np.array([8 if b >= 128 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57
                  else 4 if b in b"\r\n" else 3 if b in b" \t\x0b\x0c" else 5 if b in b".,;:!?'\"()-"
                  else 6 if b in SYMBOLS else 7 for b in range(256)], np.uint8)
PIECE = 1 << 22
DROP_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    runs = list(zip(*(words[i:] for i in range(width))))
    if len(set(runs)) == len(runs):
        return 0
    count = Counter(runs)
    last, total = -1, 0
    for i, r in enumerate(runs):
        if count[r] > 1:
            total += i + width - max(i, last)
            last = i + width
    return total


def base_counts(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return words, (len(words), chars, len(text.translate(None, DROP_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def class_counts(text: bytes) -> np.ndarray:
    out = np.zeros(CLASSES, np.int64)
    data = np.frombuffer(text, np.uint8)
    for s in range(0, len(data), PIECE):
        out += np.bincount(CLASS[data[s:s + PIECE]], minlength=CLASSES)
    return out


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 if one is
    empty."""
    sp, sq = p.sum(), q.sum()
    if not sp or not sq:
        return 0.0
    p, q = p / sp, q / sq
    m = (p + q) / 2

    def to_mean(a):
        at = a > 0
        return float((a[at] * np.log2(a[at] / m[at])).sum())
    return float(np.sqrt(max(0.0, (to_mean(p) + to_mean(q)) / 2)))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON_WORDS):
    """``{language: (class counts, common words, their counts with the rest last)}``.

    Exact over all documents; rows without language form a reference of their
    own (key None).  What comes to the driver is bounded by languages x
    (classes + common words)."""
    own = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def count(batches):
        for b in batches:
            words: dict = {}
            for lang, text in zip(b.column("lang").to_pylist(), as_bytes(b.column("text"))):
                c = words.setdefault(lang, Counter())
                c.update(text.lower().split())
                for k, n in enumerate(class_counts(text).tolist()):
                    if n:
                        c[k] += n
                if len(c) > 150_000:
                    yield from rows({lang: words.pop(lang)})
            yield from rows(words)

    def rows(words):
        for lang, c in words.items():
            items = list(c.items())
            for at in range(0, len(items), 50_000):
                part = items[at:at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()),
                     pa.array([None if isinstance(w, int) else w for w, _ in part], pa.binary()),
                     pa.array([w if isinstance(w, int) else None for w, _ in part], pa.int32()),
                     pa.array([n for _, n in part], pa.int64())], ["lang", "word", "class", "n"])

    counts = settle(own.mapInArrow(count, "lang string, word binary, class int, n long")
                    .groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "quality-counts")
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (counts.where("word is not null").withColumn("r", F.row_number().over(first)).where(F.col("r") <= common)
           .select("lang", "word", "n").collect())
    totals = {r[0]: r[1] for r in counts.where("word is not null").groupBy("lang").agg(F.sum("n")).collect()}
    classes = counts.where("class is not null").select("lang", "class", "n").collect()
    out = {}
    for lang in {r[0] for r in classes}:
        c = np.zeros(CLASSES)
        for r in classes:
            if r[0] == lang:
                c[r[1]] = r[2]
        words = sorted(((bytes(r[1]), r[2]) for r in top if r[0] == lang), key=lambda x: (-x[1], x[0]))
        freq = np.array([n for _, n in words] + [totals.get(lang, 0) - sum(n for _, n in words)], float)
        out[lang] = (c, {w: i for i, (w, _) in enumerate(words)}, freq)
    return out


def word_limit(n: int) -> float:
    """Largest word distance of a kept text of ``n`` words."""
    return max(MAX_WORD_DISTANCE, WORD_LIMIT_BASE + WORD_LIMIT_SLOPE / n ** 0.5)


def verdict(text: bytes | None, lang: str | None, refs: dict):
    """(base counts, base_failed, character distance, word distance, kept)."""
    words, base = base_counts(text or b"")
    n, repeat = base[0], base[4]
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    char_d = word_d = None
    if lang in refs:
        classes, place, freq = refs[lang]
        if n >= CHAR_MIN_WORDS:
            char_d = distance(class_counts(text), classes)
        if n >= WORD_MIN_WORDS:
            hist = np.zeros(len(freq))
            for w, k in Counter(text.lower().split()).items():
                hist[place.get(w, -1)] += k
            word_d = distance(hist, freq)
    kept = not failed and (char_d is None or char_d <= MAX_CHAR_DISTANCE) and (word_d is None or word_d <= word_limit(n))
    return base, failed, char_d, word_d, kept


def judge(docs: DataFrame, refs: dict, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, char_distance, word_distance)`` of every whole text.

    Null and empty texts have no words and fail.  A language without reference
    is judged by the base rules only.  Repeated rows and null ids are kept as
    rows; other columns are ignored; an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(refs)  # languages x common words
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "char_distance", "word_distance"]

    def run(batches):
        for b in batches:
            rows = []
            for lang, text in zip(b.column("lang").to_pylist(), as_bytes(b.column("text"))):
                base, failed, cd, wd, kept = verdict(text, lang, sent.value)
                rows.append((*base, failed, kept, cd, wd))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds)], names)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                        F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                             "base_failed boolean, kept boolean, char_distance double, word_distance double"))


def kept_documents(docs: DataFrame, refs: dict, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents that the rules reject.  Null and empty
    texts go, they have too few words; a null language is one of its own;
    repeated rows are judged alike; an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(refs)  # languages x common words

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([verdict(None if t is None else t.encode(), g, sent.value)[4] for t, g in zip(texts, langs)], dtype=bool)
    return docs.where(keep(F.col(text_col).cast("string"), F.col(lang_col).cast("string")))
