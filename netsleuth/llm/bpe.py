"""Byte-pair encoding and decoding with public tokenizer files.

A word is held as a contiguous array of part boundaries with the merge rank of
each adjacent pair beside it.  The smallest rank is searched by a scan, its
boundary deleted and the two neighbouring ranks refreshed.  Long words, where
repeated scans would cost the square of the length, use the same merges from a
heap.  A word is encoded once per worker and kept in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.util import worker_cache

#: Words of more parts than this are merged from a heap.
SHORT_WORD = 48
#: Entries of the newer half of a worker's caches of words and of runs; a full
#: one becomes the older half.
CACHE_WORDS = 200_000
CACHE_CHUNKS = 250_000
#: ASCII and the letters of Latin-1 and Latin Extended-A: composed, and in all Unicode tables.
LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*").fullmatch
#: Characters that the tokenizers library counts as white space and Python's str.split does too ...
#: except the four separators U+001C to U+001F, which only Python splits at.
PYTHON_ONLY_SPACE = re.compile("[\x1c-\x1f]")
SPACE_RUN = re.compile("[\t-\r \x85\xa0  -     　]+")


def known(text: str) -> bool:
    """Whether Python's Unicode tables know every character."""
    return text.isascii() or all(unicodedata.category(c) != "Cn" for c in text)


def lower_letter(c: str) -> str:
    """Lower case of one character, without regard to its neighbours."""
    return c.lower()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 letters stand for themselves, the others follow from
    U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def merge_short(parts: list[int], rank: dict[int, int], made: list[int]) -> list[int]:
    """Ids of the parts left after all merges; ``parts`` is changed.

    ``parts`` holds the id of the part behind each boundary, ``ranks`` the rank
    of each inner boundary, that is of the pair it separates."""
    none, get = len(made), rank.get
    ranks = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == none:
            break
        i = ranks.index(least)
        parts[i] = here = made[least]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] << 20 | here, none)
        if i < len(ranks):
            ranks[i] = get(here << 20 | parts[i + 1], none)
    return parts


def merge_long(parts: list[int], rank: dict[int, int], made: list[int]) -> list[int]:
    """The same for a long word: pairs wait in a heap, parts are linked."""
    n = len(parts)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int]] = []

    def push(i):
        j = after[i]
        if j >= 0 and (r := rank.get(parts[i] << 20 | parts[j])) is not None:
            heapq.heappush(heap, (r, i, parts[i], parts[j]))
    for i in range(n):
        push(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else -1
        if j < 0 or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = made[r], -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [p for p in parts if p >= 0]


class WordBPE:
    """Lower-casing word-level BPE with an end-of-word suffix, read from a
    tokenizers JSON file (normaliser NFC, white space, lower case; pattern
    split; byte letters; no decoder)."""

    def __init__(self, text: str):
        import regex
        d = json.loads(text)
        model = d["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        pairs = list(pairs)
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.suffix] for x in letters]
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.text, self.library = text, None
        self.byte_of = {c: i for i, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.added = added
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")").split if added else lambda x: [x]
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in added.items()}
        self.name_bytes = {i: t.encode() for i, t in self.names.items()}
        self.first = {t[0] for t in added}
        self.chunks: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.older_chunks, self.older_words = {}, {}

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word between splits."""
        data = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[x] for x in data[:-1]]
        parts.append(self.final[data[-1]])
        return (merge_short if len(parts) <= SHORT_WORD else merge_long)(parts, self.rank, self.made)

    def as_bytes(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), b" ".join(map(self.name_bytes.__getitem__, ids))

    def split(self, piece: str) -> list[str]:
        """Normalised words of a run without white space.  Characters too new
        for Python's Unicode tables are left to the library's own normaliser
        and splitter, which may know them."""
        if LATIN(piece):
            return self.find(piece.lower())
        if known(piece):
            norm = unicodedata.normalize("NFC", piece)
            return self.find(norm.lower() if norm.isascii() else "".join(map(lower_letter, norm)))
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_str(self.text)
        norm = self.library.normalizer.normalize_str(piece)
        return [bytes(map(self.byte_of.__getitem__, w)).decode()
                for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def word(self, w: str) -> tuple[bytes, bytes]:
        got = self.words.get(w)
        if got is None:
            got = self.older_words.get(w) or self.as_bytes(self.word_ids(w))
            if len(w) <= 64:
                if len(self.words) >= CACHE_WORDS:
                    self.older_words, self.words = self.words, {}
                self.words[w] = got
        return got

    def chunk_parts(self, chunk: str) -> list[tuple[bytes, bytes]]:
        if self.first.isdisjoint(chunk):                 # no added token can begin here
            return [self.word(w) for w in self.split(chunk)]
        out = []
        for piece in self.cut(chunk):
            if piece in self.added:
                out.append(self.as_bytes([self.added[piece]]))
            elif piece:
                out += [self.word(w) for w in self.split(piece)]
        return out

    def chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """(ids as little-endian unsigned 32-bit, decoded UTF-8) of a run
        without white space; short runs and words are cached."""
        got = self.chunks.get(chunk)
        if got is None:
            got = self.older_chunks.get(chunk)
            if got is None:
                parts = self.chunk_parts(chunk)
                got = parts[0] if len(parts) == 1 else (b"".join([i for i, _ in parts]), b" ".join([w for _, w in parts]))
            if len(chunk) <= 64:
                if len(self.chunks) >= CACHE_CHUNKS:
                    self.older_chunks, self.chunks = self.chunks, {}
                self.chunks[chunk] = got
        return got

    def decode(self, ids) -> str:
        """Tokens joined by blanks, special ones included."""
        return " ".join(map(self.names.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids, decoded text) of a whole text."""
        if PYTHON_ONLY_SPACE.search(text):
            runs = [r for r in SPACE_RUN.split(text) if r]
        else:
            runs = text.split()
        if not runs:
            return b"", b""
        ids, words = zip(*map(self.chunk, runs))
        return b"".join(ids), b" ".join(w for w in words if w)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary, decoded string)`` of every whole text.

    ``ids``: little-endian unsigned 32-bit ids without special tokens added;
    ``decoded``: the decoded text.  Null and empty texts have no ids and decode
    to the empty string.  Rows are independent: repeated or null ids are kept
    as they are, other columns are ignored, an empty table gives an empty one."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB

    def run(batches):
        cache = worker_cache()
        bpe = cache.get(("bpe", tokenizer_path))
        if bpe is None:
            bpe = cache[("bpe", tokenizer_path)] = WordBPE(model.value)
        for b in batches:
            doc_ids, texts = b.column("doc_id"), b.column("text")
            at = 0
            while at < len(texts):
                start, size, ids, words = at, 0, [], []
                while at < len(texts) and size < 1 << 22:
                    i, w = bpe.encode(texts[at].as_py() or "")
                    ids.append(i)
                    words.append(w)
                    size += len(i) + len(w)
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(start, at - start), pa.array(ids, pa.binary()), pa.array(words, pa.binary()).cast(pa.string())],
                    ["doc_id", "ids", "decoded"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, ids binary, decoded string"))
