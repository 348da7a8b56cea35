"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is the bitwise majority of the XXH64 values of a text's
word shingles.  Fingerprints link at a few differing bits.  Candidate search:

* the 64 bits form five blocks; three differing bits leave at least two blocks
  untouched, so each of the ten pairs of blocks is tried as the exact part;
* the other three blocks hold all differing bits; cut into two segments, one
  of them has at most one.  A segment is read as a (padded) word of the perfect
  binary Golay code [23, 12]: every word lies within three bits of exactly one
  codeword, and two words one bit apart share a codeword among those within
  four bits of them.

A key is (pair of blocks, segment, exact bits, codeword index).  One bit apart
means opposite parity, so a segment of odd parity gives the index of its own
codeword only, one of even parity also those of its one-bit neighbours: one to
six indices.  Fingerprints of one key are compared in the task that holds the
key; only a spanning forest of the verified links leaves it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsleuth.llm.components import components
from netsleuth.llm.rolling import mix
from netsleuth.llm.util import as_bytes, settle, table_partitions, with_row_id, worker_cache

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BLOCK_BITS = (13, 13, 13, 13, 12)
#: Fixed value: generator polynomial of the binary Golay code [23, 12].
GOLAY_POLY = 0xC75
BLOCK_ROWS = 1 << 16


def fingerprint(data: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text (UTF-8): A-Z lower-cased, words between ASCII
    white space, shingles of ``words`` words (a shorter text is one shingle),
    a bit set if set in over half of the XXH64 values; no word: 0."""
    import xxhash
    toks = (data or b"").lower().split()
    if not toks:
        return 0
    h, n = xxhash.xxh64_intdigest, max(1, len(toks) - words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK_ROWS):
        part = toks[at:at + BLOCK_ROWS + words - 1]
        runs = zip(*(part[i:] for i in range(words))) if len(part) >= words else [part]
        vals = np.array([h(b" ".join(r), HASH_SEED) for r in runs], np.uint64)
        bits = np.unpackbits(vals.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_rid, doc_id, fp long)`` for every row; ``fp`` holds the 64 bits."""

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(x, words) for x in as_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_rid"), b.column("doc_id"), pa.array(got, pa.int64())],
                                             ["_rid", "doc_id", "fp"])

    return with_row_id(docs, id_col, text_col).mapInArrow(run, "_rid long, doc_id long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainders of the low 12 bits, of the high 11 bits, error pattern by
    remainder) of 23-bit words modulo the generator polynomial."""
    def rem(x):
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY_POLY << (i - 11)
        return x
    one = [rem(1 << i) for i in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low ^= np.where(np.arange(1 << 12) >> i & 1, one[i], 0)
    for i in range(11):
        high ^= np.where(np.arange(1 << 11) >> i & 1, one[12 + i], 0)
    err = np.zeros(1 << 11, np.int64)
    for k in range(1, 4):
        for places in itertools.combinations(range(23), k):
            s, e = 0, 0
            for p in places:
                s, e = s ^ one[p], e | 1 << p
            err[s] = e
    return low, high, err


def golay_index(words: np.ndarray, tables) -> np.ndarray:
    """Index (12 bits) of the codeword within three bits of each 23-bit word."""
    low, high, err = tables
    return (words ^ err[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def segment_keys(seg: np.ndarray, bits: int, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index): one index for odd parity, one to six for even."""
    rows, own = np.arange(len(seg)), golay_index(seg, tables)
    odd = np.zeros(len(seg), np.int64)
    for i in range(bits):
        odd ^= seg >> i & 1
    even = np.flatnonzero(odd == 0)
    near = np.sort(np.stack([own[even]] + [golay_index(seg[even] ^ (1 << i), tables) for i in range(bits)]), axis=0)
    new = np.ones(near.shape, bool)
    new[1:] = near[1:] != near[:-1]
    k, col = np.nonzero(new)
    odd_rows = rows[odd == 1]
    return np.concatenate([odd_rows, even[col]]), np.concatenate([own[odd_rows], near[k, col]])


def candidate_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all tables for unsigned 64-bit fingerprints."""
    starts = np.concatenate([[0], np.cumsum(BLOCK_BITS)])
    block = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(starts, BLOCK_BITS)]
    out_rows, out_keys, table = [], [], 0
    for exact in itertools.combinations(range(len(BLOCK_BITS)), 2):
        head = block[exact[0]] << BLOCK_BITS[exact[1]] | block[exact[1]]
        rest, width = np.zeros(len(fps), np.int64), 0
        for i in range(len(BLOCK_BITS)):
            if i not in exact:
                rest, width = rest | block[i] << width, width + BLOCK_BITS[i]
        half = width // 2
        for seg, bits in ((rest & ((1 << half) - 1), half), (rest >> half, width - half)):
            rows, idx = segment_keys(seg, bits, tables)
            out_rows.append(rows)
            out_keys.append((np.int64(table) << 40) | head[rows] << 12 | idx)
            table += 1
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    """Set bits of 64-bit values (numpy would count those of the absolute value)."""
    return np.bitwise_count(x.view(np.uint64))


def group_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest, as (member, smallest member), of the links among the
    distinct fingerprints of one key.  One row of differences at a time: the
    memory is that of the group, whatever its size."""
    n = len(fps)
    label = np.arange(n)
    for i in range(n - 1):
        hit = np.flatnonzero(_popcount(fps[i + 1:] ^ fps[i]) <= max_bits) + i + 1
        if len(hit):
            olds = np.unique(np.append(label[hit], label[i]))
            if len(olds) > 1:
                label[np.isin(label, olds)] = olds[0]
    return [(int(fps[i]), int(fps[label[i]])) for i in range(n) if label[i] != i]


def _small_groups(keys: np.ndarray, fps: np.ndarray, max_bits: int, reach: int):
    """Verified pairs of rows that share a key, up to ``reach`` places apart."""
    for d in range(1, reach):
        same = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(same):
            break
        ok = same[_popcount(fps[same] ^ fps[same + d]) <= max_bits]
        if len(ok):
            yield fps[ok], fps[ok + d]


SMALL_GROUP = 16
#: Fingerprints of one key that a task compares with each other; larger groups
#: get further keys, and what those leave is dealt over many tasks.
GROUP_LIMIT = 20_000
#: Blocks of a fingerprint, of which three differing bits leave half untouched.
FINE_BLOCKS = 6
_LINKS = ["u", "v", "key", "fp"]


def _links_batch(found=(), keys=(), fps=()):
    """Links (u, v), and rows (key, fp) of groups that are too large."""
    us, vs = zip(*found) if found else ((), ())
    n, m = len(us), len(keys)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (us, vs)]
                                      + [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())]) for x in (keys, fps)], _LINKS)


def _forest(pairs) -> list[tuple[int, int]]:
    """Links reduced to (member, smallest member)."""
    up: dict[int, int] = {}

    def root(x):
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r
    for us, vs in pairs:
        for u, v in zip(us.tolist(), vs.tolist()):
            up.setdefault(u, u)
            up.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    return [(x, r) for x in up if (r := root(x)) != x]


def _compare(keyed: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """Links within the groups of ``keyed(key, fp)``, and the rows of groups of
    more than ``limit``, as they are.  A task holds ``limit`` rows of a key."""
    def links(keys, fps):
        edge = np.flatnonzero(np.diff(keys)) + 1
        first = np.concatenate([[0], edge])
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        row = np.repeat(sizes, sizes)
        small, late = row <= SMALL_GROUP, row > limit
        pairs = list(_small_groups(keys[small], fps[small], max_bits, SMALL_GROUP)) if (sizes > 1).any() else []
        middle = (sizes > SMALL_GROUP) & (sizes <= limit)
        for s, n in zip(first[middle], sizes[middle]):
            got = group_links(fps[s:s + n], max_bits)
            if got:
                pairs.append(tuple(np.array(x, np.int64) for x in zip(*got)))
        return _links_batch(_forest(pairs), keys[late], fps[late])

    def compare(batches):
        held_k, held_f, passing = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            keys, fps = b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)
            if passing is not None:                    # more of a group that is too large
                n = int(np.searchsorted(keys, passing, side="right"))
                yield _links_batch((), keys[:n], fps[:n])
                keys, fps = keys[n:], fps[n:]
                if len(keys):
                    passing = None
            keys, fps = np.concatenate([held_k, keys]), np.concatenate([held_f, fps])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            held_k, held_f = keys[cut:], fps[cut:]
            if len(held_k) > limit:
                yield _links_batch((), held_k, held_f)
                passing, held_k, held_f = held_k[0], held_k[:0], held_f[:0]
            if cut:
                yield links(keys[:cut], fps[:cut])
        if len(held_k):
            yield links(held_k, held_f)
    return (keyed.repartition(table_partitions(keyed), "key").sortWithinPartitions("key", "fp")
            .mapInArrow(compare, "u long, v long, key long, fp long"))


def _finer(rows: DataFrame) -> DataFrame:
    """Rows (key, fp) under one key for each choice of half the blocks: two
    fingerprints of at most three differing bits agree in one choice."""
    def run(batches):
        starts = [64 * i // FINE_BLOCKS for i in range(FINE_BLOCKS + 1)]
        masks = [sum(((1 << z) - (1 << a)) for a, z in some) for some in itertools.combinations(zip(starts, starts[1:]), FINE_BLOCKS // 2)]
        for b in batches:
            keys, fps = b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)
            for i, m in enumerate(masks):
                key = mix(mix(keys.view(np.uint64) + np.uint64(i)) ^ (fps.view(np.uint64) & np.uint64(m)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps)], ["key", "fp"])
    return rows.select("key", "fp").mapInArrow(run, "key long, fp long")


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (key, fp) in blocks of about half of ``limit``, each block with each
    other block of its key under a key of their own."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / limit).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    each = rows.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")


def fingerprint_links(classes: DataFrame, max_bits: int = MAX_BITS, limit: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` that connect all of ``classes(fp)`` linked by at most
    ``max_bits`` (three) differing bits.  ``fp`` must be distinct.

    Groups of one key beyond ``limit`` are taken apart by further exact blocks,
    then by blocks of rows, so that no task compares more and no link is lost."""
    if max_bits > 3:
        raise ValueError("the key tables cover up to three differing bits")
    limit = limit or GROUP_LIMIT

    def make(batches):
        cache = worker_cache()
        tables = cache.get("golay") or cache.setdefault("golay", golay_tables())
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 8192):
                part = fps[at:at + 8192]
                rows, keys = candidate_keys(part.view(np.uint64), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    found = settle(_compare(classes.select("fp").mapInArrow(make, "key long, fp long"), max_bits, limit), "simhash-compared")
    edges = found.where("u is not null").select("u", "v")
    large = found.where("key is not null").select("key", "fp")
    if large.limit(1).count():
        fine = settle(_compare(_finer(large), max_bits, limit), "simhash-finer")
        edges = edges.unionByName(fine.where("u is not null").select("u", "v"))
        rest = fine.where("key is not null").select("key", "fp")
        if rest.limit(1).count():
            # blocks are dealt by hash: a pair of them may exceed its size a little, and is compared all the same
            edges = edges.unionByName(_compare(_dealt(rest, limit), max_bits, 1 << 62).where("u is not null").select("u", "v"))
    return edges


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_rid, doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint``: 16 lower-case hex digits.  ``component_id``: the smallest
    doc_id reachable over links of at most ``max_bits`` differing bits (null if
    only rows without doc_id are reachable).  Null or wordless texts have
    fingerprint zero and link like any other; equal texts always share a
    component; repeated doc_ids are separate rows; other columns are ignored;
    an empty table gives an empty one."""
    return _rooted(docs, words, max_bits, id_col, text_col).drop("root")


def _rooted(docs: DataFrame, words: int, max_bits: int, id_col: str, text_col: str) -> DataFrame:
    """``simhash_components`` with ``root``, the smallest fingerprint of the component."""
    own = settle(fingerprints(docs, words, id_col, text_col), "simhash-fp")
    classes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    linked = components(fingerprint_links(classes, max_bits), "simhash-links")
    member = classes.join(linked.select(F.col("node").alias("fp"), "root"), "fp")
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = member.join(least, "root").select("fp", "component_id", "root")
    of_class = settle(classes.join(moved, "fp", "left")
                      .select("fp", F.when(F.col("root").isNotNull(), F.col("component_id"))
                              .otherwise(F.col("first_id")).alias("component_id"),
                              F.coalesce("root", "fp").alias("root")), "simhash-components")
    return own.join(of_class, "fp").select("_rid", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id", "root")


def keep_first_of_groups(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its near-duplicates: of each component one row stays,
    that with the smallest doc_id (of repeated ids the first row; a component
    without ids keeps its first row).  All columns are kept."""
    found = _rooted(docs, words, max_bits, id_col, text_col)
    # one row per component: the smallest (doc_id, row), ids before nulls; components
    # that share a repeated doc_id are one
    best = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("root"))).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rid")).alias("b"))
    keep = best.select(F.col("b._rid").alias("_rid"))
    row = "_rid" if "_rid" not in docs.columns else "_rid_" + "_".join(docs.columns)
    return (docs.withColumn(row, F.monotonically_increasing_id())
            .join(keep.withColumnRenamed("_rid", row), row, "left_semi").select(*docs.columns))
