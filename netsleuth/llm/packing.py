"""Best-fit packing of tokenised documents by bin completion.

The plan depends on the lengths only, so it is made on their histogram (at
most ``capacity`` counts, whatever the number of documents): the largest
length left is completed by undominated fillings, the search prunes by the
waste that a better solution may still have, and best-fit solutions are the
incumbents.  A filling is used as often as the counts allow, so the steps do
not grow with the data.  Pieces then find their place by their rank among the
pieces of the same length.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsleuth.llm.util import settle, worker_cache

CAPACITY = 1024
END_ID = 2
#: Best fillings that a dive chooses from; dives behind the first; steps of the
#: search over all completions, and pieces tried for each step.
FILLINGS = 4
DIVES = 24
NODES, TRIED = 20_000, 20
#: Runs in the newer half of a cache; when it is full it becomes the older half.
CACHE_RUNS = 150_000
#: ASCII and the letters of Latin-1 and Latin Extended-A, on which all Unicode tables agree.
LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*").fullmatch
#: White space of byte-level splitting other than the blank, and runs of white
#: space that are not just one blank.
SPACE = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GAPS = re.compile(f"([ {SPACE}]*[{SPACE}][ {SPACE}]*| {{2,}})").split
RARE = re.compile(f"[{SPACE}]".replace("\t-\r", "\t\x0b-\r")).search


class ByteIds:
    """Ids of a byte-level tokenizers file; runs between blanks are encoded
    once and cached as little-endian unsigned 32-bit bytes."""

    def __init__(self, text: str):
        import tiktoken
        from tokenizers import Tokenizer

        from netsleuth.llm.bpe import byte_letters
        d = json.loads(text)
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in d["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in d["model"]["vocab"].items() if t not in self.added}
        pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_str(text)

        class Cache(dict):
            def __init__(cache, lead):
                cache.lead, cache.older = lead, {}

            def __missing__(cache, run):
                got = cache.older.get(run) or self.run(cache.lead + run)
                if len(run) <= 64:
                    if len(cache) >= CACHE_RUNS:
                        cache.older = dict(cache)
                        cache.clear()
                    cache[run] = got
                return got
        #: ids of a run, and of a run behind one blank
        self.plain, self.spaced = Cache("").__getitem__, Cache(" ").__getitem__

    def rest(self) -> None:
        """Drops the older halves: an idle worker keeps the newer ones only."""
        for get in (self.plain, self.spaced):
            get.__self__.older = {}

    def run(self, run: str) -> bytes:
        if LATIN(run):
            ids = self.fast.encode_ordinary(run)
        else:  # other letters: the library's own Unicode tables decide
            ids = self.exact.encode(run, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        if any(a in text for a in self.added):
            for p in self.cut(text):
                if p in self.added:
                    out.append(self.added[p])
                else:
                    self._runs(p, out)
        else:
            self._runs(text, out)
        return b"".join(out)

    def _runs(self, text: str, out: list[bytes]) -> None:
        """Ids of the runs of a text: words with the one blank before them;
        of longer white space all but its last character, which is a run of its
        own unless it is the blank of the next word."""
        if not (" " in (text[:1], text[-1:]) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or RARE(text)):
            for i, line in enumerate(text.split("\n")):             # single blanks and line ends only
                if i:
                    out.append(self.plain("\n"))
                if line:
                    first, *words = line.split(" ")
                    out.append(self.plain(first))
                    out.extend(map(self.spaced, words))
            return
        parts, lead = GAPS(text), False
        for i in range(0, len(parts), 2):
            words = parts[i].split(" ")
            end = words.pop() == "" if len(words) > 1 and not words[-1] else False      # a blank at the text's end
            if words[0]:
                out.append((self.spaced if lead else self.plain)(words[0]))
            out.extend(map(self.spaced, words[1:]))
            if end:
                out.append(self.plain(" "))
            if i + 1 < len(parts):
                gap = parts[i + 1]
                if i + 3 == len(parts) and not parts[i + 2]:
                    out.append(self.plain(gap))
                    break
                lead = gap[-1] == " "
                if len(gap) > 1:
                    out.append(self.plain(gap[:-1]))
                if not lead:
                    out.append(self.plain(gap[-1]))


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, nth[, ids])``: the
    token pieces, numbered within their length and scan task."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids

    def run(batches):
        from pyspark import TaskContext
        cache = worker_cache()
        enc = cache.get(("byte_ids", tokenizer_path))
        if enc is None:
            enc = cache[("byte_ids", tokenizer_path)] = ByteIds(model.value)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        rows: list[tuple] = []

        def out():
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            rows.clear()
            return batch
        for b in batches:
            ids_col, texts, size = b.column("doc_id").to_pylist(), b.column("text"), 0
            for doc, text in zip(ids_col, texts):
                ids = enc.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), task, seen[length]) + ((part,) if with_ids else ()))
                    seen[length] += 1
                size += len(ids)
                if size > 1 << 23:
                    yield out()
                    size = 0
            if rows:
                yield out()
        enc.rest()

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
                        + (", ids binary" if with_ids else "")))


def fillings(lengths: list[int], counts: dict[int, int], room: int, limit: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the ascending ``lengths``, least
    waste first, then the fewest pieces.

    One piece that fits exactly dominates all others.  A filling is dominated
    if one of its pieces could be exchanged for a longer one left over or a
    further piece added; searching pieces in descending order and completing
    each start by the longest fitting rest gives only undominated ones."""
    found: dict[tuple[int, ...], int] = {}
    best_waste = room + 1

    def longest(most: int, used: dict[int, int]) -> int:
        i = bisect.bisect_right(lengths, most) - 1
        while i >= 0 and counts[lengths[i]] <= used.get(lengths[i], 0):
            i -= 1
        return lengths[i] if i >= 0 else 0

    def note(parts, waste):
        nonlocal best_waste
        found[tuple(parts)] = waste
        best_waste = min(best_waste, waste)

    one = longest(room, {})
    if not one:
        return [()]
    if one == room:
        return [(one,)]
    budget = 400

    def search(parts, used, left, most, depth):
        nonlocal budget
        x = longest(min(most, left), used)
        if not x:
            note(parts, left)
            return
        while x and budget > 0 and (best_waste > 0 or len(found) < limit):
            budget -= 1
            used[x] = used.get(x, 0) + 1
            rest = left - x
            y = longest(min(x, rest), used)
            if not y:
                note([*parts, x], rest)
            elif y == rest:
                note([*parts, x, y], 0)
            elif depth > 1:
                search([*parts, x], used, rest, x, depth - 1)
            else:  # complete by longest fits
                tail, u = [], dict(used)
                while y:
                    tail.append(y)
                    u[y] = u.get(y, 0) + 1
                    rest -= y
                    y = longest(min(y, rest), u)
                note([*parts, x, *tail], rest)
            used[x] -= 1
            x = longest(x - 1, used)

    search([], {}, room, room, 2)
    order = sorted(found, key=lambda f: (found[f], len(f), [-x for x in f]))
    least = found[order[0]]
    return [f for f in order if found[f] <= least + (least > 0) * 8][:limit]


def _bulk(counts: dict[int, int], parts: tuple[int, ...]) -> int:
    """How often a filling can be used at once."""
    need: dict[int, int] = {}
    for p in parts:
        need[p] = need.get(p, 0) + 1
    return min(counts[p] // n for p, n in need.items())


def dive(counts: dict[int, int], capacity: int, choose, most: int | None = None) -> list[tuple[tuple[int, ...], int]] | None:
    """One solution: completes the largest length left until none is left; None
    once more than ``most`` is wasted."""
    counts = {k: v for k, v in counts.items() if v}
    lengths, plan, step, lost = sorted(counts), [], 0, 0
    while lengths:
        big = lengths[-1]
        counts[big] -= 1
        rest = choose(lengths, counts, capacity - big, step)
        counts[big] += 1
        parts = (big, *rest)
        times = _bulk(counts, parts)
        plan.append((parts, times))
        lost += times * (capacity - sum(parts))
        if most is not None and lost > most:
            return None
        for p in parts:
            counts[p] -= times
        for p in {*parts}:
            if not counts[p]:
                lengths.pop(bisect.bisect_left(lengths, p))
        step += 1
    return plan


def best_fit(lengths, counts, room, step):
    """The longest piece that fits, again and again (best-fit decreasing)."""
    out, used = [], {}
    i = bisect.bisect_right(lengths, room) - 1
    while i >= 0:
        x = lengths[i]
        n = min(counts[x] - used.get(x, 0), room // x)
        out += [x] * n
        room -= x * n
        i = min(i - 1, bisect.bisect_right(lengths, room) - 1)
    return tuple(out)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume; with pieces over a threshold as
    whole bins and those under its complement left out; and with each piece
    counted as the multiple of 1/k that is sure to be taken of a bin."""
    volume = sum(x * n for x, n in counts.items())
    best = -(-volume // capacity)
    for t in sorted({x for x in counts if 2 * x <= capacity} | {0}):
        whole = sum(n for x, n in counts.items() if x > capacity - t)
        rest = sum(x * n for x, n in counts.items() if t <= x <= capacity - t)
        half = sum(n for x, n in counts.items() if capacity - t >= x > capacity / 2)
        best = max(best, whole + max(-(-rest // capacity), half))
    for k in range(1, 21):
        parts = sum(n * (k * x if (k + 1) * x % capacity == 0 else (k + 1) * x // capacity * capacity) for x, n in counts.items())
        best = max(best, -(-parts // (k * capacity)))
    return best


def completions(lengths: list[int], counts: dict[int, int], room: int, most: int | None = None, steps: list[int] | None = None):
    """Every way to fill ``room`` to which no piece left over could be added,
    larger pieces first; pieces are at most ``most`` long.  While it waits, the
    pieces of the filling are taken out of ``counts``.  Each piece tried takes
    one of ``steps[0]``; it ends when none is left."""
    i = bisect.bisect_right(lengths, room if most is None else min(room, most)) - 1
    path, fresh = [], True
    while steps is None or steps[0] > 0:
        while i >= 0 and not counts[lengths[i]]:
            i -= 1
        if i >= 0:
            counts[lengths[i]] -= 1
            room -= lengths[i]
            path.append(i)
            i, fresh = min(i, bisect.bisect_right(lengths, room) - 1), True
            if steps is not None:
                steps[0] -= 1
            continue
        if fresh and not any(counts[x] for x in lengths[:bisect.bisect_right(lengths, room)]):
            yield tuple(lengths[k] for k in path)
        if not path:
            return
        i, fresh = path.pop(), False
        counts[lengths[i]] += 1
        room += lengths[i]
        i -= 1


def _exact(counts: dict[int, int], capacity: int, best: list, bound: int, nodes: int) -> list:
    """Bin completion over all completions of the largest piece left, each used
    as often as the counts allow, then less often; a branch ends when it wastes
    more than one bin less allows.  Ends after ``nodes`` bins or ``TRIED`` pieces
    for each."""
    total, fewest = sum(x * n for x, n in counts.items()), sum(t for _, t in best)
    counts, lengths, steps = dict(counts), sorted(counts), [nodes * TRIED]
    path, used, lost = [], 0, 0

    def choices():
        left = [x for x in lengths if counts[x]]
        big = left[-1]
        counts[big] -= 1
        for rest in completions(left, counts, capacity - big, steps=steps):
            parts = (big, *rest)
            need = {p: parts.count(p) for p in parts}
            for times in range(1 + min(counts[p] // n for p, n in need.items()), 0, -1):
                for p, n in need.items():
                    counts[p] -= n * (times - 1)
                yield parts, times                        # while it waits, the pieces are taken out of counts
                for p, n in need.items():
                    counts[p] += n * (times - 1)
        counts[big] += 1
    stack = [choices()]
    while stack and fewest > bound and nodes > 0 and steps[0] > 0:
        step = next(stack[-1], None)
        nodes -= 1
        if step is None:
            stack.pop()
            if path:
                parts, times = path.pop()
                used, lost = used - times, lost - times * (capacity - sum(parts))
            continue
        parts, times = step
        waste = times * (capacity - sum(parts))
        if lost + waste > (fewest - 1) * capacity - total or used + times >= fewest:
            continue
        if not any(counts.values()):
            best, fewest = [*path, step], used + times
            continue
        path.append(step)
        used, lost = used + times, lost + waste
        stack.append(choices())
    return best


def _groups(counts: dict[int, int], capacity: int, k: int):
    """A solution that first packs the pieces of at most 1/k of a bin k by k."""
    plan, rest, open_ = [], dict(counts), ()
    for x in sorted((x for x in counts if x * k <= capacity), reverse=True):
        n = counts[x]
        if open_:
            take = min(n, k - len(open_))
            open_, n = open_ + (x,) * take, n - take
            if len(open_) == k:
                plan.append((open_, 1))
                open_ = ()
        if n >= k:
            plan.append(((x,) * k, n // k))
        if n % k and not open_:
            open_ = (x,) * (n % k)
    for parts, times in plan:
        for x in parts:
            rest[x] -= times
    return plan + dive(rest, capacity, lambda le, c, room, step: fillings(le, c, room)[0])


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, dives: int = DIVES):
    """``[(lengths, times)]``: as few bins as the search finds.

    The steps are the same at every size.  Incumbents are best-fit decreasing,
    the first completion dive, and dives behind groups of small pieces (k of at
    most 1/k of a bin).  Then completions are searched in order of discrepancy:
    ``dives`` dives that take another than the first completion at one place,
    evenly spread over the path, then at two.  Last, branch and bound runs over
    all completions for ``nodes`` steps.  A dive or branch ends once its waste
    exceeds what one bin less would allow, all of it at the lower bound."""
    counts = {int(k): int(v) for k, v in counts.items() if v and k > 0}
    if not counts:
        return []
    total = sum(k * v for k, v in counts.items())
    bound = lower_bound(counts, capacity)
    bins = lambda plan: sum(t for _, t in plan)
    first = lambda le, c, room, step: fillings(le, c, room)[0]
    best = min((dive(counts, capacity, f) for f in (best_fit, first)), key=bins)
    path = len(best)
    for k in range(2, min(9, capacity // min(counts) + 1)):
        if bins(best) > bound:
            best = min(best, _groups(counts, capacity, k), key=bins)
    if bins(best) > bound:
        places = sorted({int(path * (2 * i + 1) / (2 * max(1, dives // 3))) for i in range(max(1, dives // 3))})
        tries = [{p: i} for i in (1, 2) for p in places] + [{p: 1, q: 1} for p, q in zip(places, places[1:])]
        for other in tries[:dives]:
            if bins(best) <= bound:
                break

            def choose(le, c, room, step, other=other):
                some = fillings(le, c, room)
                return some[min(other.get(step, 0), len(some) - 1)]
            found = dive(counts, capacity, choose, (bins(best) - 1) * capacity - total)
            best = min(best, found, key=bins) if found else best
    return _exact(counts, capacity, best, bound, nodes)


def slots(plan) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, ranks, first sequence, offset)], ascending."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = 0
    for parts, times in plan:
        for p, offset in zip(parts, accumulate(parts, initial=0)):
            out.setdefault(p, []).append((taken.get(p, 0), times, base, offset))
            taken[p] = taken.get(p, 0) + times
        base += times
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``.

    Each document is its ids and then ``end_id``; only documents of more than
    ``capacity`` ids are cut.  Null and empty texts are one piece of length 1;
    null and repeated doc_ids are kept as rows of their own; other columns are
    ignored; an empty table gives an empty one."""
    pieces = settle(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col), "pack-pieces")
    # tasks x lengths rows; the window of one length holds one row per scan task
    per_task = settle(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = {r[0]: r[1] for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    place = {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots(pack_histogram(counts, capacity)).items()}
    before = (Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    firsts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(firsts, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("base")).drop("task", "nth", "base")
    table = docs.sparkSession.sparkContext.broadcast(place)  # a few ranges for each of at most `capacity` lengths

    def assign(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                first, _, base, offset = table.value[int(size)]
                rows = np.flatnonzero(length == size)
                k = np.searchsorted(first, rank[rows], side="right") - 1
                seq[rows], off[rows] = base[k] + rank[rows] - first[k], offset[k]
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(seq), pa.array(off)],
                                             keep + ["sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return ranked.select(*names, "rank").mapInArrow(assign, schema + ", sequence_id long, offset long")
