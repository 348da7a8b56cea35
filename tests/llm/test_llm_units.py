"""Kernels of the corpus operators against brute force (no Spark)."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netsleuth.llm import bpe, fingerprint, langid, lmscore, packing, quality, simhash, spans, sufarray, warc
from netsleuth.llm.rolling import Prefix, sliding_min

P = pytest.importorskip("public_tokenizers")


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, k = int(rng.integers(1, 70)), int(rng.integers(1, 5))
        t = np.append(rng.integers(1, k + 1, n), 0).astype(np.int64)
        text = t.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        for size in (k + 1, 5000):  # bucket by bucket, entry by entry
            assert sufarray.suffix_array(t, size).tolist() == want
        shared = sufarray.common_prefixes(t, np.array(want))
        for a, b in zip(want[1:], want):
            m = 0
            while max(a, b) + m < len(text) and text[a + m] == text[b + m]:
                m += 1
            assert shared[a] == m


def test_repeated_starts_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.randint(2, 5)
        regions = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 14))) for _ in range(rng.randint(1, 5))]
        starts = [rng.randint(1, len(r) - length + 1) for r in regions]
        weights = [rng.randint(1, 2) for _ in regions]
        count = {}
        for r, n, w in zip(regions, starts, weights):
            for i in range(n):
                count[r[i:i + length]] = count.get(r[i:i + length], 0) + w
        for r, n, got in zip(regions, starts, sufarray.repeated_starts(regions, starts, weights, length)):
            assert got.tolist() == [i for i in range(n) if count[r[i:i + length]] > 1]


def test_sliding_min_and_window_hashes():
    rng = np.random.default_rng(3)
    for n, w in ((10, 3), (7, 7), (50, 8), (3, 5)):
        x = rng.integers(0, 2 ** 60, n).astype(np.uint64)
        assert sliding_min(x, w).tolist() == [x[i:i + w].min() for i in range(n - w + 1)]
    data = np.frombuffer(b"abcabcabc", np.uint8)
    h = Prefix(data).windows(3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 3


def test_golay_code_is_perfect_and_keys_meet():
    tables = simhash.golay_tables()
    hits = np.bincount(simhash.golay_index(np.arange(1 << 23), tables))
    assert len(hits) == 4096 and set(hits.tolist()) == {2048}
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2 ** 64, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in rng.choice(64, int(rng.integers(0, 4)), replace=False):
            b[i] ^= np.uint64(1 << int(p))
    keys = [set(zip(*(x.tolist() for x in simhash.candidate_keys(v, tables)))) for v in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(len(a)))


def test_fingerprint_majority():
    import xxhash
    text = "The Quick brown\tfox\n jumps É over the quick brown fox"
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"one TWO") == xxhash.xxh64_intdigest(b"one two", 42)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abß \n\t|İΣ'sé1<>|endoftx#中 ", max_size=40))
def test_bpe_matches_the_library(text):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    if not hasattr(test_bpe_matches_the_library, "pair"):
        with open(path, encoding="utf-8") as f:
            test_bpe_matches_the_library.pair = Tokenizer.from_file(path), bpe.WordBPE(f.read())
    lib, own = test_bpe_matches_the_library.pair
    want = lib.encode(text, add_special_tokens=False).ids
    ids, words = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert words.decode() == lib.decode(want, skip_special_tokens=False)


def test_bpe_specials_new_letters_and_long_words():
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = bpe.WordBPE(f.read())
    rng = random.Random(4)
    texts = ["a<|endoftext|>b <|startoftext|>", "x\x1cy z", "aᲉB", "É", "ΑΣ ΑΣΑ"]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (47, 48, 49, 300)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t)[0], "<u4").tolist() == want, t
    parts = [own.inner[b] for b in b"mississippi" * 9]
    assert bpe.merge_short(list(parts), own.rank, own.made) == bpe.merge_long(list(parts), own.rank, own.made)


def test_byte_level_ids_match_the_library():
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = packing.ByteIds(f.read())
    rng = random.Random(5)
    letters = ["a", "the", " ", "  ", "\n", "\t", "É", "中", "1", "|", "'s", "<|endoftext|>", "\x1c", " ", "😀", "Hello"]
    for _ in range(600):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_packing_plan_is_whole_and_near_the_bound():
    rng = np.random.default_rng(6)
    for n in (1, 7, 300, 20000):
        sizes = rng.integers(1, 1025, n)
        counts = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
        plan = packing.pack_histogram(counts)
        got = {}
        for parts, times in plan:
            assert sum(parts) <= 1024 and times > 0
            for p in parts:
                got[p] = got.get(p, 0) + times
        assert got == counts
        bound = max(-(-int(sizes.sum()) // 1024), int((sizes > 512).sum()))
        assert sum(t for _, t in plan) <= bound * 1.03 + 1
    # best-fit decreasing needs 4 bins here, completion finds 3
    assert sum(t for _, t in packing.pack_histogram({6: 1, 5: 2, 4: 1, 3: 2, 2: 2}, 10)) == 3
    assert packing.pack_histogram({}) == []
    assert packing.piece_bounds(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]
    assert packing.piece_bounds(2048, 1024) == [(0, 1024), (1024, 1024)] and packing.piece_bounds(1024, 1024) == [(0, 1024)]


def test_quality_counts_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "a b ", "é", "#", "$x ", "\n", "\t", "cc "]) for _ in range(rng.randint(0, 30)))
        words, got = quality.base_counts(text.encode())
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        covered = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        assert got == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_distance_and_limits():
    p, q = np.array([1.0, 1, 0]), np.array([0.0, 0, 5])
    assert quality.distance(p, p) == 0 and quality.distance(p, q) == pytest.approx(1)
    assert quality.distance(p, np.zeros(3)) == 0
    assert quality.word_limit(50) > quality.word_limit(500) == quality.MAX_WORD_DISTANCE
    refs = {"en": (quality.class_counts(b"plain words of a text " * 50), {b"the": 0}, np.array([5.0, 5.0]))}
    assert not quality.verdict(None, "en", refs)[4] and not quality.verdict(b"", None, {})[4]
    assert not quality.verdict(b"#### $$$$ " * 60, "en", refs)[4]


def test_digest_properties():
    tables = fingerprint.hash_tables()
    a, b = b"some text of words " * 40, b"other material altogether, 12345 " * 30
    d = [fingerprint.digest(x, tables) for x in (a, a, b, b"", b"x", b"xy")]
    assert d[0] == d[1] != d[2] and len(d[0]) == 132 and set(d[3]) == {"0"}
    assert fingerprint.likeness(d[0], d[1]) == 1 and 0 <= fingerprint.likeness(d[0], d[2]) < 0.6
    half = fingerprint.digest(a[:len(a) // 2] + b[:len(a) // 2], tables)
    assert fingerprint.likeness(d[0], half) > fingerprint.likeness(d[0], d[2])
    data = bytes(np.random.default_rng(8).integers(0, 256, fingerprint.PIECE + 50, dtype=np.uint8))
    whole = fingerprint.bucket_counts(data, tables)
    assert whole.sum() == sum(len(data) - j for _, j in fingerprint.TRIPLETS)


def test_language_grams_stay_inside_words():
    ids, at = langid.grams(langid.normal_bytes(b"ab"))
    assert len(ids) == 3 and set(at.tolist()) == {0, 1}  # " ab", "ab ", " ab "
    assert len(langid.grams(langid.normal_bytes(b"12 !"))[0]) == 0
    long = b"word " * (langid.PIECE // 4)
    n = len(langid.grams(langid.normal_bytes(long))[0])
    assert sum(len(langid._own(langid.normal_bytes(long), s)[0]) for s in range(0, len(long) + 2, langid.PIECE)) == n


def test_sentences_cover_the_text():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "a, ", "end. ", "\n", "!? ", " ", "x" * 5 + " "]) for _ in range(rng.randint(0, 120)))
        parts = spans.sentences(text)
        assert "".join(text[a:b] for a, b in parts) == text and all(a < b for a, b in parts)
        assert all(len(text[a:b].split()) <= spans.LONG_SENTENCE for a, b in parts)


def test_word_hashes_match_a_loop():
    word, pair, before = lmscore._ngrams("The cat  The\tdog É the".encode())
    assert word[0] == word[2] == word[5] and word[1] != word[3] and before[1] == word[0] and before[0] == 0 and len(set(pair.tolist())) == 6
    assert len(lmscore.word_hashes(b" \n")) == 0 == len(lmscore.word_hashes(b""))
    ref = lmscore.word_hashes(b"ab cd " * 1000)
    old, lmscore.PIECE = lmscore.PIECE, 64
    try:
        assert (lmscore.word_hashes(b"ab cd " * 1000) == ref).all()
    finally:
        lmscore.PIECE = old


def test_cuts_never_show_a_record_boundary():
    rng = random.Random(10)
    for _ in range(300):
        block = b"".join(rng.choice([warc.BETWEEN, warc.VERSION, b"\r\n", b"x", b"ab" * 5]) for _ in range(rng.randint(0, 30)))
        cuts = list(warc._cuts(block, rng.choice([16, 40, 1000])))
        assert b"".join(block[a:b] for a, b in cuts) == block
        assert all(warc.BETWEEN not in block[a:b] and not block[a:b].startswith(warc.VERSION) for a, b in cuts)


def test_lower_case_without_context():
    assert "".join(map(bpe.lower_letter, "ΑΣ")) == "ας".replace("ς", "σ")
    assert unicodedata.normalize("NFC", "é") == "é"


def test_runs_of_short_sentences_cover_the_text():
    rng = random.Random(21)
    for _ in range(300):
        words = [rng.choice([1, 1, 2, 5, 9, 14]) for _ in range(rng.randint(0, 30))]
        n, got = len(words), spans._bounds(words, 3, 10)
        whole = {(i, z) for i in range(n) for z in range(i + 3, n + 1) if sum(words[i:z]) >= 10}
        assert set(got) == ({(i, z) for i, z in whole if (i, z - 1) not in whole or (i + 1, z) not in whole} or ({(0, n)} if n >= 3 else set()))
        assert n < 3 or {k for i, z in got for k in range(i, z)} == set(range(n))


def test_long_sentences_are_cut_by_their_words():
    rng, found = random.Random(23), 0
    for _ in range(100):
        word = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
        shared = word(60)
        hashes = []
        for _ in range(2):
            text = " ".join([*word(rng.randint(0, 70)), *shared, *word(rng.randint(0, 70))])
            hashes.append(set(spans.runs(text)[3]))
            assert all(len(text[a:b].split()) <= spans.LONG_SENTENCE for a, b in spans.sentences(text))
        found += bool(hashes[0] & hashes[1])
    assert found >= 97
    assert len(spans.sentences("same " * 1000)) == 40
    # long and short sentences, odd white space: nothing is lost, and each is cut as it is alone
    for _ in range(50):
        each = [" ".join(word(rng.choice([3, 40, 90]))) + rng.choice([".", "!", ""]) + rng.choice(["\n", "\n"]) for _ in range(rng.randint(1, 6))]
        each = [s.replace(" ", rng.choice([" ", " ", "  ", " \t"])) for s in each]
        got = spans.sentences("".join(each))
        assert [z for _, z in got][-1] == len("".join(each)) and all(x[1] == y[0] for x, y in zip(got, got[1:]))
        assert [z - a for a, z in got] == [z - a for s in each for a, z in spans.sentences(s)]


def _fewest_bins(items, capacity):
    """Exhaustive: every piece into every bin that has room, or a new one."""
    items, best = sorted(items, reverse=True), len(items)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for k, r in enumerate(room):
            if r >= items[i] and r not in room[:k]:
                place(i + 1, [*room[:k], r - items[i], *room[k + 1:]])
        place(i + 1, [*room, capacity - items[i]])
    place(0, [])
    return best


def test_packing_is_optimal_on_small_instances():
    rng, better = random.Random(3), 0
    for _ in range(300):
        c = rng.choice([20, 50, 100])
        items = [rng.randint(1, c) if rng.random() < 0.3 else rng.randint(c // 6, c // 2) for _ in range(rng.randint(1, 11))]
        counts = Counter(items)
        plan = packing.pack_histogram(counts, c)
        placed = Counter()
        for parts, times in plan:
            assert sum(parts) <= c
            for x in parts:
                placed[x] += times
        fewest = _fewest_bins(items, c)
        assert placed == counts and sum(t for _, t in plan) == fewest >= packing.lower_bound(counts, c)
        better += sum(t for _, t in packing.dive(counts, c, packing.best_fit)) > fewest
    assert better > 3                                       # the search does more than its first incumbent


def test_packing_of_small_pieces_beats_the_dives():
    counts = Counter(random.Random(5).choices(range(250, 400), k=4000))
    n = sum(t for _, t in packing.pack_histogram(counts))
    dives = [sum(t for _, t in packing.dive(counts, 1024, f)) for f in (packing.best_fit, lambda le, c, room, step: packing.fillings(le, c, room)[0])]
    assert packing.lower_bound(counts, 1024) <= n < min(dives)


def test_completions_leave_no_room():
    counts = Counter([9, 7, 7, 5, 4, 3, 3, 2])
    got = list(packing.completions(sorted(counts), dict(counts), 12))
    assert len(got) == len(set(got)) and (9, 3) in got and (7, 5) in got and (5, 4, 3) in got
    for f in got:
        left = counts - Counter(f)
        assert sum(f) <= 12 and not any(x <= 12 - sum(f) for x in left)
