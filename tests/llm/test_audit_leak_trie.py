"""Source divergence, decontamination and conversation trie against brute
force: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from netsleuth.llm import convtrie, decontam, divergence, langid
from netsleuth.llm.util import join_counted, joined_sha256, settle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# --- source divergence ------------------------------------------------------

def audit_brute(rows, min_docs, top):
    find = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+").findall
    plain = [(lang or "", src or "", [t.translate(LOWER) for t in find(text or "")]) for lang, src, text in rows]
    out = []
    for lang in {p[0] for p in plain}:
        mine = [p for p in plain if p[0] == lang]
        docs = Counter(t for p in mine for t in set(p[2]))
        kept = sorted(t for t in docs if docs[t] >= min_docs)
        count = {s: Counter() for _, s, _ in mine}
        for _, s, terms in mine:
            count[s].update(t for t in terms if docs[t] >= min_docs)
        count[None] = sum((count[s] for s in list(count)), Counter())

        def share(s, t):
            return 1 + divergence.SCALE * (count[s][t] + 2) // (sum(count[s].values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in (x for x in count if x is not None):
            pairs = [(o, sum(f(share(s, t), share(o, t)) for t in kept)) for o in count if o not in (None, s)]
            terms = [(t, f(share(s, t), share(None, t))) for t in kept if count[s][t] and share(s, t) > share(None, t)]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:n]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


AUDIT = "lang string, source string, text string, block string, term int, n long, _rid int"


def audit_table(spark, rows):
    return spark.createDataFrame([(*r, "b", 1, 2, 3) for r in rows], AUDIT)


@pytest.mark.parametrize("block_bytes", [1 << 25, 400])
def test_divergence_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Été", "don't", "x-y-x", "ÉTÉ", "a1b", "42", "--", "naïve,", "WA"]
    rows = []
    for i in range(300):
        own = rng.choice(["s1", "s2", "s,3:%", "s1", "", None])
        text = " ".join(rng.choice(words[:10] if own == "s1" else words) + rng.choice(["", "", ".", ",", " z"]) for _ in range(rng.randint(0, 12)))
        rows.append((rng.choice(["en", "en", "fr", None, ""]), own, rng.choice([text, text, text, text, None, "", " \n\t"])))
    rows += [("en", "s1", "wa " * 2000)] + [("en", "s1", "wa wb")] * 3 + [("xx", "alone", "term here"), ("yy", "a", None), ("yy", "b", "rare")]
    want = audit_brute(rows, 10, 10)
    assert {w[2] for w in want} == {"pair", "term"} and ("yy", "a", "pair", "b", 0, 1) in want
    got = divergence.audit(audit_table(spark, rows), block_bytes=block_bytes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == want
    loose = divergence.audit(audit_table(spark, rows), min_docs=1, top=3, block_bytes=block_bytes)
    assert sorted(map(tuple, loose.collect())) == audit_brute(rows, 1, 3)


def test_divergence_of_nothing(spark):
    assert divergence.audit(audit_table(spark, [])).count() == 0
    assert divergence.audit(audit_table(spark, [("en", "a", None), ("en", "a", "x")])).count() == 0


def test_many_occurrences_and_documents_of_one_chunk(spark):
    rows = [("en", "a", "word " * 300)] * 12 + [("en", "b", "word other")] * 12
    got = {(r.term, r.source): r.n for r in divergence.term_counts(audit_table(spark, rows), 10).collect()}
    assert got == {("word", "a"): 3600, ("word", "b"): 12, ("other", "b"): 12}


# --- decontamination --------------------------------------------------------

def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def leaks_brute(docs, items, window, reach):
    tokens = [words_of(t) for _, t in docs]
    freq = Counter(w for t in tokens for w in t)
    wins = defaultdict(set)
    for item, text in items:
        ws = words_of(text)
        for a in range(max(1, len(ws) - window + 1) if ws else 0):
            wins[tuple(ws[a:a + window])].add("" if item is None else str(item))
    out = []
    for (doc, _), t in zip(docs, tokens):
        hit, own, near = set(), set(), set()
        for w, ids in wins.items():
            at = [p for p in range(len(t) - len(w) + 1) if tuple(t[p:p + len(w)]) == w]
            for p in at:
                hit |= set(range(p, p + len(w)))
            if at:
                own |= ids
                near |= ids
            rare = min(w, key=lambda x: (freq[x], x.encode()))
            if any(x == rare and set(w) <= set(t[max(0, p - reach):p + reach + 1]) for p, x in enumerate(t)):
                near |= ids
        out.append((doc, len(t), len(hit), len(own), sha(",".join(sorted(own, key=str.encode))), bool(hit), len(near)))
    return sorted(out, key=str)


def leak_tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, block string, tid int, exact int")
    return d, spark.createDataFrame([(i, t, "y", 3) for i, t in items], "item_id long, text string, cls string, wid int")


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontamination_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "CANDIDATES", 7)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(60)] + ["The", "the", "été", "ÉTÉ", "a1"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "!\n", " - "]) for _ in range(n))
    items = [(i, text(rng.randint(0, 25))) for i in range(25)] + [(3, None), (None, text(12)), (40, "the"), (41, "The été"), (10, text(14)), (2, " . ")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)] + [(None, None), (100, ""), (101, " ?! "), (7, "the"), (7, "the")]
    for k in range(30):
        i, t = items[rng.randrange(len(items))]
        ws = words_of(t)
        a = rng.randint(0, 5)
        docs.append((200 + k, text(rng.randint(0, 8)) + " " + " ".join(ws[a:a + rng.randint(3, 14)]) + " " + text(3)))
        mixed = ws[a:a + 10]
        rng.shuffle(mixed)
        docs.append((300 + k, " ".join(mixed) + " " + text(4)))
    docs += [(500, text(900) + " " + items[0][1] + " " + text(900)), (501, "the " * 500)] + [(600 + k, items[1][1] or "the") for k in range(20)]
    d, b = leak_tables(spark, docs, items)
    got = decontam.contamination(d, b, block_bytes=block_bytes)
    want = leaks_brute(docs, items, decontam.WINDOW, decontam.NEAR)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(w[2] > 0 for w in want) > 20
    assert any(w[6] > w[3] for w in want)
    narrow = decontam.contamination(d, b, window=3, reach=1, block_bytes=block_bytes)
    assert sorted(map(tuple, narrow.collect()), key=str) == leaks_brute(docs, items, 3, 1)


def test_occurrences_are_placed(spark):
    d, b = leak_tables(spark, [(1, "zero one two three one two"), (2, "two one"), (3, None)], [(5, "one two"), (6, "One, two")])
    got = sorted((r.doc_id, r.item_id, r.kind, r.place, r.length) for r in decontam.occurrences(d, b, reach=1).collect() if r.kind == "exact")
    assert got == [(1, i, "exact", p, 2) for i in "56" for p in (1, 4)]
    near = {r.doc_id for r in decontam.occurrences(d, b, reach=1).collect() if r.kind == "near"}
    assert near == {1, 2}


def test_decontamination_of_nothing(spark):
    d, b = leak_tables(spark, [(1, "a b c"), (2, None)], [(1, "a b c")])
    assert decontam.contamination(d.limit(0), b).count() == 0
    clean = sorted(map(tuple, decontam.contamination(d, b.limit(0)).collect()))
    assert clean == [(1, 3, 0, 0, sha(""), False, 0), (2, 0, 0, 0, sha(""), False, 0)]


def test_packed_integers_come_back():
    rng = np.random.default_rng(3)
    v = np.concatenate([[0, 1, 127, 128, 16383, 16384, 2 ** 40], rng.integers(0, 1 << 30, 500), rng.integers(0, 200, 500)])
    data, size = decontam.pack_ints(v)
    assert size.sum() == len(data) and (decontam.unpack_ints(data) == v).all()
    assert len(decontam.unpack_ints(decontam.pack_ints(np.zeros(0, np.int64))[0])) == 0


# --- conversation trie ------------------------------------------------------

def rebuilt_brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = sha(f"{len(role.encode())}:{role}:{text}")[:32]
            own[conv].append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(np.fix(c / 20)) * 20
        out[c] = own.get(base, [])[:h] + t[h:]
    return out


def trie_brute(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in paths.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = Counter(p[:-1] for p in members if p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words(p)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, digest string, rn int, h string")


def trie(spark, rows, block):
    turns = convtrie.rebuilt(convtrie.numbered_turns(conversations(spark, rows)))
    return sorted((tuple(r) for r in convtrie.prefix_trie(turns, block).drop("digest").collect()), key=lambda r: tuple((x is not None, x) for x in r))


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("block", [2, 3, 8])
def test_trie_against_brute_force(spark, block):
    rng = random.Random(block)
    say = lambda k: rng.choice(["user", "assistant", None]) if k > 3 else "user"
    rows = []
    for c in [*range(0, 120), -5, -20, -41, 1000, 1007]:
        style = rng.choice(["short", "copy", "deep", "one"])
        n = {"short": rng.randint(1, 4), "copy": 6, "deep": rng.randint(5, 30), "one": 1}[style]
        for k in range(n):
            text = f"same words {k}" if style in ("copy", "deep") and k < rng.randint(4, 40) else rng.choice(["a b", "c", "", None, "d e f\n"])
            rows.append((c, rng.choice([k, k, k, None]) if k % 7 == 0 else k, "user" if style == "copy" else say(k), text))
    rows += [(1007, 3, "user", "tie"), (1007, 3, "user", "tie"), (1007, 3, "bot", "tie"), (None, 0, "user", "lost"), (2000, 0, "user", "only"), (2001, None, None, None)]
    assert trie(spark, rows, block) == order(trie_brute(rebuilt_brute(rows)))


def test_trie_with_turnless_conversations_and_long_copies(spark):
    """Conversations whose only turns are given up for those of an absent one
    end at the root; long copies share one path."""
    lone = [c for c in range(1001, 1400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:6]
    long = [(c, k, "user", f"turn {k} of a long talk") for c in (20, 40, 60, 80) for k in range(150)]
    rows = [(c, 0, "user", "gone") for c in lone] + long + [(80, 150, "user", "one more")]
    got = trie(spark, rows, 4)
    assert got == order(trie_brute(rebuilt_brute(rows)))
    root = next(r for r in got if r[1] == 0)
    assert root[7] == sha(",".join(map(str, lone)))


def test_trie_of_nothing(spark):
    assert trie(spark, [], 8) == []
    assert trie(spark, [(None, 1, "user", "x")], 8) == []
    assert trie(spark, [(0, 0, None, None)], 8) == order(trie_brute(rebuilt_brute([(0, 0, None, None)])))


# --- helpers ----------------------------------------------------------------

def test_joined_digest_of_a_hot_key(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"k{i % 50}", i) for i in range(300)]
    df = settle(spark.createDataFrame(rows, "key string, id long").selectExpr("key", "id", "cast(id as string) text").repartition(8), "digest-test")
    got = {r["key"]: (r["n"], r["sha256"]) for r in joined_sha256(df, "key", "id").collect()}
    want = defaultdict(list)
    for k, i in rows:
        want[k].append(i)
    assert got == {k: (len(v), sha(",".join(map(str, sorted(v))))) for k, v in want.items()}


def test_join_counted_keeps_every_row(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(200)]
    facts = spark.createDataFrame(rows, "key string, id long")
    keys = facts.groupBy("key").count().selectExpr("key", "upper(key) name", "count n")
    got = sorted((r["key"], r["id"], r["name"]) for r in join_counted(facts, keys, "key", "n").collect())
    assert got == sorted((k, i, k.upper()) for k, i in rows)


def test_every_label_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 300)
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} text of label {i % 230}", f"l{i % 230:03d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in df.where(langid.held_out()).collect()}
    bags = langid.training_bags(df, "doc_id", "text", "lang").collect()
    assert {b["label"] for b in bags} == {r[2] for r in rows if r[0] not in held}
    assert len(langid.fit(df).labels) == len({b["label"] for b in bags}) > 200
