"""Corpus operators as Spark jobs: brute force, nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from netsleuth.llm import bpe, components, fingerprint, langid, lmscore, packing, quality, simhash, spans, sufarray, warc
from netsleuth.session import scratch_path

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _rid string, kept int, cuts string"


def table(spark, rows, langs=None):
    """Documents with extra columns whose names clash with the operators'."""
    return spark.createDataFrame([(d, t, langs[i] if langs else "en", "s", None if t is None else len(t), "r", 1, "c")
                                  for i, (d, t) in enumerate(rows)], DOCS)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank and long texts, ties, repeated and null ids."""
    rng = random.Random(1)
    base = prose(rng, 80)
    long = prose(rng, 30000)
    return [(5, base), (3, base), (9, base + " end"), (4, None), (6, ""), (7, " \n\t "), (8, "one two"), (None, base), (None, None),
            (10, long), (11, long), (12, "é" * 500), (12, "é" * 500), (13, prose(rng, 60)), (14, "x")]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def _simhash_brute(rows):
    fps = [simhash.fingerprint(None if t is None else t.encode()) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    best = {}
    for (d, _), g in zip(rows, label):
        if d is not None:
            best[g] = min(best.get(g, d), d)
    return sorted(((d, f"{f:016x}", best.get(g)) for (d, _), f, g in zip(rows, fps, label)), key=str)


def test_simhash_components_brute_force(spark, odd):
    rng = random.Random(4)
    near = [prose(rng, 60) for _ in range(6)]
    rows = odd + [(100 + i, rng.choice(near) + " " + prose(rng, rng.randint(0, 2))) for i in range(60)]
    got = [tuple(r) for r in simhash.simhash_components(table(spark, rows)).drop("_rid").collect()]
    assert sorted(got, key=str) == _simhash_brute(rows)
    kept = simhash.keep_first_of_groups(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    groups = {c if c is not None else f for _, f, c in _simhash_brute(rows)}
    out = kept.collect()
    assert len(out) == len(groups) and {r.doc_id for r in out if r.doc_id is not None} <= {c for c in groups if isinstance(c, int)}
    assert simhash.simhash_components(table(spark, [])).count() == 0 == simhash.keep_first_of_groups(table(spark, [])).count()


@pytest.mark.parametrize("limit", [None, 40, 3])
def test_fingerprint_links_lose_no_link(spark, limit):
    """Random fingerprints with planted chains, against all pairs; groups under
    one key that exceed ``limit`` are taken apart and dealt over tasks."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2 ** 64, 12, dtype=np.uint64)
    fps = set()
    for c in centre.tolist():
        for _ in range(60):
            x = c
            for p in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(p)
            fps.add(x)
    fps |= {int(centre[0]) ^ (x << 60) ^ (y << 30) for x in range(16) for y in range(16)}      # many that share most blocks
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in components.components(simhash.fingerprint_links(df, limit=limit)).collect()}
    label = {x: x for x in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for (a, x), (b, y) in itertools.combinations(zip(fps, signed), 2):
        if bin(a ^ b).count("1") <= 3:
            r, s = root(x), root(y)
            label[max(r, s)] = min(r, s)
    assert got == {x: root(x) for x in signed if any(root(y) == root(x) and y != x for y in signed)}


def _dedup_brute(rows, length):
    count = {}
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), edges, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1500, 3, 1])
def test_suffix_array_dedup_brute_force(spark, limit, monkeypatch):
    """``limit`` 1 and 3: values are split again and again, and what is left is compared window by window."""
    monkeypatch.setattr(sufarray, "SHARD_REGIONS", limit)
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdé") for _ in range(60)) for _ in range(4)]
    piece = lambda: rng.choice(["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 30))),
                                rng.choice(passages)[rng.randint(0, 8):], "x" * rng.randint(1, 50), "ab" * rng.randint(1, 30)])
    rows = [(i, "".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (202, rows[3][1]), (None, "q" * 100), (None, "z" * 19), (300, "y" * 3000)]
    got = [tuple(r)[:5] for r in sufarray.dedup_digests(table(spark, rows), 20, 8).collect()]
    assert sorted(got, key=str) == _dedup_brute(rows, 20)


def test_a_crowded_value_goes_through_the_array(spark, monkeypatch):
    """A passage in 2,000 different surroundings: more regions of one value than
    a shard holds.  They are split, and none is compared window by window."""
    def never(*_):
        raise AssertionError("windows were compared one by one")
    monkeypatch.setattr(sufarray, "_window_starts", never)
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared, other = letters(12), letters(60)
    rows = [(i, letters(40) + shared + letters(40)) for i in range(2000)] + [(3000, other + "zz"), (3001, "yy" + other), (3002, same := letters(50)), (3003, same)]
    value = Counter(v for _, t in rows for v in sufarray.regions_of(t.encode(), 40, 8)[0].tolist())
    monkeypatch.setattr(sufarray, "SHARD_REGIONS", 60)
    assert max(value.values()) > 3 * sufarray.SHARD_REGIONS
    got = [tuple(r)[:5] for r in sufarray.dedup_digests(table(spark, rows), 40, 8).collect()]
    assert sorted(got, key=str) == _dedup_brute(rows, 40) and sum(g[2] > 0 for g in got) == 4


def test_suffix_array_dedup_production_length(spark, odd):
    rng = random.Random(6)
    shared = prose(rng, 90)
    rows = odd + [(50, prose(rng, 200) + shared), (51, shared + prose(rng, 100)), (52, shared[:399])]
    got = [tuple(r)[:5] for r in sufarray.dedup_digests(table(spark, rows)).collect()]
    assert sorted(got, key=str) == _dedup_brute(rows, sufarray.LENGTH)
    out = sufarray.without_repeats(table(spark, rows), count_col="n_chars")
    assert out.columns == table(spark, rows).columns and out.count() == len(rows)
    for r in out.collect():
        assert (r.text is None) == (r.n_chars is None) and (r.text is None or r.n_chars == len(r.text))
    assert sufarray.dedup_digests(table(spark, [])).count() == 0 == sufarray.without_repeats(table(spark, [])).count()


def test_warc_round_trip(spark):
    rng = random.Random(7)
    edge = warc.BETWEEN.decode()
    rows = [(1, "http://a b", "hello"), (2, None, "hello"), (3, "u", None), (4, "u", ""), (5, "x", "é" * 3000), (6, "y", "q" * 700 + edge * 3),
            (7, "z", edge), (None, "n", "hello"), (None, "n", "only\r\n"), (9, "z", "WARC/1.1\r\nx\r\n"), (10, "a", "\r\n" * 900),
            (12, "k", edge * 90), (13, "e", "x" * 1000), (14, "p", "\r\n\r\n"), (14, "p", "\r\n\r\n"), (15, "w", "WARC/1.1\r\n" * 300)]
    rows += [(100 + i, "r", "ab\r\n" * rng.randint(0, 600) + str(i) + "\r\n" * rng.randint(0, 4)) for i in range(20)]
    pages = spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, _rid int, sha1 string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, chunk_bytes=1000)
    chunks = warc.read_chunks(spark, path).collect()
    assert all(c.intact for c in chunks) and max(len(c.chunk or b"") for c in chunks) <= 1000
    whole = {}
    for c in sorted(chunks, key=lambda c: (c.record_id, c.chunk_no)):
        whole[c.record_id] = whole.get(c.record_id, b"") + bytes(c.chunk or b"")
        if c.record_type == "response":  # the digest is carried from chunk to chunk
            assert c.payload_digest == base64.b32encode(hashlib.sha1(whole[c.record_id]).digest()).decode()
            assert c.payload_bytes == len(whole[c.record_id])
    first = {}
    for i, (p, _, h) in enumerate(rows):
        first.setdefault(h or "", []).append((p is None, p or 0, i))
    want = []
    for i, (p, _, h) in enumerate(rows):
        at, b = min(first[h or ""]), (h or "").encode()
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                     *(("response", None) if at[2] == i else ("revisit", at[1]))))
    got = [(c.page_id, c.payload_bytes, c.payload_digest, c.record_type, c.refers_to) for c in chunks if c.last]
    assert sorted(got, key=str) == sorted(want, key=str)
    empty = scratch_path(spark, "warc-empty")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_chunks(spark, empty).count() == 0


def test_warc_minimum_length_keeps_short_payloads(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "longer"), (4, "d", "longer")], "page_id long, url string, html string")
    path = scratch_path(spark, "warc-min")
    warc.write_archives(pages, path, min_bytes=4)
    kinds = {c.page_id: (c.record_type, c.refers_to) for c in warc.read_chunks(spark, path, with_chunks=False).collect()}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_bpe_documents(spark, odd):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_documents(table(spark, odd), path).collect()), key=str)
    want = []
    for d, t in odd:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(table(spark, []), path).count() == 0


def test_packing_documents(spark, odd):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = odd + [(500 + i, "word " * (37 * i % 400)) for i in range(40)]
    got = packing.pack_documents(table(spark, rows), path, with_ids=True).collect()
    ids = {}
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        ids.setdefault(r.doc_id, []).append((r.piece, r.start, bytes(r.ids)))
    for d, t in rows:
        if [x for x, _ in rows].count(d) == 1:
            parts = sorted(ids[d])
            assert b"".join(p for _, _, p in parts) == np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
            assert [s for _, s, _ in parts] == list(itertools.accumulate([0] + [len(p) // 4 for _, _, p in parts[:-1]]))
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():  # gapless from 0, at most 1024
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(r.length for r in got) // 1024) + 2
    assert packing.pack_documents(table(spark, []), path).count() == 0


def test_digests_with_next(spark, odd):
    rows = [(d, t) for d, t in odd if d != 12]
    got = {r.doc_id: r for r in fingerprint.compare_with_next(table(spark, rows)).collect() if r.doc_id is not None}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    tables = fingerprint.hash_tables()
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        if d is not None:
            t, following = t or "", following or ""
            half = len(t) // 2
            new = t[:len(t) - half] + following[:half]
            own = [fingerprint.digest(x.encode(), tables) for x in (t, new, following)]
            r = got[d]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == \
                (len(t), hashlib.sha256(new.encode()).hexdigest(), own[0], own[1])
            assert r.near_edited == fingerprint.likeness(own[0], own[1]) and r.near_next == fingerprint.likeness(own[0], own[2])
    assert fingerprint.compare_with_next(table(spark, rows)).count() == len(rows)
    one = fingerprint.compare_with_next(table(spark, [(1, "abc")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.compare_with_next(table(spark, [])).count() == 0
    assert fingerprint.fingerprints(table(spark, odd)).count() == len(odd)


def _split_brute(text):
    """Sentences read character by character; long ones are not cut here."""
    out, at = [], 0
    for i, c in enumerate(text):
        mark = c in ".!?" and i + 1 < len(text) and text[i + 1].isspace()
        if mark or c == "\n":
            out.append(text[at:i + 1])
            at = i + 1
    return out + ([text[at:]] if at < len(text) else [])


def _spans_brute(rows, run=3, least=10):
    """Runs by the rule: from each sentence on, and up to each, the shortest of
    ``run`` sentences with a word and ``least`` words; a text of fewer is one."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone, parts = set(), [set() for _ in rows], [_split_brute(t or "") for _, t in rows]
    for i in order:
        full = [(k, w) for k, s in enumerate(parts[i]) if (w := s.lower().split())]
        assert all(len(w) <= spans.LONG_SENTENCE for _, w in full)
        size = lambda a, z: sum(len(w) for _, w in full[a:z])
        found = set()
        for a in range(len(full)):
            found |= set([(a, z) for z in range(a + run, len(full) + 1) if size(a, z) >= least][:1])
        for z in range(len(full) + 1):
            found |= set([(a, z) for a in range(z - run, -1, -1) if size(a, z) >= least][:1])
        if not found and len(full) >= run:
            found = {(0, len(full))}
        for a, z in sorted(found):
            key = " ".join(x for _, w in full[a:z] for x in w)
            if key in seen:
                gone[i] |= set(range(full[a][0], full[z - 1][0] + 1))
            seen.add(key)
    return sorted(((d, len(s), len(g), None if t is None else "".join(x for k, x in enumerate(s) if k not in g))
                   for (d, t), g, s in zip(rows, gone, parts)), key=str)


def test_sentence_spans_brute_force(spark, odd):
    rng = random.Random(8)
    bank = [prose(rng, rng.randint(1, 12)).capitalize() + "." for _ in range(40)]
    passage = " ".join(bank[:6])
    odd = [(d, t) for d, t in odd if t is None or len(t.split()) <= spans.LONG_SENTENCE]
    short = [" ".join(rng.choice(["a.", "b!", "c d.", "\n", "e?"]) for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = odd + [(300 + i, t) for i, t in enumerate(short)] + [(100 + i, " ".join(rng.choice(bank) for _ in range(8)) + ("\n" + passage if i % 3 == 0 else "")) for i in range(40)]
    rows += [(200, " ".join([passage] * 2))]
    got = [(r.doc_id, r.n_sentences, r.n_removed, r.kept_text) for r in spans.remove_repeats(table(spark, rows)).collect()]
    assert sorted(got, key=str) == _spans_brute(rows)
    assert spans.remove_repeats(table(spark, [])).count() == 0


def test_language_model_scores(spark):
    rng = random.Random(9)
    good, other = "red green blue white".split(), "one two three four".split()
    rows = [(i, prose(rng, 50, good if i % 2 else other)) for i in range(60)] + [(90, None), (91, " "), (None, "red two"), (92, "red"), (92, "red")]
    labels = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(1,)], "doc_id long")
    got = lmscore.score(table(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].score < 0) == bool(i % 2) for i in range(60))  # unlabelled ones too
    assert by[90].n_words == 0 and by[90].score is None and by[91].target_loss is None and by[1].target and not by[41].target
    none = lmscore.score(table(spark, rows), labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.score is None or np.isfinite(r.score) for r in none)
    assert lmscore.score(table(spark, []), labels).count() == 0


def test_language_id_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id") \
        .select("*", langid.held_out().alias("held")).collect()
    held = [r for r in rows if r.held and r.n_chars >= 100]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of that"), (4, "the and of that"), (None, "der die und das"), (5, "é"), (6, "the " * 200000)]
    got = langid.identify(table(spark, odd), model).collect()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert len(got) == len(odd) and und == {1, 2, 3} and all(r.rejected for r in got if r.lang_pred == "und")
    assert {r.doc_id for r in langid.accepted(table(spark, odd), model).collect()} >= {4, 6}
    assert langid.accepted(table(spark, odd), model).columns == table(spark, odd).columns
    nothing = langid.fit(table(spark, []))
    assert nothing is None and langid.identify(table(spark, odd), nothing).where("lang_pred = 'und'").count() == len(odd)
    assert langid.identify(table(spark, []), model).count() == 0


def test_quality_references_are_exact(spark, odd):
    from collections import Counter
    langs = ["en" if i % 3 else "de" if i % 2 else None for i in range(len(odd))]
    docs = table(spark, odd, langs)
    refs = quality.references(docs, common=5)
    for lang in {g for g, (_, t) in zip(langs, odd) if t}:
        words, classes = Counter(), np.zeros(quality.CLASSES)
        for (_, t), g in zip(odd, langs):
            if g == lang and t is not None:
                words.update(t.encode().lower().split())
                classes += quality.class_counts(t.encode())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert (refs[lang][0] == classes).all() and list(refs[lang][1]) == [w for w, _ in top]
        assert refs[lang][2].tolist() == [n for _, n in top] + [sum(words.values()) - sum(n for _, n in top)]
    got = sorted((tuple(r)[:8] for r in quality.judge(docs, refs).collect()), key=str)
    want = []
    for (d, t), g in zip(odd, langs):
        base, failed, _, _, kept = quality.verdict(None if t is None else t.encode(), g, refs)
        want.append((d, *base, failed, kept))
    assert got == sorted(want, key=str)
    out = quality.kept_documents(docs, refs)
    assert out.columns == docs.columns and out.count() == sum(w[-1] for w in want)
    assert quality.references(table(spark, [])) == {} and quality.judge(table(spark, []), {}).count() == 0


def test_quality_keeps_clean_and_rejects_poor_documents(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = quality.judge(docs, quality.references(docs)).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    sound = [r for r in rows if not r.base_failed]
    assert np.mean([r.kept for r in sound if r.quality == 1]) > 0.98
    assert np.mean([r.kept for r in sound if r.quality == 0]) < 0.25


def test_queries_and_pipeline(spark):
    import __spark_entry__ as entry
    import corpus_pipeline
    names = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        path = scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    whole = corpus_pipeline.run(spark, sf)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, packed.select(cols).collect()))


def test_language_model_counts_every_word_and_pair(spark, monkeypatch):
    """Small chunks and many buckets must not show: counts are those of whole words and pairs, and the
    prior is spread over the words that occur."""
    monkeypatch.setattr(lmscore, "CHUNK", 2000)
    monkeypatch.setattr(lmscore, "BUCKET", 1000)
    rng = random.Random(19)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, prose(rng, rng.randint(1, 60), words[:200] if i % 2 else words[100:])) for i in range(200)] + [(500, None), (501, " "), (7, "w1 w1 w1")]
    target = {*range(1, 150, 2)}
    word, pair = ([{}, {}] for _ in range(2))
    for d, t in rows:
        w = (t or "").split()
        for table_, grams in ((word, w), (pair, list(zip([None, *w], w)))):
            for g in grams:
                table_[d not in target][g] = table_[d not in target].get(g, 0) + 1
    size, vocabulary = [sum(x.values()) for x in word], len({*word[0], *word[1]})
    expect = []
    for d, t in rows:
        w = (t or "").split()
        p = list(zip([None, *w], w))
        loss = []
        for i in (0, 1):
            mine = (d in target) == (i == 0)
            total = size[i] - len(w) * mine
            scale = max(1, size[0] - len(w) * (d in target)) / max(1, total)
            out = []
            for before, x in p:
                p_word = ((word[i].get(x, 0) - w.count(x) * mine) * scale + lmscore.WORD_PRIOR) / (total * scale + lmscore.WORD_PRIOR * vocabulary)
                follow = max(word[i].get(before, 0) - w.count(before) * mine, 0) * scale
                both = min((pair[i].get((before, x), 0) - p.count((before, x)) * mine) * scale, follow)
                out.append(-np.log((both + lmscore.PAIR_PRIOR * p_word) / (follow + lmscore.PAIR_PRIOR)))
            loss.append(float(np.mean(out)) if out else None)
        expect.append((d, len(w), *loss))
    got = [(r.doc_id, r.n_words, r.target_loss, r.background_loss) for r in
           lmscore.score(table(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()]
    assert len(got) == len(expect)
    for x, y in zip(sorted(got, key=str), sorted(expect, key=str)):
        assert x[:2] == y[:2] and (x[2] is None) == (y[2] is None)
        assert x[2] is None or np.allclose(x[2:], y[2:])


def test_copies_with_short_sentences_go(spark):
    rng = random.Random(22)
    each = " ".join(w + "." for w in prose(rng, 150).split())  # a mark behind each word
    lines = "\n".join(f"{w}{i}" for i, w in enumerate(prose(rng, 40).split()))
    tail = " ".join(f"the ninth word of {i} is here for you." for i in range(3)) + " a. b. c."
    rows = [(1, each), (2, each), (3, lines), (4, lines), (5, tail), (6, tail + " other words follow here. and more. of them. until the end of it all."),
            (7, "p. q. r."), (8, "p. q. r.")]
    got = {r.doc_id: r for r in spans.remove_repeats(table(spark, rows)).collect()}
    assert [got[i].kept_text for i in (2, 4, 8)] == ["", "", ""] and got[3].kept_text == lines and got[7].kept_text == "p. q. r."
    assert got[6].kept_text == " other words follow here. and more. of them. until the end of it all."


def test_near_copies_without_ids_keep_one_row(spark):
    rng = random.Random(24)
    words = [f"w{i}" for i in range(3000)]
    base = prose(rng, 600, words)
    near = [base, base + " end", "start " + base]
    rows = [(None, t) for t in near] + [(1, prose(rng, 600, words))]
    found = simhash.simhash_components(table(spark, rows)).where("doc_id is null").collect()
    assert len({r.fingerprint for r in found}) > 1 and {r.component_id for r in found} == {None}
    kept = [(r.doc_id, r.text) for r in simhash.keep_first_of_groups(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, base), rows[-1]], key=str)
