"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from netsleuth.llm import convtrie as T
from netsleuth.llm import decontam as C
from netsleuth.llm import divergence as D
from netsleuth.llm import quality as Q

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 40 hexadecimal digits are eight groups of 20 bits, four base32 digits each.
_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', CAST((CAST('0x' || substr(hex, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * i}) & 31 AS INTEGER) + 1, 1)"
    for g in range(8) for i in range(4))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

#: Windows of 400 bytes are 800 hexadecimal digits; intervals of bytes that
#: repeated windows cover are merged, what is left is put together again.
SUFFIX_ARRAY = """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
n AS (SELECT doc_id, x, length(x) // 2 AS n FROM t),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(n - 399)) AS i FROM n WHERE n >= 400)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
cut AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM rep),
grp AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS b FROM grp GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, b - a AS len FROM span),
tot AS (SELECT doc_id, sum(len) AS removed, count(*) AS spans, max(b) AS tail FROM gap GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(n.x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k FROM gap JOIN n USING (doc_id)
         GROUP BY gap.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN n.x ELSE k || substr(n.x, 2 * tail + 1) END)) AS kept_sha256
FROM n LEFT JOIN tot USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Bytes of each character class of ``quality.CLASS``: the ASCII classes are
#: counted by pattern, bytes of other letters are the rest.
_CLASS_PATTERNS = ["a-z", "A-Z", "0-9", r" \t\x0b\x0c", r"\r\n", r".,;:!?'\"()\-", r"#*$%&|<>"]


def _count(pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"length(regexp_replace(text, '[^{p}]', '', 'g'))"


_CLASSES = ", ".join(f"{_count(p)} AS c{i}" for i, p in enumerate(_CLASS_PATTERNS))
_ASCII = "length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g'))"
_OTHER = " - ".join([_ASCII] + [_count(p) for p in _CLASS_PATTERNS])


def _distance(p: str, q: str) -> str:
    """Terms of the Jensen-Shannon divergence of two shares."""
    half = f"(({p} + {q}) / 2)"
    return (f"((CASE WHEN {p} > 0 THEN {p} * log2({p} / {half}) ELSE 0 END) + (CASE WHEN {q} > 0 THEN {q} * log2({q} / {half}) ELSE 0 END)) / 2")


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '?none') AS lang, text IS NULL AS gone, coalesce(text, '') AS text FROM documents),
wl AS (SELECT doc_id, lang, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, text FROM d),
word AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM wl),
tri AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS t FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri WHERE t IS NOT NULL) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT wl.doc_id, wl.lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words
         FROM wl LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id)),
cls AS (SELECT doc_id, lang, {_CLASSES}, {_OTHER} AS c7, octet_length(encode(text)) - {_ASCII} AS c8 FROM d WHERE NOT gone),
cell AS (SELECT doc_id, lang, k, v::DOUBLE AS v, sum(v) OVER (PARTITION BY doc_id)::DOUBLE AS s
         FROM (SELECT doc_id, lang, unnest([0,1,2,3,4,5,6,7,8]) AS k, unnest([c0,c1,c2,c3,c4,c5,c6,c7,c8]) AS v FROM cls)),
cref AS (SELECT lang, k, sum(v) / sum(sum(v)) OVER (PARTITION BY lang) AS q FROM cell GROUP BY lang, k),
cdist AS (SELECT doc_id, sqrt(greatest(0, sum({_distance("p", "q")}))) AS dist
          FROM (SELECT doc_id, v / s AS p, q FROM cell JOIN cref USING (lang, k) WHERE s > 0) GROUP BY doc_id),
lw AS (SELECT doc_id, lang, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM word),
wc AS (SELECT lang, w, count(*) AS n FROM lw GROUP BY lang, w),
top AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(w)) AS r FROM wc),
wref AS (SELECT lang, CASE WHEN r <= {Q.COMMON_WORDS} THEN r ELSE 0 END AS k, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY lang) AS q
         FROM top GROUP BY lang, CASE WHEN r <= {Q.COMMON_WORDS} THEN r ELSE 0 END),
dw AS (SELECT doc_id, lw.lang, CASE WHEN r <= {Q.COMMON_WORDS} THEN r ELSE 0 END AS k, count(*)::DOUBLE AS v
       FROM lw JOIN top ON top.lang = lw.lang AND top.w = lw.w GROUP BY ALL),
wdist AS (SELECT doc_id, sqrt(greatest(0, sum({_distance("p", "q")}))) AS dist
          FROM (SELECT b.doc_id, coalesce(dw.v, 0) / b.n_words AS p, r.q FROM base b JOIN wref r ON r.lang = b.lang
                LEFT JOIN dw ON dw.doc_id = b.doc_id AND dw.k = r.k WHERE b.n_words > 0) GROUP BY doc_id),
f AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT f.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(n_words < {Q.CHAR_MIN_WORDS} OR cdist.dist <= {Q.MAX_CHAR_DISTANCE}, true)
         AND coalesce(n_words < {Q.WORD_MIN_WORDS}
                      OR wdist.dist <= greatest({Q.MAX_WORD_DISTANCE}, {Q.WORD_LIMIT_BASE} + {Q.WORD_LIMIT_SLOPE} / sqrt(n_words)), true) AS kept,
       CASE WHEN n_words >= {Q.CHAR_MIN_WORDS} THEN round(cdist.dist, 9) END AS char_distance,
       CASE WHEN n_words >= {Q.WORD_MIN_WORDS} THEN round(wdist.dist, 9) END AS word_distance
FROM f LEFT JOIN cdist USING (doc_id) LEFT JOIN wdist USING (doc_id)"""

_GAP = "((p - q) * (p - q) // (p + q))"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {D.MIN_DOCS}),
ln AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS ln FROM g JOIN k USING (lang)
          LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM dense GROUP BY ALL),
p AS (SELECT dense.lang, dense.source, term, n, 1 + {D.SCALE}::HUGEINT * (n + 2) // (tot.total + 2 * v) AS p,
             1 + {D.SCALE}::HUGEINT * (ln + 2) // (ln.total + 2 * v) AS q
      FROM dense JOIN tot USING (lang, source) JOIN ln USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
         LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
term AS (SELECT lang, source, term AS item, {_GAP}::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
WHERE part = 'pair' OR rank <= {D.TOP_TERMS}"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Occurrences come from the place of a window's first word and a comparison of
#: the words; proximity from the places of its rarest word.
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS ws FROM documents),
it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS ws FROM benchmark),
wi AS (SELECT DISTINCT item, w FROM (
  SELECT item, unnest([ws[a:a + {C.WINDOW} - 1] for a in range(1, greatest(len(ws) - {C.WINDOW} + 2, 2))]) AS w FROM it WHERE len(ws) > 0)),
win AS (SELECT row_number() OVER () AS k, w, len(w) AS n FROM (SELECT DISTINCT w FROM wi)),
tok AS (SELECT i, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM d),
hit AS (SELECT tok.i, p, n, k FROM tok JOIN win ON tok.t = win.w[1] JOIN d ON d.i = tok.i WHERE d.ws[p:p + n - 1] = win.w),
covered AS (SELECT i, count(DISTINCT q) AS n_hit FROM (SELECT i, unnest(range(p, p + n)) AS q FROM hit) GROUP BY i),
term AS (SELECT k, unnest(w) AS t FROM win),
freq AS (SELECT t, count(*) AS f FROM tok WHERE t IN (SELECT t FROM term) GROUP BY t),
anchor AS (SELECT k, min((f, term.t)) AS a FROM term JOIN freq USING (t) GROUP BY k),
spot AS (SELECT DISTINCT a.k, tok.i, tok.p FROM anchor a JOIN tok ON tok.t = a.a[2]),
beside AS (SELECT DISTINCT spot.k, spot.i, spot.p, term.t FROM spot JOIN term USING (k) JOIN tok ON tok.i = spot.i AND tok.t = term.t
           AND tok.p BETWEEN spot.p - {C.NEAR} AND spot.p + {C.NEAR}),
need AS (SELECT k, count(DISTINCT t) AS c FROM term GROUP BY k),
near AS (SELECT DISTINCT b.k, b.i FROM (SELECT k, i, p, count(*) AS c FROM beside GROUP BY ALL) b JOIN need USING (k) WHERE b.c = need.c),
own AS (SELECT i, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT i, item FROM hit JOIN win USING (k) JOIN wi ON wi.w = win.w) GROUP BY i),
besides AS (SELECT i, count(DISTINCT item) AS n_near FROM (SELECT i, k FROM hit UNION SELECT i, k FROM near) JOIN win USING (k) JOIN wi ON wi.w = win.w GROUP BY i)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN covered USING (i) LEFT JOIN own USING (i) LEFT JOIN besides USING (i)"""

#: CRC-32 of the decimal digits of conv_id, bit by bit.
_CRC = ("list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), "
        "lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END))")

TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
             substr(sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || ':' || text), 1, 32)) AS rn FROM t),
c AS (SELECT conv_id, CAST(xor({_CRC}, 4294967295::UBIGINT) % {T.TAKEN} AS BIGINT) AS h, conv_id - conv_id % {T.FAMILY} AS base
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 1 AS part, rn, role, text FROM c JOIN o ON o.conv_id = c.base AND rn <= h
      UNION ALL SELECT o.conv_id, 2, rn, role, text FROM o JOIN c ON c.conv_id = o.conv_id AND rn > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
             list(sha256(role || chr(1) || text)) OVER (PARTITION BY conv_id ORDER BY part, rn) AS path FROM r
      WINDOW w AS (PARTITION BY conv_id ORDER BY part, rn)),
q AS (SELECT conv_id, depth, words, path FROM p UNION ALL SELECT conv_id, 0, 0, [] FROM c),
z AS (SELECT conv_id, max(depth) AS len FROM q GROUP BY conv_id),
n AS (SELECT path, depth, min(q.conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
             coalesce(string_agg(CAST(q.conv_id AS VARCHAR), ',' ORDER BY q.conv_id) FILTER (depth = len), '') AS ends
      FROM q JOIN z USING (conv_id) GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
up AS (SELECT path[1:d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved
       FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY path[1:d])
SELECT m.conv_id, m.depth::BIGINT AS depth, par.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
       up.n_leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN up USING (path) LEFT JOIN n par ON par.path = m.path[1:m.depth - 1] AND m.depth > 0"""

ORACLE = {"op13_conversation_trie": TRIE, "op12_benchmark_decontamination": DECONTAMINATION, "op1_warc_round_trip": WARC, "op3_quality_rules": QUALITY, "op10_suffix_array_dedup": SUFFIX_ARRAY,
          "op11_source_divergence": DIVERGENCE}
