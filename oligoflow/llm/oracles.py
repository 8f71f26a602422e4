"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import LINE_PERCENT, MIN_WORDS, NGRAM_PERCENT, SYMBOL_PERCENT

_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(words: str, n: int) -> str:
    """SQL of the list of distinct shingles of a list of words."""
    return f"CASE WHEN len({words}) >= {n} THEN list_distinct([array_to_string({words}[i:i + {n - 1}], ' ') FOR i IN range(1, len({words}) - {n - 2})]) WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT doc_id, unnest({_shingles('ws', 4)}) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n_shingles + b.n_shingles - common)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT DISTINCT x, x AS y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, coalesce(c.least, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) c ON c.x = d.doc_id"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
twice AS (SELECT key FROM win GROUP BY key HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (key)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: Bytes are pairs of hexadecimal digits here.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, since, substring(h, 2 * since + 1, 2798) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399, 1000)) AS since FROM d)),
win AS (SELECT doc_id, since + i AS i, md5(substring(h, 2 * i + 1, 800)) AS key FROM (SELECT doc_id, since, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM part)),
twice AS (SELECT key FROM win GROUP BY key HAVING count(*) > 1),
hit AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS new FROM win JOIN twice USING (key)),
run AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS lo, max(i) + 400 AS hi FROM run GROUP BY ALL),
cut AS (SELECT doc_id, h, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM span JOIN d USING (doc_id)),
left_ AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, concat(string_agg(substring(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo), substring(any_value(h), 2 * max(hi) + 1)) AS kept FROM cut GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN left_ USING (doc_id)"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, unnest({_shingles('ws', 5)}) AS shingle FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents)),
i AS (SELECT item_id, unnest({_shingles('ws', 5)}) AS shingle FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark)),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*)::DOUBLE / item_shingles AS containment FROM d JOIN i USING (shingle) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING 100 * count(*) >= 80 * item_shingles"""


def _covered(n: int) -> str:
    """CTEs of the words inside n-grams found twice or more in their text: how many, and their characters."""
    return f"""g{n} AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM w WHERE len(ws) >= {n})),
t{n} AS (SELECT doc_id, key FROM g{n} GROUP BY ALL HAVING count(*) > 1),
c{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM g{n} JOIN t{n} USING (doc_id, key)),
s{n} AS (SELECT doc_id, count(*) AS n{n}, CAST(sum(length(word)) AS BIGINT) AS chars{n} FROM c{n} JOIN words USING (doc_id, p) GROUP BY doc_id)"""


_SIZES = sorted({3, *NGRAM_PERCENT})
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
line AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
same AS (SELECT doc_id, line, count(*) AS n FROM line GROUP BY ALL),
lines AS (SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n_dup_lines, CAST(sum(CASE WHEN n > 1 THEN n * length(regexp_replace(line, '{_SPACE}', '', 'g')) ELSE 0 END) AS BIGINT) AS dup_line_chars FROM same GROUP BY doc_id),
{", ".join(_covered(n) for n in _SIZES)},
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n3, 0) AS n_repeat_words,
  coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(chars{n}, 0) AS dup_{n}gram_chars" for n in NGRAM_PERCENT)}
  FROM w LEFT JOIN lines USING (doc_id) {" ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in _SIZES)})
SELECT *, NOT base_failed AND 100 * n_symbols <= {SYMBOL_PERCENT} * greatest(word_chars, 1) AND {" AND ".join(f"100 * {x} * n_words <= ({b} * n_words + {(a - b) * MIN_WORDS}) * greatest(word_chars, 1)" for x, (a, b) in [("dup_line_chars", LINE_PERCENT), *((f"dup_{n}gram_chars", y) for n, y in NGRAM_PERCENT.items())])} AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""

MIX_SOURCES = """
WITH RECURSIVE n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n)::DOUBLE * (SELECT count(*) FROM documents)::DOUBLE / c::DOUBLE AS rate FROM n),
steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS total FROM r
  UNION ALL
  SELECT source, rate, k + 1, term * (rate / (k + 1)), total + term * (rate / (k + 1)) FROM steps WHERE k <= rate + 60 * sqrt(rate) + 60 AND (k <= rate OR 1.0 - total >= pow(2.0, -53))),
u AS (SELECT *, ('0x' || substring(md5(concat('17|', coalesce(doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT / pow(2.0, 52) AS u FROM documents),
counted AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM u.source AND s.total <= u.u) AS copies FROM u),
copied AS (SELECT doc_id, source, text, CAST(unnest(range(0, copies)) AS INT) AS copy_no FROM counted)
SELECT doc_id, source, copy_no, ('0x' || substring(md5(concat('17|order|', coalesce(doc_id::VARCHAR, 'null'), '|', copy_no)), 1, 13))::BIGINT / pow(2.0, 52) AS shuffle_key, text FROM copied"""

_BASE32 = "array_to_string(flatten([[substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substring(h, 1 + 5 * g, 5))::BIGINT >> (15 - 5 * k)) & 31)::INT, 1) FOR k IN range(0, 4)] FOR g IN range(0, 8)]), '')"
WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
best AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM p JOIN best USING (h)"""

#: CRC-32 of a decimal number, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT)"
CONVERSATION_TRIE = f"""
WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT *, {_CRC} % 4 AS h FROM t),
r AS (SELECT c.conv_id, list_concat(coalesce(s.turns[1:h], []), c.turns[h + 1:]) AS turns FROM c LEFT JOIN t s ON s.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, turns[1:d] AS key, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY key, d),
k AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(key[d].text, '{_WORD}')) END AS saved FROM n LEFT JOIN k USING (key)),
u AS (SELECT key[1:up] AS key, CAST(count_if(n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM o) GROUP BY 1)
SELECT o.conv_id, o.d AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM o JOIN u USING (key) LEFT JOIN n q ON o.d > 0 AND q.key = o.key[1:o.d - 1]"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS ts FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
total AS (SELECT count_if(len(ts) > 0)::BIGINT AS n_all, sum(len(ts))::BIGINT AS l_all FROM d),
tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_all) // l_all)))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
