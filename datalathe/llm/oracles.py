"""The registered queries' results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from datalathe.llm import codebooks, lexical, licenses, repetition

_BITS = "['" + "','".join(f"{i:04b}" for i in range(16)) + "']"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS low FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41),
  lambda j: {_BITS}[strpos('0123456789abcdef', substr(h, j, 1))]), '') AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_reduce(list_transform(range(1, 6), lambda k: CAST(substr(bits, 5 * i + k, 1) AS BIGINT)), lambda a, x: 2 * a + x), 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to
FROM b
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def _windows(n: int) -> str:
    """Positions whose window of n words occurs twice or more in its text."""
    return f"""(SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS times FROM (
      SELECT doc_id, pos, array_to_string(w[pos:pos + {n - 1}], ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS pos FROM t))) WHERE times > 1)"""


def _covered(n: int) -> str:
    return f"(SELECT doc_id, count(DISTINCT pos + k) AS n FROM {_windows(n)}, range({n}) AS r(k) GROUP BY doc_id)"


REPETITION = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered_words, x.doc_id IS NOT NULL AS too_long
  FROM t JOIN l USING (doc_id) LEFT JOIN {_covered(repetition.WINDOW)} r USING (doc_id)
  LEFT JOIN {_covered(repetition.MIN_REPEAT)} c USING (doc_id)
  LEFT JOIN (SELECT DISTINCT doc_id FROM {_windows(repetition.MAX_LONGEST + 1)}) x ON x.doc_id = t.doc_id),
f AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
  NOT base_failed AND n_covered_words <= n_words * CAST({repetition.MAX_COVERED} AS DOUBLE) AND NOT too_long AS kept
FROM f
"""


def _phrase(phrase: str, label: str) -> str:
    words = phrase.split()
    test = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words))
    return f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: {test})) - 1 AS start FROM t"


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(set(words))) + "]"


_TEMPLATES = ", ".join(
    f"('{label}', {_listed(text.split())}, {_listed(marked.split())}, {licenses.block_size(len(text.split()))})"
    for label, text, marked in licenses.TEMPLATES
)
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

LICENSES = rf"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT doc_id, regexp_extract_all(text, {_WORD}) AS w FROM low),
places AS ({" UNION ALL ".join(_phrase(p, label) for p, label in licenses.PHRASES)}),
template(label, words, marked, size) AS (VALUES {_TEMPLATES}),
possible AS (SELECT doc_id, w, label, words, marked, size FROM t, template
  WHERE list_has_all(w, marked) AND len(list_intersect(words, w)) >= ceil({licenses.THRESHOLD} * len(words) - 1e-9)),
blocks AS (SELECT doc_id, label, words, marked, w[i + 1:i + size] AS b
  FROM (SELECT *, unnest(range(0, greatest(len(w) - size, 0) + 1)) AS i FROM possible)),
hits AS (SELECT doc_id, label, CAST(len(list_intersect(words, b)) AS DOUBLE) / len(words) AS share FROM blocks
  WHERE len(list_intersect(words, b)) >= ceil({licenses.THRESHOLD} * len(words) - 1e-9) AND list_has_all(b, marked)),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS share FROM
  (SELECT doc_id, label, 1.0 AS share FROM places UNION ALL SELECT * FROM hits) GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CAST(coalesce(share, 0) AS DOUBLE) AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || safe || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role || ',', '' ORDER BY turn, role, text), '(system,)?(user,assistant,)+') AS valid
FROM e GROUP BY conv_id
"""


def _assigned(books: str) -> str:
    """Nearest entry and squared distance of every part."""
    return f"""SELECT r, part, v, arg_min(entry, d * {codebooks.ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT r, x.part, x.v, entry, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM x JOIN {books} b ON b.part = x.part) GROUP BY r, part, v"""


def _rounds() -> str:
    out = ""
    for i in range(codebooks.ROUNDS):
        out += f"""a{i} AS ({_assigned(f"b{i}")}),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
    SELECT part, entry, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM a{i}, range(1, len(v) + 1) AS g(i) GROUP BY part, entry, i)
  GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry),
"""
    return out


CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor({codebooks.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS r, len(v) // {codebooks.PARTS} AS w FROM k),
x AS (SELECT r, part, v[part * w + 1:part * w + w] AS v FROM n, range({codebooks.PARTS}) AS g(part)),
b0 AS (SELECT part, r - 1 AS entry, v FROM x WHERE r <= {codebooks.ENTRIES}),
{_rounds()}f AS ({_assigned(f"b{codebooks.ROUNDS}")}),
c AS (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{codebooks.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM n JOIN c USING (r), s
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _terms(table: str, key: str) -> str:
    return f"""SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), {_TERM}) AS w FROM {table}"""


RANKED = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n, row_number() OVER () AS r FROM ({_terms("documents", "doc_id")}) WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
items AS (SELECT DISTINCT item_id, unnest(w) AS term FROM ({_terms("benchmark", "item_id")}) WHERE item_id IS NOT NULL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
part AS (SELECT item_id, d.r, doc_id, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))) AS part
  FROM items JOIN tf USING (term) JOIN weight USING (term) JOIN d USING (r), total),
score AS (SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM part GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {lexical.TOP}
"""

ORACLES = {
    "op2_dictionary_warc": WARC,
    "op3_bit_sliced_top_k": TOP_K,
    "op4_repetition_rules": REPETITION,
    "op5_license_scan": LICENSES,
    "op7_chat_machine": CHAT,
    "op12_adaptive_bound_codes": CODES,
    "op13_automaton_search": RANKED,
}
