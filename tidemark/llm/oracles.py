"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

from tidemark.llm import rules, secrets

WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    """doc_id, i, word: one row a word."""
    return f"""l AS (SELECT doc_id, regexp_extract_all({text}, '{WORD}') AS ws FROM documents),
 w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l)"""


def gram(n: int) -> str:
    return "concat_ws(' ', word, " + ", ".join(f"lead(word, {k}) OVER d" for k in range(1, n)) + ")"


JACCARD = f"""WITH RECURSIVE {words(_LOWER)},
 g AS (SELECT doc_id, i, {gram(5)} AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 s AS (SELECT DISTINCT doc_id, least(n, 5) AS k, s FROM g WHERE i <= greatest(n - 4, 1)),
 z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT x, y FROM o JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
 c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN z USING (doc_id)"""

SUBSTRINGS = f"""WITH {words("coalesce(text, '')")},
 g AS (SELECT doc_id, i, word, {gram(13)} AS s, i <= count(*) OVER (PARTITION BY doc_id) - 12 AS whole FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 f AS (SELECT s, min(doc_id) AS first FROM g WHERE whole GROUP BY s),
 m AS (SELECT doc_id, i, word, whole AND f.first < doc_id AS hit FROM g LEFT JOIN f USING (s)),
 c AS (SELECT doc_id, i, word, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM m),
 a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN a USING (doc_id)"""

_HEAD = secrets.HEAD.replace('\\"', '"').replace("'", "''")


def _located(kind: int, pattern: str, value: str, good: str) -> str:
    """Places of all matches of a pattern, by the lengths of gaps and matches."""
    pairs = rf"(?s)(.*?)(?:({pattern})|\z)"
    return f"""SELECT doc_id, owner, repository, {kind} AS kind, stop - length(found) AS start, stop AS "end", {value} AS value FROM (
  SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
   SELECT doc_id, owner, repository, unnest(regexp_extract_all(text, '{pairs}', 1)) AS gap, unnest(regexp_extract_all(text, '{pairs}', 2)) AS found, unnest(range(len(regexp_extract_all(text, '{pairs}', 1)))) AS i FROM t))
 WHERE found <> '' AND {good}"""


_VALUE = f"regexp_extract(found, '\\A{_HEAD}({secrets.VALUE})\\z', 1)"
_NAME = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END"
_SHOWN = f"string_agg({_NAME} || ':' || CAST(start AS BIGINT) || ':' || CAST(\"end\" AS BIGINT), ',' ORDER BY start, kind)"

SECRETS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
 s AS (
 {_located(0, _HEAD + secrets.VALUE, _VALUE, f"length({_VALUE}) >= {secrets.MIN_VALUE}")}
 UNION ALL {_located(1, "AKIA[A-Z0-9]+", "found", "length(found) >= 18")}
 UNION ALL {_located(2, "[0-9a-f]+", "found", "length(found) >= 16")}
 UNION ALL {_located(3, secrets.TOKEN, "found", "regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]')")}),
 o AS (SELECT value, count(DISTINCT owner) <= {secrets.MOST_OWNERS} AND count(DISTINCT (owner, repository)) <= {secrets.MOST_REPOSITORIES} AS live FROM s GROUP BY value),
 j AS (SELECT s.*, live FROM s JOIN o USING (value)),
 k AS (SELECT *, kind < 3 AS base, kind = 3 AND live AND NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = j.doc_id AND b.kind < 3 AND b.start <= j.start AND j."end" <= b."end") AS owned FROM j),
 a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {_SHOWN} FILTER (base) AS base, {_SHOWN} FILTER (base OR owned) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM documents d LEFT JOIN a USING (doc_id)"""

RULES = f"""WITH {words("coalesce(text, '')")},
 g AS (SELECT doc_id, i, word, {gram(8)} AS s, i <= count(*) OVER (PARTITION BY doc_id) - 7 AS whole FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 m AS (SELECT *, whole AND count(*) OVER (PARTITION BY doc_id, s, whole) > 1 AS twin FROM g),
 c AS (SELECT doc_id, word, max(CASE WHEN twin THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS again FROM m),
 a AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(again) AS n_repeat_words FROM c GROUP BY doc_id),
 b AS (SELECT doc_id, coalesce(source, '') AS host, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
 f AS (SELECT doc_id, host, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, coalesce(n_symbols, 0) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM b LEFT JOIN a USING (doc_id)),
 r AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed, 10 * n_symbols > word_chars AS f0, 10 * n_dup_lines > 3 * n_lines AS f1, word_chars > 20 * n_words AS f2 FROM f),
 h AS (SELECT host, count(*) AS n, {", ".join(f"count(*) FILTER (f{i}) AS k{i}" for i in range(3))} FROM r GROUP BY host),
 p AS (SELECT {", ".join(f"sum(k{i}) / sum(n) AS m{i}, greatest(var_pop(k{i} / n) - sum(k{i}) / sum(n) * (1 - sum(k{i}) / sum(n)) * avg(1 / n), 1e-6) AS b{i}" for i in range(3))} FROM h),
 q AS (SELECT {", ".join(f"m{i}, least(greatest(m{i} * (1 - m{i}) / b{i} - 1, 2.0), 10000.0) AS s{i}" for i in range(3))} FROM p),
 x AS (SELECT host, {", ".join(f"(k{i} + m{i} * s{i}) / (n + s{i}) AS r{i}, n + s{i} AS w{i}, m{i}" for i in range(3))} FROM h, q),
 z AS (SELECT host, {", ".join(f"coalesce((r{i} - {rules.FACTOR} * m{i}) / nullif(sqrt(r{i} * (1 - r{i}) / (w{i} + 1)), 0), -9.0) AS z{i}" for i in range(3))} FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(f"(f{i} AND z{i} > {rules.TAIL})" for i in range(3))}) AS kept, CAST(floor(greatest(z0, z1, z2) * 1000 + 0.5) AS BIGINT) AS host_excess_milli FROM r JOIN z USING (host)"""

SQL = {"op1_ngram_jaccard": JACCARD, "op2_secret_ownership": SECRETS, "op8_host_rules": RULES, "op10_fm_substrings": SUBSTRINGS}
