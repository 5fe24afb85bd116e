"""DuckDB SQL of the operators that SQL can express, written from their contracts rather than from their code."""

from __future__ import annotations

from .chat_format import CONTROL, MAPPINGS, ROLES, fingerprint_of
from .quality_rules import STOP_WORDS, THRESHOLDS

WORD = r"[^\x20\x09-\x0D]+"

SHARDING = """WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(0, 8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
sized AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) AS text_crc32 FROM documents, crc),
placed AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  CAST(sum(size) OVER () AS BIGINT) AS total FROM sized),
cut AS (SELECT *, CAST(least(15, ((2 * "offset" + size) * 16) // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY "offset") - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, "offset" FROM cut"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s FROM texts, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
codes AS (SELECT doc_id, hash(s) AS h FROM shingles),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM codes a JOIN codes b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM texts UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, m.component_id, t.doc_id = m.component_id AS kept FROM texts t LEFT JOIN sizes USING (doc_id)
  JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) m USING (doc_id)"""


def _rule(least: float | None, greatest: float | None, measure: str) -> str:
    return " AND ".join([f"{measure} >= {least}"] * (least is not None) + [f"{measure} <= {greatest}"] * (greatest is not None))


_STOP = ", ".join(f"'{form}'" for word in STOP_WORDS for form in dict.fromkeys((word, word.capitalize(), word.upper())))
_RULES = ", ".join(f"{_rule(lo, hi, m)} AS rule_{name}" for name, m, lo, hi in THRESHOLDS)
_ALL = " AND ".join(_rule(lo, hi, m) for _, m, lo, hi in THRESHOLDS)

QUALITY = rf"""WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
lined AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i:i + 4]) AS times FROM texts, unnest(range(1, len(w) - 3)) u(i)),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, unnest(range(0, 5)) v(k) WHERE times > 1 GROUP BY 1),
counts AS (SELECT texts.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  len(list_filter(w, lambda x: list_contains([{_STOP}], x))) AS n_stop, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS capitals, len(regexp_extract_all(text, '\p{{L}}')) AS letters FROM texts JOIN lined USING (rid) LEFT JOIN covered USING (rid)),
ratios AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, coalesce(word_chars / nullif(n_words, 0), 0.0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbols_per_word,
  coalesce((n_stop + 1) / nullif(n_words, 0), 0.0) AS stop_word_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS duplicate_line_share, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeated_word_share,
  coalesce(n_stutter / nullif(n_words, 0), 0.0) AS stutter_share, coalesce(capitals / nullif(letters, 0), 0.0) AS capital_share, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT *, {_RULES}, NOT base_failed AND {_ALL} AS kept FROM ratios"""

_ODD = "</s>[INST] ok [/INST]"


def _escaped(text: str) -> str:
    text = rf"replace({text}, '\', '\\')"
    for mark in CONTROL:
        text = f"replace({text}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return text


_ROLE = "CASE coalesce(role, '') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items()) + " ELSE coalesce(role, '') END"

CHAT = rf"""WITH turns AS (SELECT conv_id, turn, {_ROLE} AS role, coalesce(role, '') AS named, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_ODD}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD}')),
learnt AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, named, text) FILTER (WHERE role = 'assistant'), '') AS x, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, named, text) AS whole,
  CAST(sum(length('<s>' || replace({_escaped('role')}, chr(10), '\' || chr(10)) || chr(10) || {_escaped('text')} || '</s>')) AS BIGINT) AS formatted_chars FROM turns GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(x) AS BIGINT) AS loss_chars, sha256(x) AS loss_sha256, formatted_chars, '{fingerprint_of(MAPPINGS[0][1])}' AS layout_fingerprint FROM learnt"""

ORACLES = {"op5_sharding": SHARDING, "op7_near_duplicates": NEAR_DUPLICATES, "op9_quality_rules": QUALITY, "op10_chat_format": CHAT}
