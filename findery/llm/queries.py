"""One query per corpus operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findery.llm import (
    conversations, decontaminate, exact_dedup, html, jaccard, langid, line_dedup, mixing, periodic, pii, quality, secrets, toxicity,
)
from findery.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from findery.session import table


@query("op1_exact_dedup", sql="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secret_rule_sql(kind: int, rule: secrets.Rule) -> str:
    """Matches of one rule, and which of them are long enough."""
    names = "password|passwd|secret|token|api_?key"  # DuckDB would fold beyond ASCII, so letters are spelt out
    pattern = rule.pattern.replace(f"(?i:{names})", "|".join(map(_either_case, names.split("|")))).replace("'", "''")
    return f"""SELECT doc_id, text, {kind} AS kind, regexp_extract_all(text, '{pattern}') AS found,
    list_transform(regexp_extract_all(text, '{pattern}', {rule.group}), lambda x: length(x) >= {rule.least}) AS good FROM d"""


_KINDS = ", ".join(f"'{r.kind}'" for r in secrets.RULES)

# A match is the first place of its own text after the match before: an earlier place would have matched earlier.
SECRETS_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_secret_rule_sql(i, r) for i, r in enumerate(secrets.RULES))}),
walk AS (
  SELECT doc_id, text, kind, found, good, 0 AS i, 0 AS start, 0 AS stop FROM m WHERE len(found) > 0
  UNION ALL
  SELECT doc_id, text, kind, found, good, i + 1, stop + instr(substr(text, stop + 1), found[i + 1]) - 1,
    stop + instr(substr(text, stop + 1), found[i + 1]) - 1 + length(found[i + 1])
  FROM walk WHERE i < len(found)),
spans AS (SELECT doc_id, kind, start, stop, [{_KINDS}][kind + 1] || ':' || start || ':' || stop AS span
  FROM walk WHERE i > 0 AND good[i])
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
  count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_more,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id
"""


@query("op4_secret_scan", sql=SECRETS_SQL)
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_quality_resample")
def op10_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_html_extract")
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op8_mix_sources")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_passages(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("op6_jaccard_join", sql=f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    looped = periodic.loop_tails(table(spark, sf_dir, "documents"))
    return periodic.run_digest(periodic.find_runs(looped))


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def _later(state: int, arrivals: list[tuple[int, str, str]]) -> str:
    """Best entry of a state from (state before, cost, edit) or inserts; null ones are left out by least()."""
    ways = [f"""CASE WHEN p{i}.c IS NOT NULL THEN {{'c': p{i}.c + {cost}, 'a': p{i}.a || '{edit}', 't': p{i}.t || {text}}} END"""
            for i, cost, edit, text in arrivals]
    return f"least({', '.join(ways)}) AS p{state}" if len(ways) > 1 else f"{ways[0]} AS p{state}"


_KEEP, _RE = "role || ':' || text || chr(10)", "':' || text || chr(10)"
# Inserted rows: a state after walks of none, one or two steps along user and assistant.
_WALKS = {0: [(0, 0)], 1: [(1, 0)], 2: [(2, 0), (0, 1), (1, 1), (3, 1)], 3: [(3, 0), (2, 1), (0, 2), (1, 2)]}
_INSERTED = ", ".join(_later(j, [
    (i, 2 * n, "I" * n, "''" if n == 0 else "'user:' || chr(10) || 'assistant:' || chr(10)" if n == 2
     else "'user:' || chr(10)" if j == 2 else "'assistant:' || chr(10)") for i, n in ways]) for j, ways in _WALKS.items())


def _taken(j: int, role: str, before: list[int]) -> str:
    """Entry of a state after a row: deleted, kept or given another role."""
    name = {"s": "", "u": "user", "a": "assistant"}[role]
    ways = [f"CASE WHEN p{j}.c IS NOT NULL THEN {{'c': p{j}.c + 3, 'a': p{j}.a || 'D', 't': p{j}.t}} END"]
    for i in before:
        can = f"p{i}.c IS NOT NULL AND fault NOT IN ('blank', 'duplicate')"
        more = "(fault = 'truncated')::INT"
        ways.append(f"CASE WHEN {can} AND initial = '{role}' THEN {{'c': p{i}.c + {more}, 'a': p{i}.a || 'K', 't': p{i}.t || {_KEEP}}} END")
        if name:
            ways.append(f"CASE WHEN {can} THEN {{'c': p{i}.c + 2 + {more}, 'a': p{i}.a || 'R', 't': p{i}.t || '{name}' || {_RE}}} END")
    return f"least({', '.join(ways)}) AS p{j}"


# CRC-32 by its table of 256 values, which the rule of its polynomial gives.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"""


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, beside a column crc_table."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)"
    return f"""xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


_NOTHING = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
CONVERSATIONS_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, (crc % 20) AS k FROM (SELECT *, {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} AS crc FROM conversations, crc)) WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS seen,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM damaged)),
faults AS (SELECT *, left(role, 1) AS initial, CASE WHEN trimmed = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM numbered),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, max(r) AS n,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS r, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS p0, {_NOTHING} AS p1, {_NOTHING} AS p2, {_NOTHING} AS p3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, r, {_taken(0, "s", [])}, {_taken(1, "s", [0])}, {_taken(2, "u", [0, 1, 3])}, {_taken(3, "a", [2])}
  FROM (SELECT f.conv_id, f.r, f.role, f.text, f.initial, f.fault, {_INSERTED}
        FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.r = w.r + 1)),
ends AS (SELECT conv_id, r, least(p0, p3) AS p FROM (SELECT conv_id, r, {_INSERTED} FROM walk))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, p.c AS cost, p.a AS audit,
  sha256(left(p.t, length(p.t) - 1)) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.r = coalesce(s.n, 0)
"""


@query("op11_conversation_repair", sql=CONVERSATIONS_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(whole), ids=whole)
