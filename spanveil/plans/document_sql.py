"""DuckDB SQL for the queries over the text corpus, built from common table expressions."""

from __future__ import annotations

from spanveil.functions import fixed_values as fixed
from spanveil.operators.dictionaries import NameLists
from spanveil.plans.sentences import luhn_sql

SPACES = r"\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
EMAIL_RE = r"(\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b)"
IPV4_RE = r"(\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b)"
CARD_RE = "(" + fixed.FORMATS["credit_card"] + ")"
PHONE_RE = (
    rf"(\+[1-9]\d{{0,3}}[{SPACES}.\-]?\(?\d{{1,4}}\)?[{SPACES}.\-]?\d{{1,4}}[{SPACES}.\-]?\d{{1,9}})"
    rf"(?:[{SPACES},;:!?)}}\]\x22\x27]|$)"
)
PHONE_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
CORE = [
    ("credit_card", "CREDIT_CARD", CARD_RE, luhn_sql("value")),
    ("ipv4", "IP_ADDRESS", IPV4_RE, "NOT starts_with(value, '0.')"),
    ("email", "EMAIL", EMAIL_RE, "true"),
    ("phone_intl", "PHONE_NUMBER", PHONE_RE, f"length({PHONE_DIGITS}) BETWEEN 7 AND 15 AND NOT contains(value, chr(10))"),
]
CORE_IDS = [c[0] for c in CORE]


def hits(table: str, key: str, regex: str, text: str = "text") -> str:
    """SELECT key, start, value of every match (group 1) of ``regex``."""
    return (
        f"SELECT {key}, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) "
        f"+ coalesce(list_sum(list_transform(whole[1:i-1], lambda w: length(w))), 0) AS BIGINT) AS start, vals[i] AS value "
        f"FROM (SELECT {key}, regexp_extract_all({text}, '{regex}') AS whole, regexp_extract_all({text}, '{regex}', 1) AS vals, "
        f"string_split_regex({text}, '{regex}') AS gaps FROM {table}) x CROSS JOIN UNNEST(range(1, len(whole) + 1)) AS t(i)"
    )


def core_hits(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``h``: accepted hits of the core detectors."""
    parts = [
        f"SELECT {key}, '{det}' AS detector, '{kind}' AS placeholder, start, value FROM ({hits(table, key, regex, text)}) WHERE {rule}"
        for det, kind, regex, rule in CORE
    ]
    return "h AS (" + " UNION ALL ".join(parts) + ")"


NORM = (
    "CASE WHEN placeholder IN ('PERSON_NAME', 'EMAIL') THEN lower(trim(value)) "
    "ELSE lower(regexp_replace(value, '[\\s\\-]+', '', 'g')) END"
)


def tagged(scope: str, order: str = "start", always_numbered: bool = False) -> str:
    """CTEs over ``h`` giving ``tags``: hits with first position, number and tag within the scope."""
    by = f"{scope}, placeholder" if scope else "placeholder"
    return (
        f"hn AS (SELECT *, {NORM} AS norm FROM h), "
        f"hf AS (SELECT *, min({order}) OVER (PARTITION BY {by}, norm) AS first FROM hn), "
        f"hr AS (SELECT *, dense_rank() OVER (PARTITION BY {by} ORDER BY first) AS n FROM hf), "
        f"hm AS (SELECT *, max(n) OVER (PARTITION BY {by}) AS most FROM hr), "
        f"tags AS (SELECT *, CASE WHEN most = 1 AND {not always_numbered} THEN '[' || placeholder || ']' "
        "ELSE '[' || placeholder || '_' || n || ']' END AS tag FROM hm)"
    )


def rendered(key: str = "doc_id", table: str = "documents") -> str:
    """CTE ``red`` over ``tags``: key, anonymized, count."""
    return (
        f"pieces AS (SELECT {key}, start, tag, start + length(value) AS stop, "
        f"coalesce(lag(start + length(value)) OVER (PARTITION BY {key} ORDER BY start), 0) AS prev FROM tags), "
        f"glued AS (SELECT p.{key}, string_agg(substr(d.text, p.prev + 1, p.start - p.prev) || p.tag, '' ORDER BY p.start) AS head, "
        f"max(p.stop) AS stop, count(*) AS n FROM pieces p JOIN {table} d USING ({key}) GROUP BY p.{key}), "
        f"red AS (SELECT d.{key}, CASE WHEN g.head IS NULL THEN CASE WHEN regexp_matches(d.text, '[^{SPACES}]') THEN d.text ELSE '' END "
        f"ELSE g.head || substr(d.text, g.stop + 1) END AS anonymized, CAST(coalesce(g.n, 0) AS BIGINT) AS n "
        f"FROM {table} d LEFT JOIN glued g USING ({key}))"
    )


ENTITIES = (
    "ents AS (SELECT doc_id, placeholder AS type, tag, arg_max(value, start) AS value, min(start) AS first "
    "FROM tags GROUP BY doc_id, placeholder, tag)"
)
MASK = (
    "CASE WHEN type = 'PERSON_NAME' THEN substr(value, 1, 1) || repeat('*', CAST(length(value) - 1 AS BIGINT)) "
    "WHEN type = 'EMAIL' THEN substr(value, 1, 1) || '***@' || split_part(value, '@', 2) "
    "WHEN type = 'PHONE_NUMBER' THEN substr(value, 1, 4) || '***' || right(value, 2) "
    "WHEN type IN ('SSN', 'CREDIT_CARD', 'BANK_ACCOUNT', 'ROUTING_NUMBER') "
    "THEN '***' || right(regexp_replace(value, '[^0-9]', '', 'g'), 4) "
    "WHEN length(value) <= 4 THEN '****' "
    "ELSE substr(value, 1, 2) || repeat('*', CAST(length(value) - 4 AS BIGINT)) || right(value, 2) END"
)
def word_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def names_sql(lists, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Known names in a table's texts: every word, looked up and tested against its surroundings."""
    leads = "|".join(fixed.NAME_LEADS).replace(r"\s", rf"[{SPACES}]")
    keys = "|".join(fixed.NAME_KEYS)
    lead_re = f'(?i)(?:(?:{leads})[{SPACES}]*[:,]?[{SPACES}]*$|"(?:{keys})"[{SPACES}]*:[{SPACES}]*"$)'
    word_re = r"\b([a-zA-Z]{2,})\b"
    return f"""
WITH cut AS (
  SELECT {key}, regexp_extract_all({text}, '{word_re}') AS words, string_split_regex({text}, '{word_re}') AS gaps FROM {table}
), w AS (
  SELECT {key}, i, words[i] AS value, length(gaps[i]) AS gap FROM cut CROSS JOIN UNNEST(range(1, len(words) + 1)) AS t(i)
), placed AS (
  SELECT {key}, value,
         CAST(sum(gap + length(value)) OVER (PARTITION BY {key} ORDER BY i) - length(value) AS BIGINT) AS start FROM w
), cand AS (
  SELECT p.*, lower(p.value) AS lo, substr(d.{text}, start + length(p.value) + 1, 10) AS after,
         substr(d.{text}, greatest(start - 60, 0) + 1, least(start, 60)) AS before,
         substr(d.{text}, greatest(start - 30, 0) + 1, least(start, 30)) AS near
  FROM placed p JOIN {table} d USING ({key})
  WHERE lower(p.value) NOT IN {word_list(lists.suppress)}
    AND (lower(p.value) IN {word_list(lists.first | lists.last)} OR lower(p.value) IN {word_list(lists.ambiguous)})
)
SELECT {key}, start, value FROM cand
WHERE NOT regexp_matches(after, '^,[{SPACES}]*[A-Z]{{2}}\\b')
  AND (lo NOT IN {word_list(lists.ambiguous)}
       OR regexp_matches(before, '{lead_re}')
       OR lower(regexp_extract(near, '\\b([A-Z][a-z]+)[{SPACES}]+$', 1)) IN {word_list(lists.first)})
"""


IBAN_RE = "(" + fixed.FORMATS["iban"] + ")"


def raw_hits(lists, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``raw``: every accepted hit of the detectors that the corpus has anything for."""
    order = [d[0] for d in fixed.CATALOGUE]
    core = " UNION ALL ".join(
        f"SELECT {key}, {order.index(det)} AS seq, '{det}' AS detector, '{kind}' AS placeholder, start, value "
        f"FROM ({hits(table, key, regex, text)}) WHERE {rule}"
        for det, kind, regex, rule in [*CORE, ("iban", "BANK_ACCOUNT", IBAN_RE, "true")]
    )
    return (
        f"raw AS ({core} UNION ALL SELECT {key}, {order.index('name_dictionary')} AS seq, 'name_dictionary' AS detector, "
        f"'PERSON_NAME' AS placeholder, start, value FROM ({names_sql(lists, table, key, text)}))"
    )


def resolved_hits(lists, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTE ``h``: the hits of ``raw_hits`` after the overlaps are settled one by one (earlier start, then specific types,
    then shorter, then detector order)."""
    return (
        f"{raw_hits(lists, table, key, text)}, "
        f"o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start, length(value) - "
        f"CASE WHEN placeholder IN {word_list(fixed.SPECIFIC_TYPES)} THEN 1000 ELSE 0 END, length(value), seq) AS i FROM raw), "
        f"walk AS (SELECT {key}, i, detector, placeholder, start, value, start + length(value) AS reach, true AS taken FROM o WHERE i = 1 UNION ALL "
        f"SELECT o.{key}, o.i, o.detector, o.placeholder, o.start, o.value, "
        "CASE WHEN o.start >= w.reach THEN o.start + length(o.value) ELSE w.reach END, "
        f"o.start >= w.reach FROM walk w JOIN o ON o.{key} = w.{key} AND o.i = w.i + 1), "
        f"h AS (SELECT {key}, detector, placeholder, start, value FROM walk WHERE taken)"
    )


DOC_TAGS = f"WITH RECURSIVE {resolved_hits(NameLists())}, {tagged('doc_id')}"
#: Texts that come back from redaction as they were: not blank, and no tag stands for two spellings.
ROUND_TRIP = (
    f"{DOC_TAGS}, lossy AS (SELECT doc_id FROM tags GROUP BY doc_id, tag HAVING count(DISTINCT value) > 1) "
    f"SELECT doc_id, coalesce(regexp_matches(text, '[^{SPACES}]') OR text = '', false) AND doc_id NOT IN (SELECT doc_id FROM lossy) AS ok FROM documents"
)
