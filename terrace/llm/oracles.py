"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .url_filter import HOST_RULES, PATTERN_RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH n AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


def _op9() -> str:
    rules = sorted(HOST_RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v, f"{h}{p}") for v, h, p in rules]
    patterns = " ".join(f"WHEN regexp_matches(lower(url), '{p}') THEN '{v}'" for v, _, p in PATTERN_RULES)
    return f"""
WITH h AS (
  SELECT page_id, url,
         {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, _, r in fits)} END AS rule,
       coalesce(CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, v, _ in fits)} END,
                CASE {patterns} END, 'allow') AS verdict
FROM h
"""


def _op11() -> str:
    """States are strings of ten digits (the cost) and the edits so far, so that the least string is the cheapest and, of those, the first in ASCII."""

    def edit(state: str, cost: str, initial: str) -> str:
        return f"lpad(CAST(CAST(left({state}, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({state}, 11) || '{initial}'"

    def of(condition: str, *states: str) -> str:
        return ", ".join(f"CASE WHEN {condition} THEN {s} END" for s in states)

    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    before_user, more = ("s0", "s1", "a"), "CASE WHEN truncated THEN 3 ELSE 0 END"
    keep_user, keep_assistant = [edit(s, more, "K") for s in before_user], edit("u", more, "K")
    cast_user, cast_assistant = [edit(s, f"3 + {more}", "R") for s in before_user], edit("u", f"3 + {more}", "R")
    stays = "NOT blank AND NOT duplicate"
    return f"""
WITH RECURSIVE ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
named AS (
  SELECT i.k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations c JOIN ids i ON c.conv_id IS NOT DISTINCT FROM i.conv_id),
hashed AS (
  SELECT k, turn, role, text,
         xor(list_reduce([4294967295]::BIGINT[] || flatten(list_transform(range(1, length(name) + 1), lambda i: list_transform(range(8), lambda b: CAST((ascii(substr(name, i, 1)) >> b) & 1 AS BIGINT)))),
                         lambda crc, bit: CASE WHEN (xor(crc, bit) & 1) = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 20 AS kind
  FROM named),
damaged AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0),
digested AS (SELECT *, sha256(length(role) || ':' || role || text) AS digest, rtrim(text, {blanks}) AS body FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, digest, copy) AS n FROM digested),
judged AS (
  SELECT k, n, turn, role, text, left(role, 1) AS initial, body = '' AS blank,
         body <> '' AND row_number() OVER (PARTITION BY k, digest ORDER BY n) > 1 AS duplicate,
         right(body, 1) NOT IN ('.', '!', '?') AS truncated, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY n) AS before
  FROM numbered),
counts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (NOT blank AND NOT duplicate AND truncated) AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM judged GROUP BY k),
dp AS (
  SELECT k, 0::BIGINT AS n, '0000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM ids
  UNION ALL
  SELECT k, n, {edit("s0", "4", "D")},
         least({edit("s1", "4", "D")}, {of(f"{stays} AND initial = 's'", edit("s0", more, "K"))}),
         least({edit("s2", "4", "D")}, {of(f"{stays} AND initial = 'u'", *keep_user)}, {of(stays, *cast_user)}),
         least({edit("s3", "4", "D")}, {of(f"{stays} AND initial = 'a'", keep_assistant)}, {of(stays, cast_assistant)})
  FROM (SELECT *, least(s3, {edit("u", "3", "I")}) AS a
        FROM (SELECT j.*, s0, s1, s2, s3, least(s2, {edit("s0", "3", "I")}, {edit("s1", "3", "I")}, {edit("s3", "3", "I")}) AS u
              FROM dp JOIN judged j ON j.k = dp.k AND j.n = dp.n + 1))),
ended AS (
  SELECT dp.k, least(s0, s3, {edit("s2", "3", "I")}, {edit("s1", "6", "I")} || 'I') AS best
  FROM dp JOIN counts c ON c.k = dp.k AND c.rows = dp.n),
edits AS (SELECT k, unnest(range(1, length(best) - 9)) AS i, substr(best, 10 + i, 1) AS edit, length(replace(substr(best, 11), 'D', '')) % 2 AS odd FROM ended),
placed AS (
  SELECT k, i, edit, odd, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS place FROM edits WINDOW w AS (PARTITION BY k ORDER BY i)),
repaired AS (
  SELECT p.k, string_agg(CASE WHEN edit = 'K' THEN j.role WHEN (place - 1 - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE j.text END, chr(10) ORDER BY i) AS body
  FROM placed p LEFT JOIN judged j ON j.k = p.k AND j.n = p.n AND p.edit <> 'I' WHERE edit <> 'D' GROUP BY p.k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(CAST(left(best, 10) AS BIGINT), 0) AS cost, coalesce(substr(best, 11), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (k) LEFT JOIN ended USING (k) LEFT JOIN repaired USING (k)
"""


ORACLES = {"op1_exact_dedup": OP1, "op9_url_filter": _op9(), "op11_conversation_repair": _op11()}
