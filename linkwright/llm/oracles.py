"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import GOES_ON, KNOWN, PHRASES, SPELLINGS, STATES


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced(x: str, pairs: tuple) -> str:
    for a, b in pairs:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return x


def _folded(x: str) -> str:
    return "trim(" + _replaced(f"' ' || regexp_replace({_replaced(f'lower({x})', SPELLINGS)}, '[^\\pL\\pN]+', ' ', 'g') || ' '", PHRASES) + ")"


OP3 = rf"""
WITH known(license, text) AS (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}),
texts AS (
  SELECT 1 AS kind, row_number() OVER () AS id, license, text FROM known UNION ALL SELECT 2, doc_id, NULL, text FROM documents
), lines AS (
  SELECT kind, id, license, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM texts
), stays AS (
  SELECT kind, id, license, pos, line FROM lines WHERE NOT (regexp_matches(lower(line), {_quoted(STATES)}) AND NOT regexp_matches(lower(line), {_quoted(GOES_ON)}))
), canon AS (
  SELECT kind, id, license, pos, {_folded("line")} AS c FROM stays
), joined AS (
  SELECT kind, id, license, string_agg(line, ' ' ORDER BY pos) AS text FROM stays GROUP BY kind, id, license
), forms AS (
  SELECT t.kind, t.id, t.license, {_folded("j.text")} AS form FROM texts t LEFT JOIN joined j ON t.kind = j.kind AND t.id = j.id
), whole AS (
  SELECT kind, id, license, CASE WHEN form <> '' THEN md5(form) END AS digest FROM forms
), digests AS (
  SELECT digest, min(license) AS license FROM whole WHERE kind = 1 AND digest IS NOT NULL GROUP BY digest
), found AS (
  SELECT id, list_sort(list(DISTINCT d.license)) AS line_licenses FROM canon JOIN digests d ON md5(c) = d.digest WHERE kind = 2 AND c <> '' GROUP BY id
)
SELECT w.id AS doc_id, w.digest, d.license, coalesce(f.line_licenses, []) AS line_licenses
FROM whole w LEFT JOIN digests d USING (digest) LEFT JOIN found f ON w.id = f.id WHERE w.kind = 2
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS lim,
         ((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s
), v AS (
  SELECT a.source, a.source_size, a.lim, a.weight,
         ((SELECT sum(source_size) FROM w) - coalesce(sum(b.lim), 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(b.weight), 0)) AS level
  FROM w a LEFT JOIN w b ON b.lim / b.weight < a.lim / a.weight OR (b.lim / b.weight = a.lim / a.weight AND coalesce(b.source, chr(1114111)) < coalesce(a.source, chr(1114111)))
  GROUP BY a.source, a.source_size, a.lim, a.weight
), f AS (
  SELECT coalesce(min_by(level, lim / weight) FILTER (level <= lim / weight), 0) AS final FROM v
), t AS (
  SELECT source, source_size, least(lim, final * weight) AS target,
         CASE WHEN source_size > 0 THEN least(lim, final * weight) / source_size ELSE 0 END AS rate FROM v, f
)
SELECT doc_id, size, source_size, target,
       size * (floor(rate) + (('0x' || substr(md5('42/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate))::INT)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

OP10 = r"""
WITH a AS (
  SELECT DISTINCT doc_id, text FROM documents
), d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM a
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), s AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM i WHERE len(w) >= 1)
), n AS (
  SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id
), k AS (
  SELECT DISTINCT k FROM s
), t AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)
)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM t JOIN s USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": OP3,
    "op8_mix_sources": OP8,
    "op10_decontaminate": OP10,
}
