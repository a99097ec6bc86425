"""DuckDB SQL for those corpus queries that SQL can express."""

from tessera.llm.licenses import COPYRIGHT_LINE, LICENSES, NOT_WORD, NOTICES, SPELLINGS

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('4:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 16384)::INT AS bucket
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM w),
k AS (SELECT *, cap / weight AS ratio, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM c),
held AS (SELECT 0 AS i, 0::DOUBLE AS held, (SELECT sum(weight) FROM k) AS free
         UNION ALL
         SELECT i, sum(cap) OVER (ORDER BY i), (SELECT sum(weight) FROM k) - sum(weight) OVER (ORDER BY i) FROM k),
lv AS (SELECT h.i, (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - h.held) / nullif(h.free, 0) AS level, n.ratio AS next_ratio
       FROM held h LEFT JOIN k n ON n.i = h.i + 1),
level AS (SELECT coalesce((SELECT level FROM lv WHERE level < next_ratio ORDER BY i LIMIT 1), 'inf'::DOUBLE) AS level),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM c, level),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM g),
b AS (SELECT source, bucket, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS got FROM d GROUP BY source, bucket
      UNION ALL SELECT source, -1, 0 FROM s),
cut AS (SELECT source, bucket AS cut FROM (
          SELECT b.source, b.bucket, row_number() OVER (PARTITION BY b.source ORDER BY abs(rest - got), b.bucket) AS n
          FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source) WHERE n = 1)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (r.whole + CASE WHEN d.bucket <= cut.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

OP8 = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """DuckDB's array of a text's canonical lines."""
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    for a, b in SPELLINGS:
        out = f"regexp_replace({out}, {_quoted(a)}, {_quoted(b)}, 'g')"
    out = f"regexp_replace({out}, {_quoted(NOT_WORD)}, ' ', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _known(texts: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(texts))
    return f"SELECT digest, arg_min(license, i) AS license FROM (SELECT i, license, md5(array_to_string({_canonical('t')}, ' ')) AS digest FROM (VALUES {rows}) v(i, license, t)) GROUP BY digest"


OP6 = f"""
WITH l AS ({_known(LICENSES)}), n AS ({_known(NOTICES)}),
d AS (SELECT doc_id, {_canonical('text')} AS lines FROM documents),
w AS (SELECT doc_id, lines, md5(array_to_string(lines, ' ')) AS text_digest FROM d),
u AS (SELECT doc_id, unnest(lines) AS line FROM d),
m AS (SELECT u.doc_id, string_agg(DISTINCT n.license, ',' ORDER BY n.license) AS notices
      FROM u JOIN n ON n.digest = md5(u.line) GROUP BY u.doc_id)
SELECT w.doc_id, w.text_digest, l.license, coalesce(m.notices, '') AS notices
FROM w LEFT JOIN l ON l.digest = w.text_digest AND w.text_digest <> md5('') LEFT JOIN m ON m.doc_id = w.doc_id
"""

ORACLES = {"op4_mixing": OP4, "op6_licenses": OP6, "op8_url_filter": OP8}
