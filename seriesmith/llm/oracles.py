"""SQL, in DuckDB's dialect, for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import secrets

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3])))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::varchar[] END AS g FROM w),
p AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT l.y, r.m FROM reach r JOIN links l ON r.doc_id = l.x)
SELECT s.doc_id, len(g)::bigint AS n_shingles, (SELECT min(m) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id, (SELECT count(*) FROM links l WHERE l.x = s.doc_id) AS n_links FROM s
"""


def url_filter(rules: list[tuple[str, str]], made: int, below: str) -> str:
    fits = lambda rule: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{2}'))".format(*rule.partition("/"))
    cases = sorted(rules, key=lambda x: (-len(x[1]), x[1]))
    key = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    on_list = " OR ".join(f"(md5({key(k)}) < '{below}' AND {key(k)} LIKE '%.%.%') OR coalesce(try_cast(regexp_extract({key(k)}, '^site-(0|[1-9][0-9]*)\\.example\\.net$', 1) AS bigint) < {made}, false)" for k in (1, 2, 3))
    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in cases)
    verdict = " ".join(f"WHEN {fits(t)} THEN '{what}'" for what, t in cases)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {on_list} THEN 'block' ELSE 'allow' END AS verdict FROM h
"""


def _matches(pattern: str, kind: int, group: int, ok: str) -> str:
    p = pattern.replace("'", "''")
    sums = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
    return f"""SELECT doc_id, {kind} AS kind, start, start + length(m) AS stop, v FROM (
  SELECT doc_id, ms[k] AS m, vs[k] AS v, ({sums('gs[1:k]')} + {sums('ms[1:k - 1]')})::bigint AS start FROM (
    SELECT doc_id, ms, vs, gs, unnest(range(1, len(ms) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, regexp_split_to_array(t, '{p}') AS gs FROM t WHERE regexp_matches(t, '{p}')))) WHERE {ok}"""


SECRETS = f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
base AS ({_matches(secrets.ASSIGN, 0, 1, 'length(v) >= 6')} UNION ALL {_matches(secrets.ACCESS, 1, 0, 'true')} UNION ALL {_matches(secrets.HEX, 2, 0, 'true')}),
mixed AS ({_matches(secrets.MIXED, 3, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")}),
apart AS (SELECT * FROM mixed m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.start < m.stop AND m.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM apart),
held AS (SELECT v, count(DISTINCT coalesce(source, '')) >= {secrets.WIDE} OR count(DISTINCT (coalesce(source, ''), coalesce(lang, ''))) >= {secrets.MANY} AS copied FROM every JOIN t USING (doc_id) GROUP BY v),
j AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS span FROM every JOIN held USING (v)),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR NOT copied), '') AS spans,
  count(*) FILTER (kind < 3 AND NOT copied) AS n_live, count(*) FILTER (kind < 3 AND copied) AS n_copied, count(*) FILTER (kind = 3 AND NOT copied) AS n_owned FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_owned, 0) AS n_owned FROM t LEFT JOIN a USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
