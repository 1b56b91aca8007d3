"""DuckDB SQL for the numbered operators that SQL can express."""

from __future__ import annotations

from plantwise.llm.queries import MIX_ALPHA, MIX_SEED

SQL: dict[str, str] = {}


def hash_number(seed: int, *parts: str) -> str:
    joined = " || '|' || ".join([f"'{seed}'", *(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)])
    return f"CAST('0x' || substr(md5({joined}), 1, 13) AS BIGINT)"


SQL["op3_poisson_mixture"] = f"""
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
weighted AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {MIX_ALPHA}) ELSE 0 END AS weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN weight > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(size) FROM weighted) / size
                      ELSE 0 END AS rate FROM weighted),
terms AS (
  SELECT source, rate, k, CASE WHEN k > min(k) OVER (PARTITION BY source) THEN ln(rate / k) ELSE 0 END AS ratio
  FROM (SELECT source, rate, unnest(range(CAST(greatest(floor(rate - 12 * sqrt(rate) - 40), 0) AS BIGINT),
                                          CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rates WHERE rate > 0)),
logs AS (SELECT source, k, sum(ratio) OVER (PARTITION BY source ORDER BY k) AS l FROM terms),
probs AS (SELECT source, k, exp(l - max(l) OVER (PARTITION BY source)) AS p FROM logs),
sums AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM probs),
cdf AS (SELECT source, k, s / max(s) OVER (PARTITION BY source) AS c FROM sums),
drawn AS (
  SELECT d.doc_id, min(c.k) FILTER (WHERE d.u < c.c) AS n
  FROM (SELECT doc_id, source, ({hash_number(MIX_SEED, "doc_id")} + 0.5) / pow(16.0, 13) AS u FROM documents) d
  JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source GROUP BY d.doc_id),
copies AS (SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM drawn)
SELECT d.*, copy, {hash_number(MIX_SEED + 1, "doc_id", "copy")} AS shuffle_key FROM copies JOIN documents d USING (doc_id)
"""


# The kinds as their description states them, not as the operator writes them: name, pattern, group
# that is measured, least length.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge_token", "gh(?:o|p|s|u|r)_[[:alnum:]]{36,}", 0, 40),
    ("signed_token", r"eyJ[\w-]{8,}[.]eyJ[\w-]{8,}[.][\w-]{8,}", 0, 1),
]


def scan_sql() -> str:
    """Every kind's matches with their positions, from the pieces between them."""
    parts = []
    for no, (name, found, group, least) in enumerate(KINDS, 1):
        pattern = "'" + found.replace("'", "''") + "'"
        parts.append(f"""
SELECT doc_id, {no} AS no, '{name}' AS kind, unnest(range(len(hits))) AS i,
       unnest([length(x) FOR x IN gaps[:len(hits)]]) AS gap, unnest([length(x) FOR x IN hits]) AS size,
       unnest([length(x) >= {least} FOR x IN parts]) AS ok
FROM (SELECT doc_id, string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}, 0) AS hits,
             regexp_extract_all(text, {pattern}, {group}) AS parts FROM documents)""")
    return f"""
WITH pieces AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, no ORDER BY i) AS stop FROM pieces),
spans AS (SELECT doc_id, no, kind, CAST(stop - size AS BIGINT) AS start,
                 kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE ok),
grouped AS (
  SELECT doc_id, count(*) FILTER (WHERE no = 1) AS n_assign, count(*) FILTER (WHERE no = 2) AS n_access,
         count(*) FILTER (WHERE no = 3) AS n_hex,
         string_agg(span, ',' ORDER BY start, no) FILTER (WHERE no <= 3) AS base, string_agg(span, ',' ORDER BY start, no) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN grouped g ON g.doc_id = d.doc_id"""


SQL["op1_secret_scan"] = scan_sql()

SQL["op4_mtree_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""

SQL["op5_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, unnest(range(n - 99)) AS p, h FROM d WHERE n >= 100),
repeated AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY md5_number(substr(h, CAST(2 * p + 1 AS BIGINT), 200)) ORDER BY doc_id, p) AS no FROM strings)
  WHERE no > 1),
runs AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM repeated),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM runs),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
cut AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a)
           || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id"""


# CRC-32 of decimal digits, bit by bit: a byte is xored in, then eight shifts
CRC = """xor(list_reduce(flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295), 4294967295)"""


def leaf_sql(n_chars: str) -> str:
    parts = (f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END"
             for v in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(parts)})"


def tree_sql(name: str, leaves: str) -> str:
    """All levels (tree, level, idx, h) over ``leaves`` (tree, idx, h)."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, idx, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(h || coalesce(next, '')) FROM (
    SELECT tree, level, idx, h, lead(h) OVER (PARTITION BY tree ORDER BY idx) AS next, count(*) OVER (PARTITION BY tree) AS n FROM {name})
  WHERE n > 1 AND idx % 2 = 0)"""


def climb_sql(name: str, start: str, tree: str) -> str:
    """From ``start`` (id, tree, idx, folded, proof) up to the tops of ``tree``."""
    return f"""
{name} AS (
  SELECT id, tree, 0 AS level, idx, folded, proof FROM {start}
  UNION ALL
  SELECT c.id, c.tree, c.level + 1, c.idx // 2,
         sha256(CASE WHEN s.h IS NULL THEN c.folded WHEN c.idx % 2 = 1 THEN s.h || c.folded ELSE c.folded || s.h END),
         c.proof || coalesce(s.h, '')
  FROM {name} c JOIN (SELECT tree, max(level) AS height FROM {tree} GROUP BY tree) t ON t.tree = c.tree AND c.level < t.height
  LEFT JOIN {tree} s ON s.tree = c.tree AND s.level = c.level AND s.idx = xor(c.idx, 1))"""


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf_sql("n_chars")} AS leaf,
         CASE WHEN {CRC} % 7 = 0 THEN {leaf_sql("(n_chars + 1)")} ELSE {leaf_sql("n_chars")} END AS claimed FROM documents),
leaves AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id FROM hashed),
{tree_sql("levels", "leaves")},
subroots AS (SELECT tree AS name, '^' AS tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx
             FROM (SELECT tree, arg_max(h, level) AS h FROM levels GROUP BY tree)),
{tree_sql("tops", "subroots")},
root AS (SELECT arg_max(h, level) AS root FROM tops),
bottom AS (SELECT id, tree, idx, claimed AS folded, '' AS proof FROM leaves),
{climb_sql("climbed", "bottom", "levels")},
at_subroot AS (
  SELECT id, '^' AS tree, s.idx, s.h AS subroot, folded, proof FROM
  (SELECT id, arg_max(tree, level) AS name, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM climbed GROUP BY id)
  JOIN subroots s USING (name)),
{climb_sql("arrived", "at_subroot", "tops")},
done AS (SELECT id, arg_max(folded, level) AS folded_root, arg_max(proof, level) AS proof FROM arrived GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(done.proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN at_subroot USING (id) JOIN done USING (id) CROSS JOIN root"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
