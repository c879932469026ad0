"""DuckDB SQL for the operators whose results SQL can express; written from the contracts, not from the operators."""

from __future__ import annotations

from .linededup import MIN_WORDS, NEAR_WORDS
from .ngramjoin import N_WORDS, THRESHOLD_PERCENT
from .suffixdedup import LENGTH, REPORT_LENGTH

_LINES = r"""ln AS (SELECT doc_id, i AS line, trim(regexp_replace(lower(x), '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS norm FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
l AS (SELECT norm, struct_pack(i := doc_id, l := line) AS place, len(string_split(norm, ' ')) AS n FROM ln WHERE norm <> '' AND len(string_split(norm, ' ')) >= {min_words}),
f AS (SELECT norm, n, min(place) AS place FROM l GROUP BY norm, n)"""

#: Lines that an earlier one equals; then first lines by leaving out each word in turn.
OP3 = (
    "WITH "
    + _LINES.format(min_words=MIN_WORDS)
    + f""",
u AS (SELECT norm, n, place, string_split(norm, ' ') AS w FROM f WHERE n >= {NEAR_WORDS}),
v AS (SELECT norm, n, place, k, array_to_string(w[1:k-1] || w[k+1:], ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM u)),
p AS (SELECT a.place AS x, b.place AS y FROM v a JOIN v b ON a.rest = b.rest AND a.n = b.n AND a.k = b.k WHERE b.place < a.place
  UNION SELECT u.place, v.place FROM u JOIN v ON v.rest = u.norm AND v.n = u.n + 1 WHERE v.place < u.place
  UNION SELECT v.place, u.place FROM u JOIN v ON v.rest = u.norm AND v.n = u.n + 1 WHERE u.place < v.place),
r AS (SELECT l.place, 'exact' AS kind, f.place AS kept FROM l JOIN f ON f.norm = l.norm WHERE l.place <> f.place
  UNION SELECT x, 'near', min(y) FROM p GROUP BY x)
SELECT place.i AS doc_id, CAST(place.l AS INTEGER) AS line, kind, kept.i AS kept_id, CAST(kept.l AS INTEGER) AS kept_line FROM r"""
)

#: Base 32 of a digest: each of 32 letters covers five bits, which lie in two hexadecimal digits.
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((strpos('0123456789abcdef', substr(s, CAST(i * 5 // 4 AS INTEGER) + 1, 1)) - 1) * 16 "
    "+ (strpos('0123456789abcdef', substr(s, CAST(i * 5 // 4 AS INTEGER) + 2, 1)) - 1)) // CAST(pow(2, 3 - i * 5 % 4) AS INTEGER) % 32 AS INTEGER) + 1, 1)), '')"
)
OP5 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS s FROM pages), f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f ON f.t = p.t"""

_GRAM = " || ' ' || ".join(f"w[i+{k}]" if k else "w[i]" for k in range(N_WORDS))
OP8 = (
    r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),"""
    + f"""
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {N_WORDS} THEN array_to_string(w, ' ') ELSE {_GRAM} END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N_WORDS - 1}, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
ov AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT x, y FROM ov JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= {THRESHOLD_PERCENT} * (p.n + q.n - o)),
lks AS (SELECT x, y FROM ln UNION SELECT y, x FROM ln),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reach JOIN lks ON x = b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id"""
)


def _covered(name: str, length: int) -> str:
    """CTEs for the spans that repeated strings of a length cover: name as (doc_id, a, b) in bytes."""
    return (
        f"{name}_w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * length})) AS m FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS i FROM d WHERE n >= {length})), "
        f"{name}_m AS (SELECT m FROM {name}_w GROUP BY m HAVING count(*) > 1), "
        f"{name}_r AS (SELECT doc_id, i FROM {name}_w JOIN {name}_m USING (m)), "
        f"{name}_g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh FROM {name}_r), "
        f"{name} AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM {name}_g) GROUP BY doc_id, k)"
    )


OP9 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents), {_covered("sp", LENGTH)}, {_covered("rp", REPORT_LENGTH)},
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id), e AS (SELECT doc_id, sum(b - a) AS repeated FROM rp GROUP BY doc_id),
q AS (SELECT doc_id, b AS x, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), n) AS y FROM sp JOIN d USING (doc_id) UNION ALL SELECT d.doc_id, 0, coalesce(min(a), any_value(n)) FROM d LEFT JOIN sp ON sp.doc_id = d.doc_id GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256, CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id JOIN k ON k.doc_id = d.doc_id"""
