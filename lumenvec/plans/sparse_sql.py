"""The sparse plans in SQL: what the operators are held against, one text per pattern."""

from __future__ import annotations

from ..operators.sparse import BLOCK, GATE, MASS, MAX_TOKENS, PREFIX, RECENT, TOP_BLOCKS, TOP_K, VERTICAL

#: Softmax mass, rank by score and length of each trace.
BASE = """
m AS (SELECT trace, max(score) AS top, count(*) AS n FROM scored GROUP BY trace),
e AS (SELECT s.trace, s.pos, s.score, m.n, exp(s.score - m.top) AS e FROM scored s JOIN m ON m.trace = s.trace),
w AS (SELECT trace, pos, score, n, e, e / sum(e) OVER (PARTITION BY trace) AS p,
      row_number() OVER (PARTITION BY trace ORDER BY score DESC, pos) - 1 AS r FROM e)"""
_ENDS = f"(pos < {PREFIX} OR pos >= n - {RECENT})"


def _blocks(where: str) -> str:
    return (
        f"SELECT trace, blk FROM (SELECT trace, blk, row_number() OVER (PARTITION BY trace ORDER BY mass DESC, blk) AS o "
        f"FROM (SELECT trace, CAST(floor(pos / {BLOCK}.0) AS BIGINT) AS blk, round(sum(e), 9) AS mass FROM w WHERE {where} GROUP BY trace, CAST(floor(pos / {BLOCK}.0) AS BIGINT)) b) o WHERE o <= {TOP_BLOCKS}"
    )


_IN_BLOCK = f"JOIN ({{}}) k ON k.trace = w.trace AND k.blk = CAST(floor(w.pos / {BLOCK}.0) AS BIGINT)"
_ADAPTIVE = (
    "SELECT trace, pos, score FROM (SELECT trace, pos, score, r, coalesce(sum(p) OVER (PARTITION BY trace ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w) a "
    f"WHERE r < {MAX_TOKENS} AND (r < {TOP_K} OR round(before, 9) < {MASS})"
)
PATTERNS = {
    "ashape": f"SELECT trace, pos, score FROM w WHERE {_ENDS}",
    "vertical": f"SELECT trace, pos, score FROM w WHERE r < {VERTICAL} OR pos >= n - {RECENT}",
    "block": "SELECT w.trace, pos, score FROM w " + _IN_BLOCK.format(_blocks("true")),
    "hybrid": f"SELECT trace, pos, score FROM w WHERE {_ENDS} OR r < {VERTICAL} UNION SELECT w.trace, pos, score FROM w "
    + _IN_BLOCK.format(_blocks(f"NOT ({_ENDS} OR r < {VERTICAL})")),
    "adaptive": _ADAPTIVE,
}


def chosen(pattern: str, name: str = "sel") -> str:
    """The selected positions, capped to the best scores."""
    return (
        f"{name} AS (SELECT trace, pos FROM (SELECT trace, pos, row_number() OVER (PARTITION BY trace ORDER BY score DESC, pos) AS c "
        f"FROM ({PATTERNS[pattern]}) x) y WHERE c <= {MAX_TOKENS})"
    )


_COMPARED = (
    "SELECT '{0}' AS pattern, w.trace, count(s.pos) AS reads, "
    f"round(sum(CASE WHEN s.pos IS NOT NULL AND w.r < {TOP_K} THEN 1.0E0 ELSE 0.0E0 END) / least({TOP_K}, max(w.n)), 6) AS recall, "
    "round(sum(CASE WHEN s.pos IS NOT NULL THEN w.p ELSE 0.0E0 END), 6) AS mass, round(1 - count(s.pos) * 1.0E0 / max(w.n), 6) AS saved "
    "FROM w LEFT JOIN sel_{0} s ON s.trace = w.trace AND s.pos = w.pos GROUP BY w.trace"
)
COMPARE = BASE + "".join(", " + chosen(p, f"sel_{p}") for p in PATTERNS) + ", cmp AS (" + " UNION ALL ".join(_COMPARED.format(p) for p in PATTERNS) + ")"
_PASS = " AND ".join(f"{k} >= {v}" for k, v in GATE.items())
SUMMARY = (
    COMPARE
    + f" SELECT pattern, count(*) AS traces, sum(CASE WHEN {_PASS} THEN 1 ELSE 0 END) AS passed, round(avg(recall), 6) AS mean_recall, "
    "round(min(recall), 6) AS least_recall, round(avg(mass), 6) AS mean_mass, round(avg(saved), 6) AS mean_saved, "
    f"min(CASE WHEN {_PASS} THEN 1 ELSE 0 END) = 1 AS candidate FROM cmp GROUP BY pattern"
)
