"""All queries of the library outside the optional subpackage."""

from __future__ import annotations

from . import attention_queries, codec_queries, lifecycle_queries, rule_queries, state_queries, store_queries, vector_queries

QUERIES = vector_queries.QUERIES | codec_queries.QUERIES | store_queries.QUERIES | rule_queries.QUERIES | lifecycle_queries.QUERIES | attention_queries.QUERIES | state_queries.QUERIES
ORACLES = vector_queries.ORACLES | codec_queries.ORACLES | store_queries.ORACLES | rule_queries.ORACLES | lifecycle_queries.ORACLES | attention_queries.ORACLES | state_queries.ORACLES
