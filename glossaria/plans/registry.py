"""All registered queries and their SQL checks."""

from __future__ import annotations

from glossaria.plans import (
    evaluation_queries,
    ngram_queries,
    pair_queries,
    recode_queries,
    script_queries,
    source_queries,
    subword_queries,
)

FAMILIES = (
    source_queries, recode_queries, ngram_queries, pair_queries, script_queries, subword_queries, evaluation_queries,
)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
