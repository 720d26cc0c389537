"""The registered queries: one per operator, over whole tables.

Each entry pairs a Spark query with the SQL that computes the same rows; bytes leave as
hex digits and timestamps as integers, so that both engines hash alike.
"""

from __future__ import annotations

from ringfold.plans import (  # noqa: F401  (importing a module registers its queries)
    digest_queries,
    fanout_queries,
    metric_queries,
    projection_queries,
    rule_queries,
    source_queries,
    stream_queries,
)
from ringfold.plans.digest_queries import flagship
from ringfold.plans.shared import oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
