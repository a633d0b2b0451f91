"""All registered queries: name -> (callable of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from . import alignment_queries, assignment_queries, depth_queries, error_queries, file_queries, interval_queries, reduction_queries, sequence_queries, stitch_queries, table_queries, various_queries

CATALOG: dict = {**interval_queries.QUERIES, **alignment_queries.QUERIES, **sequence_queries.QUERIES, **table_queries.QUERIES, **reduction_queries.QUERIES, **stitch_queries.QUERIES, **depth_queries.QUERIES, **assignment_queries.QUERIES, **file_queries.QUERIES, **error_queries.QUERIES, **various_queries.QUERIES}


def queries() -> dict:
    return {n: f for n, (f, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in CATALOG.items() if s}
