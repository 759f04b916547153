"""All registered queries of the library and their SQL."""

from __future__ import annotations

from quorumlake.plans import jobs, queries_blocks, queries_consensus, queries_ingest, queries_keys, queries_lexical, queries_link, queries_pages, queries_publish, queries_stats, queries_text  # noqa: F401
from quorumlake.plans import job_diagnosis, job_publish, job_repair  # noqa: F401  (it composes those above)
from quorumlake.plans.base import QUERIES, SQLS


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQLS)
