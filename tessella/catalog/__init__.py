"""The named queries of the library, each with the SQL that gives the same rows where SQL can.

The queries apply the operators to whole tables.  Where the tables have no such relation (links, logs,
redirects), it is derived from one they have, in the query and in its SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.catalog import corpus, exports, graphs, joins, pages, site, tables
from tessella.catalog.base import Query

ALL: tuple[Query, ...] = (*pages.QUERIES, *joins.QUERIES, *graphs.QUERIES, *corpus.QUERIES, *tables.QUERIES, *site.QUERIES, *exports.QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit of the crawled pages found, by check."""
    return next(q for q in ALL if q.name == "audit_by_check").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for q in ALL}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in ALL if q.sql}
