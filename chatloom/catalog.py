"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from chatloom.plans import review_queries, source_queries, workflow_queries
from chatloom.plans.oracles import ORACLE_SQL as BROWSE_SQL
from chatloom.plans.queries import QUERIES
from chatloom.plans.review_oracles import ORACLE_SQL as REVIEW_SQL
from chatloom.plans.source_oracles import ORACLE_SQL as SOURCE_SQL
from chatloom.plans.workflow_oracles import ORACLE_SQL as WORKFLOW_SQL

ORACLE_SQL = BROWSE_SQL | WORKFLOW_SQL | REVIEW_SQL | SOURCE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "review_queries", "source_queries", "workflow_queries"]
