"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourloom.plans import consolidated, documents, intake, records, review, scalars
from hourloom.plans.views import with_views

PLANS = (scalars, records, documents, review, consolidated, intake)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for plan in PLANS for name, sql in plan.ORACLE.items()}
