"""Named queries over the tables of a folder, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from gavelspark.session import tune
from gavelspark.sources.tables import sql_with

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Plan], Plan]:
    """Register a plan; ``views`` names the views its SQL reads."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is there already")

        @wraps(plan)
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(tune(spark), sf_dir)

        PLANS[name] = tuned
        if sql is not None:
            SQL[name] = sql_with(sql, *views.split()) if views else sql.strip()
        return plan

    return register
