"""The registered queries and the SQL each is checked against."""

from gavelspark.plans import aggregates, events, files, joins, live, streams, telemetry  # noqa: F401  (they register themselves)
from gavelspark.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
