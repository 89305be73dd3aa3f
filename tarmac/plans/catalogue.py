"""All registered queries."""

from tarmac.plans import anomaly, answers, clips, events, places, records, risk, search, streams, traffic  # noqa: F401
from tarmac.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
