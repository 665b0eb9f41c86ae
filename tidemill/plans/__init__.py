"""All registered queries."""

from tidemill.plans import records, relational, streams, tables, warehouse
from tidemill.plans.registry import PLANS

__all__ = ["PLANS", "records", "relational", "streams", "tables", "warehouse"]
