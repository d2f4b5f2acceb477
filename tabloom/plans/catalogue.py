"""All registered queries of the table operators; importing a module of queries registers them."""

from tabloom.plans import rule_queries  # noqa: F401
from tabloom.plans.queries import ORACLES, QUERIES  # noqa: F401
