"""All registered queries of the radar: importing a module registers its queries."""

from glimmer.plans import later, misc, more, pools, rules, space, terms, trade  # noqa: F401
from glimmer.plans.panels import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
