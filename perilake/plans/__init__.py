"""Named plans: the layered load, the reports and their check SQL."""

from perilake.plans import incremental, knowledge, modeling, profiles, reports, steps  # noqa: F401
from perilake.plans.catalog import PLANS

__all__ = ["PLANS"]
