"""All queries of the engine but those on training text."""

from driftline.plans import selections, signals, words  # noqa: F401  they register their queries
from driftline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
