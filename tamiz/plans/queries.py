"""All registered queries of the library."""

from . import analyse, content, elements, feedback, fewshots, loads, relational, replies, rules, runs, statistics, store  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
