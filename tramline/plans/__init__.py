"""Queries over the benchmark tables; importing the modules registers them."""

from tramline.plans import analytics, feeds, network, reads, scalars, streams, structure, timetable  # noqa: F401
from tramline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
