"""Registered queries over the given tables; importing the modules fills the registry."""

from quartermark.workload.base import ORACLES, QUERIES
from quartermark.workload import cube, forecast, graphs, live, spatial  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
