"""Every registered query."""

from workload import q_chain, q_parts, q_request, q_rows  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
