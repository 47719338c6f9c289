"""All registered queries."""

from . import queries_evidence, queries_flow, queries_geo, queries_report, queries_tracks  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
