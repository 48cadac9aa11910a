"""Registered queries by area; importing this package fills the registry."""

from . import evaluation_q, events_q, joins_q, scoring_q, sources_q, windows_q  # noqa: F401
from .registry import ORACLES, QUERIES
from .windows_q import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
