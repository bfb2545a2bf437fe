"""Queries over the driver's tables, by name."""

from . import clinic, evaluation, reports, signals
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "clinic", "evaluation", "reports", "signals"]
