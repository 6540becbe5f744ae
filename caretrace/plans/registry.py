"""Imports every query module so that the registry is complete."""

from caretrace.plans import governance, guards, models, records, resources, score, windows  # noqa: F401
from caretrace.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
