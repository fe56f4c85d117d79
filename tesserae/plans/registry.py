"""Queries by name and the SQL that each must equal."""

from __future__ import annotations

from tesserae.plans.oracles import ORACLES
from tesserae.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
