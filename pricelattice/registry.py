"""All queries of the price analytics library by name, with the SQL that checks them."""

from __future__ import annotations

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
