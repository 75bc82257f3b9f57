"""Query name -> function (spark, sf_dir) -> DataFrame, and the SQL that must give the same rows."""

from __future__ import annotations

from driftloom.plans.oracles import ORACLES
from driftloom.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
