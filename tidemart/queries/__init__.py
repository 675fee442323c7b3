"""Registered queries: name, DataFrame, and equivalent SQL where there is one."""

from . import aggregates, joins, keeping, marts, operations, pipelines, projections, vectors
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "joins", "keeping", "marts", "operations", "pipelines", "projections", "vectors"]
