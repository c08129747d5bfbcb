"""Importing the query modules fills the registry."""
from . import combine, gaps, rows, shape, describe, charts, reports, web, storage  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
