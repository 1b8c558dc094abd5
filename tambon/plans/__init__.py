"""Registered queries and the SQL they are held against."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
