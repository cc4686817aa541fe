"""Registered queries over the library's own operators, and their SQL where SQL can express them."""

from holosna.plans import queries, reading, relations, typed

QUERIES = queries.QUERIES | reading.QUERIES | typed.QUERIES | relations.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | reading.ORACLE_SQL | typed.ORACLE_SQL | relations.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
