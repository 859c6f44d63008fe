"""All queries over the metric tables, with the SQL that gives the same rows."""

from brightwell.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
