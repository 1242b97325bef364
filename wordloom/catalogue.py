"""All queries of the engine by name, and the same in SQL."""

from wordloom.plans.catalogue import queries
from wordloom.plans.oracle import oracle_sql

__all__ = ["oracle_sql", "queries"]
