"""Queries over the provided tables, with their SQL equivalents."""

from . import archives, progress, stores, trees

QUERIES = {**trees.QUERIES, **stores.QUERIES, **archives.QUERIES, **progress.QUERIES}
ORACLE_SQL = {**trees.ORACLE_SQL, **stores.ORACLE_SQL, **archives.ORACLE_SQL, **progress.ORACLE_SQL}
