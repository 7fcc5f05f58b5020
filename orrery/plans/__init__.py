"""Queries over the given tables, each with the SQL it is held against."""

from . import changes, fields, files, motion, reading, records, spatial

MODULES = (spatial, motion, fields, records, files, reading, changes)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
