"""Queries over the given tables, each with the same computation as SQL where SQL can express it."""

from framewell.queries import catalog, clips, export, frames, texts

MODULES = [clips, catalog, texts, frames, export]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
