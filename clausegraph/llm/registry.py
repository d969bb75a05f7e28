"""Queries and SQL of all training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from clausegraph.llm import htmltext, langid, media, mixing, neighbours, ngrams, pieces, simhash, tokencount, toolcalls

MODULES = (mixing, pieces, tokencount, toolcalls, htmltext, simhash, ngrams, langid, media, neighbours)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
