"""The queries of these operators and their SQL."""

from quillmark.llm import queries

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name.startswith("op")}
ORACLES = {name: getattr(queries, name.upper()) for name in QUERIES if hasattr(queries, name.upper())}
