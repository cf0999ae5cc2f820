"""Queries that run single operators over made-up rows of the test tables, with their DuckDB SQL."""

from quire.cases import files, flowing, models, pages, spanned, tables, texts, translated  # noqa: F401  (they register their queries)
from quire.cases.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
