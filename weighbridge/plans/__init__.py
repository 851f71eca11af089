"""The registered queries: each operator applied to the given tables, with its check SQL."""

from . import (  # noqa: F401
    catalog_queries, evaluation_queries, parsing_queries, sampling_queries, scoring_queries, session_queries, text_queries,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
