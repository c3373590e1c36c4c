"""All registered queries of the library's own operators, and their SQL."""

from . import queries_events, queries_scores, queries_text
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "queries_events", "queries_scores", "queries_text"]
