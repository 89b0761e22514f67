"""End-to-end plans: registered queries and the SQL that checks them."""

from . import evaluation_queries, feature_queries, hybrid_queries, integrity_queries, learning_queries, retrieval_queries, text_queries, vector_queries
from .registry import QUERIES, SQL

__all__ = [
    "QUERIES", "SQL", "evaluation_queries", "feature_queries", "hybrid_queries", "integrity_queries", "learning_queries",
    "retrieval_queries", "text_queries", "vector_queries",
]
