"""All queries of the retrieval engine."""

from . import evaluation, misc, retrieval, sources, vectors
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "evaluation", "misc", "retrieval", "sources", "vectors"]
