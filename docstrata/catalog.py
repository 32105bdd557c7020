"""Every registered query of the package and its SQL."""

from .plans import cells, chunks, documents, entities, evaluation, events, library, reading, records, retrieval, spans, text  # noqa: F401  each registers its queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
