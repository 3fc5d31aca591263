"""All named queries."""

from . import curation, evaluation, files, near, pages, streams, windowed  # noqa: F401
from .registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
