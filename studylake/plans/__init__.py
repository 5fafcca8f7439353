"""Registered queries over the library's operators."""

from . import annotations, discussion, editing, ingest, library, sinks, stored, study
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "annotations", "discussion", "editing", "ingest", "library", "sinks", "stored", "study"]
