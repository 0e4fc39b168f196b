"""Whole jobs made of the operators."""

from .chat import chat
from .ingest import IngestResult, ingest

__all__ = ["IngestResult", "chat", "ingest"]
