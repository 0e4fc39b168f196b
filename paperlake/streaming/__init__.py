"""The same jobs over files as they arrive."""

from .jobs import chat_stream, ingest_stream

__all__ = ["chat_stream", "ingest_stream"]
