"""JSON text at the edges: requests and model replies in, responses out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(col: Column, path: str, dtype: str = "string") -> Column:
    """Value at a JSON path; null where the path or the document is missing.

    ``path`` is written ``a.b[0].c``.
    """
    text = F.get_json_object(col, "$." + path)
    return text if dtype == "string" else text.try_cast(dtype)


def embedding_reply(col: Column) -> Column:
    """The vector of an embedding model's reply."""
    return F.from_json(col, "embedding array<float>")["embedding"]


def chat_reply(col: Column) -> Column:
    """The answer text of a chat model's reply."""
    return json_value(col, "choices[0].message.content")


def to_json_row(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))
