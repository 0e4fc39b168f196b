"""Column functions. All of them stay in the JVM."""

from .documents import chat_reply, embedding_reply, json_value, to_json_row
from .register import register_functions
from .text import (
    base_id,
    clean_text,
    embed_text,
    join_authors,
    join_categories,
    paper_id,
    paper_url,
    published_date,
    similarity_pct,
    strip,
    title_case,
)
from .vectors import (
    cosine_distance,
    dot,
    hash_embedding,
    l2_norm,
    l2_normalize,
    vector_from_text,
    vector_to_text,
)

__all__ = [
    "base_id",
    "chat_reply",
    "clean_text",
    "cosine_distance",
    "dot",
    "embed_text",
    "embedding_reply",
    "hash_embedding",
    "join_authors",
    "join_categories",
    "json_value",
    "l2_norm",
    "l2_normalize",
    "paper_id",
    "paper_url",
    "published_date",
    "register_functions",
    "similarity_pct",
    "strip",
    "title_case",
    "to_json_row",
    "vector_from_text",
    "vector_to_text",
]
