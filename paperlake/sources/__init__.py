"""Reading feeds, requests and tables; writing tables and responses."""

from .feeds import papers_from_feed, read_feed, with_defaults
from .quarantine import paper_rules, quarantine, topic_rules, vector_rules
from .requests import read_requests
from .tables import (
    append_papers,
    append_topics,
    ensure_tables,
    load_table,
    write_responses,
)

__all__ = [
    "append_papers",
    "append_topics",
    "ensure_tables",
    "load_table",
    "paper_rules",
    "papers_from_feed",
    "quarantine",
    "read_feed",
    "read_requests",
    "topic_rules",
    "vector_rules",
    "with_defaults",
    "write_responses",
]
