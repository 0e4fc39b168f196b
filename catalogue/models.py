"""Offline stand-ins for the models a user brings, for the queries and tests."""

from __future__ import annotations

FAILING_MARK = "the"


def hash_model(dim: int):
    """The hash embedder as a function of a list of texts."""
    import hashlib
    import re

    def vectors(texts: list[str]) -> list[list[float]]:
        made = []
        for text in texts:
            counts = [0.0] * dim
            for term in re.split("[ \t\n\x0b\f\r]+", text.lower()):
                if term:
                    counts[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % dim] += 1
            norm = sum(c * c for c in counts) ** 0.5
            made.append([c / norm for c in counts])
        return made

    return vectors


def failing_hash_model(dim: int):
    """The same, failing on every text that holds a mark."""
    plain = hash_model(dim)

    def vectors(texts: list[str]) -> list[list[float]]:
        if any(FAILING_MARK in t for t in texts):
            raise ValueError("cannot embed this text")
        return plain(texts)

    return vectors


def counting_completer():
    """Answers with the length of the last message; fails on an empty question."""

    def reply(messages: list[dict]) -> str:
        content = messages[-1]["content"]
        if "question: fail" in content:
            raise RuntimeError("no model")
        return f"{len(content)} characters"

    return reply
