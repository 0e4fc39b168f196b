"""Setting bad rows aside with their reasons, so that the good ones go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_norm
from ..schema import EMBEDDING_DIM, NAME_LENGTH, PAPER_ID_LENGTH


def reasons_of(rules: dict[str, Column]) -> Column:
    """The reasons of ``rules`` whose test says yes, in their order."""
    return F.array_compact(
        F.array(*(F.when(test, F.lit(reason)) for reason, test in rules.items()))
    )


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` by ``rules``, a mapping of reason to the test for a bad row.

    Returns the good rows and the bad ones; the bad ones carry ``reasons`` in
    the order of the rules. A test that gives null counts as passed.
    """
    broken = F.lit(False)
    for test in rules.values():
        broken = broken | F.coalesce(test, F.lit(False))
    good = df.where(~broken)
    bad = df.where(broken).withColumn("reasons", reasons_of(rules))
    return good, bad


def paper_rules(id_length: int = PAPER_ID_LENGTH) -> dict[str, Column]:
    arxiv_id = F.col("arxiv_id")
    return {
        "missing id": arxiv_id.isNull() | (F.length(arxiv_id) == 0),
        "id too long": F.length(arxiv_id) > id_length,
        "missing title": F.col("title").isNull(),
        "bad date": F.col("published_date").isNull(),
    }


def topic_rules(name_length: int = NAME_LENGTH) -> dict[str, Column]:
    name = F.col("name")
    return {
        "missing name": name.isNull(),
        "name too long": F.length(name) > name_length,
    }


def vector_rules(column: str = "embedding", dim: int = EMBEDDING_DIM) -> dict[str, Column]:
    v = F.col(column)
    return {
        "missing vector": v.isNull(),
        "wrong dimension": F.size(v) != dim,
        "null element": F.exists(v, lambda x: x.isNull()),
        "zero vector": l2_norm(v) == 0,
    }
