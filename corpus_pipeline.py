"""A training corpus from ``documents``: judged, thinned, cleaned and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from paperlake.llm import decontaminate, jaccard, packing, quality, secrets
from paperlake.llm.common import id_bucket, stored, table
from paperlake.llm.queries import tokenizer_path


def quality_classifier(spark, docs, sf_dir):
    """Documents that the factorisation machine finds good; it learns as in its own query."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), learn_from=id_bucket("doc_id", 3) != 1)
    return quality.keep(docs, machine)


def ngram_jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark, docs, sf_dir):
    """The documents with every secret replaced by a mark."""
    return secrets.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of the tokenised documents, each with its sequence and place there."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Training, exact similarity joins and tokenising are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
