"""The training-data operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import (
    decontaminate,
    infill,
    jaccard,
    language,
    multiindex,
    nearest,
    oracles,
    packing,
    quality,
    secrets,
    sharding,
    spelling,
    suffixes,
    urls,
)
from paperlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The other queries are beyond SQL, or draw on what it lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": oracles.SUFFIXES,
    "op5_benchmark_decontamination": oracles.DECONTAMINATION,
    "op8_ngram_jaccard_join": oracles.JACCARD,
    "op10_exact_top_k": oracles.TOP_K,
    "op11_fill_in_middle": oracles.FILL_IN_MIDDLE,
}


def query(made):
    QUERIES[made.__name__] = made
    return made


def tokenizer_path(name: str) -> str:
    """Where an installed public vocabulary is."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_suffix_array_dedup(spark, sf_dir):
    return suffixes.measure(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op5_benchmark_decontamination(spark, sf_dir):
    return decontaminate.measure(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op7_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard.joined(table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op9_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


@query
def op10_exact_top_k(spark, sf_dir):
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query
def op11_fill_in_middle(spark, sf_dir):
    return infill.measure(table(spark, sf_dir, "documents"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.measure(table(spark, sf_dir, "documents"))


@query
def op12_approximate_nearest(spark, sf_dir):
    return multiindex.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
