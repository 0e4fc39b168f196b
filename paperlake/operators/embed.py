"""Embedding texts with a model the user brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import embed_text
from ..schema import EMBEDDING_DIM
from .ingest import ARRIVAL

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

# The report of a failed text, and how much of a title it shows.
FAILED = "Embedding failed for %s...: %s"
TITLE_SHOWN = 30

# Texts handed to a model in one call.
CALL_ROWS = 64


def embed(
    df: DataFrame,
    text_col: str,
    load_model: Callable[[], Embedder],
    dim: int = EMBEDDING_DIM,
    out: str = "embedding",
    call_rows: int = CALL_ROWS,
) -> DataFrame:
    """Add the vector of a text and, where it could not be made, ``embed_error``.

    ``load_model`` runs once per task and returns the embedder, which takes a
    list of texts. If a call fails its texts are tried one at a time, so that
    one bad text does not cost the others their vectors. Only the text goes to
    Python. Materialise the result before using it twice, or the model is
    called twice.
    """

    def one(model: Embedder, text: str) -> tuple[list[float] | None, str | None]:
        try:
            vector = [float(x) for x in model([text])[0]]
        except Exception as error:  # whatever the user's model raises
            return None, str(error) or type(error).__name__
        if len(vector) != dim:
            return None, f"{len(vector)} numbers instead of {dim}"
        return vector, None

    def call(model: Embedder, texts: list[str]) -> list[tuple]:
        try:
            vectors = [[float(x) for x in v] for v in model(texts)]
        except Exception:
            vectors = []
        if len(vectors) == len(texts) and all(len(v) == dim for v in vectors):
            return [(v, None) for v in vectors]
        return [one(model, t) for t in texts]

    kind = pa.struct([("embedding", pa.list_(pa.float32())), ("error", pa.string())])

    @F.arrow_udf("embedding array<float>, error string")
    def vectors_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for batch in batches:
            # texts and numbers are Python's for one call only
            vectors, made = np.zeros((len(batch), dim), np.float32), np.zeros(len(batch), bool)
            errors: list[str | None] = [None] * len(batch)
            present = np.flatnonzero(batch.is_valid().to_numpy(zero_copy_only=False))
            for at in range(0, len(present), call_rows):
                rows = present[at : at + call_rows]
                for row, (vector, error) in zip(rows, call(model, batch.take(pa.array(rows)).to_pylist())):
                    errors[row] = error
                    if vector is not None:
                        vectors[row], made[row] = vector, True
            numbers = vectors[made].ravel()
            ends = np.r_[0, np.cumsum(made * dim)].astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(ends), pa.array(numbers, mask=np.isnan(numbers)), mask=pa.array(~made)
            )
            yield pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], fields=list(kind))

    # a model may answer differently twice, and must not be asked twice
    return (
        df.withColumn("_made", vectors_of.asNondeterministic()(F.col(text_col)))
        .withColumns({out: F.col("_made.embedding"), "embed_error": F.col("_made.error")})
        .drop("_made")
    )


def embed_only(
    batch: DataFrame,
    load_model: Callable[[], Embedder],
    n: int = 3,
    dim: int = EMBEDDING_DIM,
    order: tuple[str, ...] = ARRIVAL,
) -> DataFrame:
    """Try the model on the first ``n`` papers of each request, storing nothing."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    first = (
        batch.withColumn("_place", place)
        .where(F.col("_place") <= n)
        .withColumn("_text", embed_text(F.col("title"), F.col("abstract")))
    )
    tried = embed(first, "_text", load_model, dim)
    report = F.format_string(FAILED, F.left("title", F.lit(TITLE_SHOWN)), F.col("embed_error"))
    failure = F.when(F.col("embed_error").isNotNull(), report)
    fields = ("title", "authors", "arxiv_id", "published_date")
    samples = F.array_sort(F.collect_list(F.struct("_place", *fields)))
    # at most n rows per request
    tries = tried.groupBy("request_id").agg(
        F.count("embedding").alias("embeddings_generated"),
        F.sort_array(F.collect_list(failure)).alias("embedding_errors"),
        F.transform(samples, lambda p: F.struct(*(p[f].alias(f) for f in fields))).alias(
            "sample_papers"
        ),
    )
    fetched = batch.groupBy("request_id").agg(F.count("*").alias("total_papers_fetched"))
    return fetched.join(tries, "request_id")
