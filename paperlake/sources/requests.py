"""Request files: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHAT_REQUEST, INGEST_REQUEST

_SCHEMAS = {"ingest": INGEST_REQUEST, "chat": CHAT_REQUEST}


def read_requests(
    spark: SparkSession, path: str, kind: str, streaming: bool = False
) -> DataFrame:
    """Requests of ``kind`` ``"ingest"`` or ``"chat"``.

    A request without an id is named by its file and its place in the read. In a
    stream that is left to ``name_requests``, applied to each batch.
    """
    reader = spark.readStream if streaming else spark.read
    requests = (
        reader.schema(_SCHEMAS[kind])
        .json(path)
        .select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    )
    return requests if streaming else name_requests(requests)


def name_requests(requests: DataFrame) -> DataFrame:
    named = F.concat_ws("#", "file", F.monotonically_increasing_id())
    return requests.withColumn("request_id", F.coalesce("request_id", named)).drop("file")
