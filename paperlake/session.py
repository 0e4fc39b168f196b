"""What the operators need from a session: shared storage and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; a cluster
    session is refused, because a machine-local folder would lose data there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="paperlake-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget its lineage.

    Used where a step must not run twice: model calls and key assignment.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, rows: int) -> bool:
    """True if ``df`` is proven to hold at most ``rows`` rows.

    A count reads no columns and sends one number per task; a limit would send
    that many rows per task.
    """
    return df.count() <= rows
