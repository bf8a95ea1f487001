"""Cutting lineage through reliable storage shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's setting. Only a local session, as in tests, may do without one
    and gets a scratch folder; on a cluster such a folder would be another one on every machine."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="chatledger-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Store ``df`` reliably now; later stages and retries read the stored rows.

    ``like`` is the frame ``df`` has its column ``hot`` from. If nothing in it is hot, the column stays a
    literal after the cut, so the optimizer keeps folding away the branches for hot chats. The check reads
    no rows when ``like`` has the literal, and stops at the first hot row otherwise.
    """
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if like is not None and "hot" in kept.columns and like.where("hot").isEmpty():
        kept = kept.withColumn("hot", F.lit(False))
    return kept


def growing(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the log, which is never sent whole through the driver. The optimizer would take
    it for a small one where its guess is too low: sizes start from compressed files, and what explode adds is not seen."""
    return rows.hint("merge")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for a table the job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
