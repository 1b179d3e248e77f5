"""Tables kept in the checkpoint folder that the cluster shares: computed once, their lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of this machine's only where none is named, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = context.getConf().get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="isomere-checkpoints-"))
    return context.getCheckpointDir()


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose joins are told to shuffle; the hint of a stored table ends at the first join or union above it."""
    return df.hint("merge")


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df, written as Parquet to a folder of its own in the shared folder, and read again.

    Plans that use it several times stay small. The planner takes its size to be that of its files, in which texts that
    repeat take a hundredth of their room; so that no table that grows with the documents is broadcast, its joins are told to
    shuffle. A side that is broadcast by name still is.
    """
    where = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return shuffled(df.sparkSession.read.schema(df.schema).parquet(where))
