"""Cutting a table's lineage in the shared folder that the cluster names."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def named(df: DataFrame) -> None:
    """Names the folder: that of spark.checkpoint.dir; where none is named, a temporary one in local mode, as in tests,
    and an error on a cluster, whose machines don't share such a folder."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "quire-lineage"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df as reliably checkpointed."""
    named(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the application's checkpoint folder. It is computed once, and unlike a checkpoint what it is read
    as tells nothing of what it was made by; loops whose tables come from those of the round before need that, as the
    constraints that Spark infers would double with each round."""
    named(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
