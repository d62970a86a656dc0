"""Intermediate tables in the folder that driver and executors share: lineage ends in them and they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: `spark.checkpoint.dir` of the session.

    Where it is unset, a session whose executors are threads of this process gets a folder of its own; on a cluster that is
    an error, as executors elsewhere could not read it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-checkpoint-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/glyphmill-{uuid.uuid4().hex}"


def write_table(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._glyphmill_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables of `write_table` that no later step reads, also those that a result of `placed` reads."""
    for df in tables:
        drop_table(*getattr(df, "_glyphmill_under", ()))
        path = getattr(df, "_glyphmill_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
