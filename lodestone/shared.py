"""The folder that all executors share, for tables that several jobs read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks for each core that ``spread`` deals rows to.
TASKS_PER_CORE = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only where the session names none and runs in this process alone (tests) a
    folder of this machine is made and put into the session's settings.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that nothing is in yet."""
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}/tables/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt to several tasks for each core, by their hash, for work that is long for rows so short.

    A small file is one task to Spark, however much work its rows make.
    """
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: one fixed version of its rows, whoever reads it and how often."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
