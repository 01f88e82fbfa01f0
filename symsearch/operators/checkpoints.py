"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; in local tests, where that is unset, one of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder := tempfile.mkdtemp(prefix="symsearch-"))
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder, and read again: it is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/symsearch-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
