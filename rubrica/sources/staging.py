"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark is this one process, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rubrica-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once and read again: cuts lineage, fixes row numbers, and outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/rubrica/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
