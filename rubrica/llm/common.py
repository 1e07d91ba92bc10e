"""What several text operators share: intermediate tables and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of anything but ASCII white space. Java's and DuckDB's regex dialects read this alike.
WORD = r"[^\x20\x09-\x0D]+"
#: The white space between words, for split().
GAP = r"[\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker: bounds what a worker and its executor hold at a time.
BATCH_BYTES = 8 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's bound on the bytes of an Arrow batch, if it is higher; texts may be very long.

    Plans are made when they run, so the lower bound stays in the session.
    """
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in this one process, a temporary
    folder is made; on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rubrica-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A table that is written and read again cuts lineage, outlives any
    executor, and has a known size, by which Spark chooses its joins. Results
    read these tables when they run, so they stay until swept() is left.
    """

    #: The folders of workspaces opened inside of swept(), innermost last.
    watched: ClassVar[list[list[str]]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rubrica/{name}-{uuid.uuid4().hex[:12]}"
        self.made = 0
        if Workspace.watched:
            Workspace.watched[-1].append(self.root)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written and read again; ``by`` names a column whose values get folders of their own."""
        path = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._rubrica_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table made by keep() that nothing reads any more."""
        _delete(self.spark, df._rubrica_path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Deletes the workspaces opened inside; what was made of them must be written by then."""
    Workspace.watched.append([])
    try:
        yield
    finally:
        for folder in Workspace.watched.pop():
            _delete(spark, folder)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
