"""Intermediate tables in the folder that the cluster shares.

Iterative operators write each round as Parquet and read it back. The lineage
stays short and a lost executor costs a read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one, which only a local session may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _local_root
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="atrium-")
    return _local_root


class Scratch:
    """A folder of its own under the shared root, with one sub-folder for each table."""

    def __init__(self, spark: SparkSession, label: str = "work"):
        self.spark = spark
        self.root = f"{shared_root(spark)}/atrium-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, name: str, frame: DataFrame) -> DataFrame:
        """Write ``frame`` under ``name`` and return it as read from there."""
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
