"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table and reading it back. The folder
is the one the cluster names in ``spark.checkpoint.dir``; only a local session that names
none gets one of its own, because on a cluster a machine-local folder would lose rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "/tmp/checkpoints"
#: Removes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    return LOCAL_DEFAULT


class Scratch:
    """Tables of one operator run.

    ``drop`` removes those that are no longer read. What is left, as a result may still be read
    from it, goes when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back: the same rows with a one-step lineage."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        conf = self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")  # the table stands for what was shuffled to make it
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def view(self, df: DataFrame, *columns: str) -> DataFrame:
        """Some columns of a kept table, which can be dropped by them too."""
        some = df.select(*columns)
        some._scratch_path = df._scratch_path
        return some

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` returned, when nothing will read it again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
