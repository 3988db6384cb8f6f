"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. A table written there cuts the lineage and outlives a lost executor. Where
the setting is absent (tests on one machine) a temporary folder of the driver takes its place; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or a temporary folder where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="ferry-")
    return _FALLBACK[app]


@contextmanager
def small_jobs(spark: SparkSession):
    """Jobs inside are many and of bounded size: a few tasks a core each, and no shuffle files once they have ended, which else
    stay until the driver happens to collect its garbage."""
    own = {"spark.sql.shuffle.partitions": str(4 * spark.sparkContext.defaultParallelism), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Scratch:
    """Named Parquet tables in one fresh sub-folder of the shared folder."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` and return it reread, with the schema it had."""
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
