"""Tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Lets Spark drop a write's shuffle files once it is done; the session's setting is put back."""
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


class Scratch:
    """Tables written under the shared folder of spark.checkpoint.dir: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.gettempdir() + "/roadweave"  # one machine, one process
        self.base = f"{base}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with freed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, schema, *names: str) -> DataFrame:
        """Several tables of one schema as one."""
        return self.spark.read.schema(schema).parquet(*(f"{self.base}/{n}" for n in names))

    def drop(self, *names: str) -> None:
        """Frees tables that nothing returned depends on any more."""
        jvm = self.spark.sparkContext._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kernel_parts(spark: SparkSession) -> int:
    """Partitions for work whose cost is in Python, not in bytes, which adaptive execution would gather in a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
