"""Small things that several operators need: written tables in the shared folder, and keys of rows."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.sources.store import kept, work_folder

__all__ = ["Scratch", "kept", "text_key", "work_folder"]


def text_key(text: str = "text") -> Column:
    """A hash of the text, null as empty: with doc_id it names a row, equal rows share it and have equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Scratch:
    """Intermediate tables of one job in the shared folder; those that nothing lazy still reads can be dropped early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
