"""Files themselves as a table, listed by the tasks.

Spark's readers never show a file without bytes, and reading a file to learn its size is dear. So folders are dealt out,
and each task lists its own ones.
"""

import re
import sys
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES = "path string, size_bytes bigint, modified timestamp"
# Characters of a path that Spark's readers would take for a pattern.
_PATTERN = "\\*?[]{},"


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that fit a path pattern, with their scheme; one slash follows it where there is no host, as in Spark's readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(path) or []
    names = [status.getPath().toUri().toString() for status in found if status.isDirectory()]
    return [re.sub("^([^:/]+:)///", r"\1/", name) for name in names]


def list_files(spark: SparkSession, pattern: str, suffix: str = ".jsonl") -> DataFrame:
    """Files right below the folders that fit ``pattern``, whatever their size: path (as Spark's readers give it), size_bytes, modified.

    The driver only learns the folders.
    """
    names = folders(spark, pattern)
    dealt = spark.createDataFrame([(name,) for name in names], "folder string")
    dealt = dealt.repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4)), "folder")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch["folder"]:
                store, place = fs.FileSystem.from_uri(_for_arrow(folder))
                head = folder.removesuffix("/")
                found = [f for f in store.get_file_info(fs.FileSelector(place)) if f.is_file and f.base_name.endswith(suffix)]
                yield pd.DataFrame(
                    {
                        "path": [f"{head}/{_named(f.base_name)}" for f in found],
                        "size_bytes": [f.size for f in found],
                        "modified": pd.to_datetime([f.mtime for f in found], utc=True).tz_localize(None).astype("datetime64[us]"),
                    }
                )

    return dealt.mapInPandas(listed, FILES)


# Characters that a path keeps as they are when a reader names it, beside letters, digits and all beyond ASCII.
_KEPT = "/:@!$&'()*+,;=-._~"


def _named(name: str) -> str:
    return "".join(c if not c.isascii() or c.isalnum() or c in _KEPT else quote(c, safe="") for c in name)


def _for_arrow(uri: str) -> str:
    """With three slashes where there is no host, and in ASCII only."""
    parts = urlsplit(uri)
    whole = uri if parts.netloc else f"{parts.scheme or 'file'}://{parts.path}"
    return quote(whole, safe=_KEPT + "%?#")


def literal(path: str) -> str:
    """A listed path as a reader takes it: decoded, and no character of it a pattern."""
    return "".join(f"\\{c}" if c in _PATTERN else c for c in unquote(path))


def without_rows(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Files that no session stands for."""
    known = sessions.select(F.col("path").alias("_known"))
    return files.join(known, F.col("path") == F.col("_known"), "left_anti")
