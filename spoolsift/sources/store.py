"""Tables kept between steps and between runs.

Parsing is the dear part of every job, so lines are parsed once and the events
kept as parquet; searches and views then read only the columns they need.
"""

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Narrow rows up to this number are broadcast; more take another way.
BROADCAST_ROWS = 100_000


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. Only a session on one machine may do without: it gets a folder there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"spoolsift-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    Later steps read it with column pruning, and a lost executor costs a reread,
    not the steps before. The caller may delete the folder after the job.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, name: str = "small") -> tuple[DataFrame, bool]:
    """The kept table, and whether it has few enough rows to be broadcast; then it is marked for it."""
    table = kept(df, name)
    fits = table.count() <= BROADCAST_ROWS
    return (F.broadcast(table), True) if fits else (table, False)


def spread(table: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt out to all of them before costly work."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def write_events(events: DataFrame, path: str) -> None:
    """Write events by provider and project, records of a session side by side.

    Ranges of (session file, record) split a long session over several files
    and keep row groups narrow in path and number, so that reading one session,
    or a slice of it, skips the rest.
    """
    # Not nullable, else the writer changes the columns and sorts again by them alone.
    for name in ("provider", "project"):
        events = events.withColumn(name, F.coalesce(name, F.lit("")))
    columns = ["provider", "project", "path", "seq", "block"]
    placed = events.repartitionByRange(*columns).sortWithinPartitions(*columns)
    # Only what is written anew is replaced, so that several formats and projects share a place.
    out = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("provider", "project").parquet(path)


def write_lines(events: DataFrame, path: str) -> None:
    """Write the source line of every selected event, one output line per event."""
    events.select("line").write.text(path)
