"""Session settings the jobs rely on."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Zone-less stamps are UTC in both record formats.
    "spark.sql.session.timeZone": "UTC",
    # A repeated key keeps its last value instead of making the line unreadable.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are dear here (JSON, regexes), so small shuffles still go to all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Top-n per session keeps at most n rows per session and map task before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    # Python only runs the secret rules; small batches keep long texts within worker memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session; all of them can change at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
