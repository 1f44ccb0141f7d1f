"""Masking secrets in session files that stay where they are: only files with a secret are written anew.

One scan finds the lines that change. Its table (file, line number, new line) is all that later steps work from: the report counts it,
and writing replaces those lines in the files it names. Files without a finding are neither read again nor copied.
"""

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.functions.times import is_live
from spoolsift.operators.detect import worth_scanning
from spoolsift.operators.redact import redact_lines, redaction_report
from spoolsift.operators.rules import OWN_RULES, RuleSet
from spoolsift.sources.files import literal
from spoolsift.sources.lines import read_lines
from spoolsift.sources.store import kept

# Files that are written anew in one pass; their names go through the driver.
FILES_A_PASS = 5_000


@dataclass(frozen=True)
class Cleaning:
    """What a scan found: the changed lines, sessions left alone as they are still written, and the report per file."""

    changes: DataFrame
    live: DataFrame
    report: DataFrame


def changed_lines(lines: DataFrame, salt: str, rules: RuleSet = OWN_RULES) -> DataFrame:
    """The lines that masking changes: project, session_id, path, seq, line (new), was (hash of the old one), replacements, kinds.

    A filter in the JVM goes first, so that only lines with a word that some rule needs reach Python.
    """
    hot = lines.where(F.is_valid_utf8("line") & worth_scanning(F.col("line"), rules, json_line=True))
    keys = ("project", "session_id", "path", "seq", "size_bytes")
    narrow = hot.select(*keys, "line", F.xxhash64("line").alias("was"))
    return redact_lines(narrow, salt, rules).where("replacements > 0")


def scan(lines: DataFrame, sessions: DataFrame, salt: str, now: datetime | Column, rules: RuleSet = OWN_RULES) -> Cleaning:
    """Look through numbered lines (read with ``exact``) of the sessions' files.

    ``sessions`` has project, session_id and ended. Nothing of a live session is changed: what is still written cannot be
    replaced. Lines of files without a session row count as finished.
    """
    writing = sessions.where(is_live(F.col("ended"), now)).select("project", "session_id").distinct()
    changes = kept(changed_lines(lines, salt, rules), "changes")
    # Few rows are left by now, so the live ones are taken out here and not before the scan.
    named = writing.select(F.col("project").alias("_project"), F.col("session_id").alias("_session"))
    same = F.col("project").eqNullSafe(F.col("_project")) & F.col("session_id").eqNullSafe(F.col("_session"))
    finished = changes.join(named, same, "left_anti")
    return Cleaning(finished, writing, redaction_report(finished))


def write_changed(changes: DataFrame, out: str) -> DataFrame:
    """Write the files that ``changes`` name below ``out`` with the changed lines in place, and the list of them.

    The list (out/manifest: path, folder, lines, size_bytes, state) says which folder holds a file's new content, in parts that
    follow each other by name. ``state`` is ``written``, or ``changed`` for a file that is no longer as it was when it was scanned, or changed
    while it was read; then its folder does not count and the file is left as it is. Bytes of all other lines stay the same,
    but an unterminated last line gets its line feed.
    """
    spark = changes.sparkSession
    files = changes.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.max("size_bytes").alias("size_bytes"))
    files = kept(files, "files")
    passes = -(-files.count() // FILES_A_PASS)
    number = F.pmod(F.xxhash64("path"), F.lit(max(1, passes)))
    run = uuid.uuid4().hex
    for k in range(passes):
        batch, folder = files.where(number == k), f"{out}/files/{run}-{k}"
        paths = [r["path"] for r in batch.select("path").collect()]
        if paths:
            written = _rewrite(spark, paths, changes.where(number == k), folder)
            sound = F.col("_done").eqNullSafe(F.col("lines")) & F.col("_same")
            place = F.concat(F.lit(f"{folder}/file="), F.coalesce("file", F.lit("")))
            _listed(batch.join(written, "path", "left"), place, F.when(sound, "written").otherwise("changed"), out)
    if not passes:
        _listed(files, F.col("path"), F.lit("written"), out)
    return spark.read.parquet(f"{out}/manifest")


def _listed(files: DataFrame, folder: Column, state: Column, out: str) -> None:
    rows = files.select("path", folder.alias("folder"), "lines", "size_bytes", state.alias("state"))
    rows.write.mode("append").parquet(f"{out}/manifest")


def _rewrite(spark: SparkSession, paths: list[str], changes: DataFrame, out: str) -> DataFrame:
    """path, file, _done (lines replaced) and _same (is the file now as it was when read?) of the files written to ``out``."""
    before = kept(_sizes(spark, paths), "before")
    new = changes.select(F.col("path").alias("_path"), F.col("seq").alias("_seq"), F.col("line").alias("_line"), "was")
    lines = read_lines(spark, [literal(p) for p in paths], exact=True)
    joined = lines.join(new, (F.col("path") == F.col("_path")) & (F.col("seq") == F.col("_seq")), "left")
    # A line that is not what it was when scanned stays, and so the file has fewer replaced lines than found.
    fits = F.col("_line").isNotNull() & (F.xxhash64("line") == F.col("was"))
    file = F.sha2("path", 256)
    rows = joined.select("path", file.alias("file"), "seq", F.when(fits, F.col("_line")).otherwise(F.col("line")).alias("line"), fits.alias("_fits"))
    placed = rows.repartitionByRange("file", "seq").sortWithinPartitions("file", "seq")
    placed.select("file", "line").write.partitionBy("file").text(out)
    done = rows.groupBy("path", "file").agg(F.count_if("_fits").alias("_done"))
    after = _sizes(spark, paths).select(F.col("path").alias("_p"), F.col("size_bytes").alias("_size"), F.col("modified").alias("_at"))
    whole = done.join(before.withColumnRenamed("size_bytes", "_was_size"), "path").join(after, F.col("path") == F.col("_p"), "left")
    same = F.coalesce((F.col("_was_size") == F.col("_size")) & (F.col("modified") == F.col("_at")), F.lit(False))
    return kept(whole.select("path", "file", "_done", same.alias("_same")), "rewritten")


def _sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Size and time of some files; no content is read."""
    found = spark.read.format("binaryFile").load([literal(p) for p in paths])
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def cleaned_lines(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """The new content of one file, by line number: seq, line."""
    row = manifest.where((F.col("path") == path) & (F.col("state") == "written")).first()
    if row is None:
        raise ValueError(f"{path} was not written anew")
    # Parts are named in the order of their lines.
    parts = read_lines(spark, row["folder"], exact=True)
    sizes = parts.groupBy("path").agg(F.max("seq").alias("_lines")).orderBy("path").collect()
    starts, total = [], 0
    for part in sizes:
        starts.append((part["path"], total))
        total += part["_lines"]
    offsets = spark.createDataFrame(starts, "path string, _before bigint")
    return parts.join(offsets, "path").select((F.col("_before") + F.col("seq")).alias("seq"), "line")
