"""Log lines numbered within their file."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], exact: bool = False, **options: str
) -> DataFrame:
    """Every physical line with its 1-based number: ``path, seq, line, size_bytes``.

    A file may be split over many tasks. Each split reports its first row id and
    its number of lines, the counts of the earlier splits of a file give the
    start of each, and a line's number follows from its row id. So no line is
    shuffled unless the table of splits is too large to broadcast, and no task
    sees more than its own split, even for one huge file. ``exact`` ends lines
    at line feeds only, so that writing them back gives the same bytes.
    """
    reader = spark.read.options(**options)
    if exact:
        reader = reader.option("lineSep", "\n")
    # Both branches plan the same scan, so row ids agree; Spark moves no filter below them.
    raw = reader.text([paths] if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.monotonically_increasing_id().alias("_row"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("path", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "path", "_start", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before")
    )
    return raw.join(starts, ["path", "_start"]).select(
        "path",
        (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("seq"),
        "line",
        "size_bytes",
    )


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Is there a file that fits the path pattern?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


# Strings of any length, the longest numbers, and only JSON's own spelling.
JSON_OPTIONS = {"maxStringLen": "1000000000", "maxNumLen": "1000000", "allowSingleQuotes": "false"}

# Fixed value: white space as Python strips it.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# A field that is read behind the line's value: the parser gets there only if the value is one, and all of the line.
_END = "end-of-line-4f1c9a72"


def _read(line: Column, fields: str) -> Column:
    """The line as field ``rec`` of an outer record, which is sound only with the end mark behind it."""
    outer = F.concat(F.lit('{"rec":'), line, F.lit(f',"_end":"{_END}"}}'))
    return F.from_json(outer, f"{fields}_end string, _corrupt_record string", JSON_OPTIONS)


def _whole(read: Column) -> Column:
    return F.coalesce(read["_corrupt_record"].isNull() & (read["_end"] == _END), F.lit(False))


def parsed(lines: DataFrame, fields: str) -> DataFrame:
    """Lines with the given fields as ``rec``, which is NULL where a line holds no JSON object.

    White space around the object is as Python's; nothing else may stand on the line. Declare fields as strings or
    variants, so that no value can be of a wrong type. Bytes that are not UTF-8 become replacement characters first.
    """
    read = _read(F.trim(F.make_valid_utf8("line"), F.lit(WHITE_SPACE)), f"rec struct<{fields}>, ")
    record = F.col("_record")
    sound = _braced(F.trim("line", F.lit(WHITE_SPACE))) & _whole(record)
    return lines.withColumn("_record", read).withColumn("rec", F.when(sound, record["rec"])).drop("_record")


def readable(lines: DataFrame, fields: str) -> DataFrame:
    """Only the lines that hold a JSON object; the numbers of the others stay used."""
    held = parsed(lines, fields).withColumn("rec", F.array("rec"))
    # Exploding one element keeps Spark from parsing once for the filter and once more for the columns.
    return held.withColumn("rec", F.explode_outer("rec")).where(F.col("rec").isNotNull())


def is_json(line: Column) -> Column:
    """Is the line, but for white space around it, one JSON object? Values are skipped, so their size does not matter."""
    bare = F.trim(line, F.lit(WHITE_SPACE))
    return _braced(bare) & _whole(_read(bare, ""))


def _braced(bare: Column) -> Column:
    return F.coalesce(F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}")), F.lit(False))


def line_report(lines: DataFrame) -> DataFrame:
    """Per file: lines, blank lines and lines that hold no readable JSON object."""
    blank = F.trim("line", F.lit(WHITE_SPACE)) == ""
    sound = is_json(F.make_valid_utf8("line"))
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(blank).alias("blank"),
        F.count_if(~blank & ~sound).alias("unreadable"),
    )
