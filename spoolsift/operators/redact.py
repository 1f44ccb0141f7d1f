"""Masking secrets in log lines, and the report of what that changes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsift.functions.secrets import fingerprint, marker
from spoolsift.model import slab_of
from spoolsift.operators.detect import each, find_secrets, worth_scanning
from spoolsift.operators.rules import OWN_RULES, RuleSet
from spoolsift.sources.lines import is_json

# A JSON string, taken as a whole so that no match can start inside one, and the colon that makes it a key.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'


def string_values(line: Column) -> Column:
    """All string values of a JSON line at any depth, without the keys."""
    literals = F.regexp_extract_all(line, F.lit(_LITERAL), F.lit(0))
    values = F.filter(literals, lambda s: F.endswith(s, F.lit('"')))
    plain = lambda s: F.substring(s, F.lit(2), F.length(s) - 2)
    decoded = lambda s: F.try_variant_get(F.try_parse_json(s), "$", "string")
    return F.transform(values, lambda s: F.when(F.contains(s, F.lit("\\")), decoded(s)).otherwise(plain(s)))


def line_findings(
    lines: DataFrame,
    rules: RuleSet = OWN_RULES,
    candidates: bool = False,
    by_value: bool = False,
) -> DataFrame:
    """Add ``findings`` over all string values of a line; NULL for lines that are not scanned.

    Lines that are not UTF-8 or not JSON are left alone.
    """
    scanned = F.is_valid_utf8("line") & worth_scanning(F.col("line"), rules, candidates, json_line=True) & is_json(F.col("line"))
    values = F.when(scanned, string_values(F.col("line")))
    return lines.withColumn("findings", find_secrets(values, rules, candidates, by_value))


def line_audit_rows(
    lines: DataFrame, salt: str, rules: RuleSet = OWN_RULES, candidates: bool = False
) -> DataFrame:
    """One row per finding in the lines, ready for :func:`spoolsift.operators.detect.audit`."""
    hot = lines.where(F.is_valid_utf8("line") & worth_scanning(F.col("line"), rules, candidates, json_line=True))
    scanned = line_findings(hot, rules, candidates)
    found = each(scanned.select("session_id", "path", "seq", F.col("findings").alias("f")), "f")
    return found.select(
        "session_id", "path", "seq", "f.kind", "f.severity", fingerprint(F.col("f.value"), salt).alias("fp")
    )


def redact_lines(lines: DataFrame, salt: str, rules: RuleSet = OWN_RULES) -> DataFrame:
    """Lines with every certain or probable secret replaced by its marker.

    Adds ``replacements`` and ``kinds`` (one entry per distinct value replaced).
    A line that would no longer be JSON, and any line without findings, stays
    as it is, byte for byte. Row order within a partition is kept.
    """
    scanned = line_findings(lines, rules, by_value=True)
    marked = F.transform(
        "findings", lambda f: F.struct(f["value"], f["kind"], marker(f["kind"], f["value"], salt).alias("mark"))
    )

    def step(state: Column, f: Column) -> Column:
        text = state["line"]
        hits = ((F.length(text) - F.length(F.replace(text, f["value"], F.lit("")))) / F.length(f["value"])).cast("int")
        kinds = F.when(hits > 0, F.concat(state["kinds"], F.array(f["kind"]))).otherwise(state["kinds"])
        return F.struct(
            F.replace(text, f["value"], f["mark"]).alias("line"),
            (state["replacements"] + hits).alias("replacements"),
            kinds.alias("kinds"),
        )

    start = F.struct(
        F.col("line").alias("line"),
        F.lit(0).alias("replacements"),
        F.array().cast("array<string>").alias("kinds"),
    )
    folded = F.when(F.size("findings") > 0, F.aggregate(marked, start, step))
    # Exploding one element keeps filters on the outcome from repeating the work.
    done = scanned.withColumn("_new", F.array(folded)).withColumn("_new", F.explode_outer("_new")).drop("findings")
    changed = (F.col("_new.replacements") > 0) & is_json(F.col("_new.line"))
    none = F.array().cast("array<string>")
    return done.withColumn("_changed", F.coalesce(changed, F.lit(False))).select(
        *[name for name in lines.columns if name != "line"],
        F.when(F.col("_changed"), F.col("_new.line")).otherwise(F.col("line")).alias("line"),
        F.when(F.col("_changed"), F.col("_new.replacements")).otherwise(0).alias("replacements"),
        F.when(F.col("_changed"), F.col("_new.kinds")).otherwise(none).alias("kinds"),
    )


def without_live(lines: DataFrame, live: DataFrame) -> DataFrame:
    """Lines of sessions that are no longer written; ``live`` holds ``project, session_id`` of the others."""
    # By slab too, so that a long session's lines do not meet in one task.
    writing = live.select(*(F.col(c).alias(f"_{c}") for c in ("project", "session_id"))).distinct()
    tagged = lines.withColumn("_slab", slab_of("seq"))
    slabs = tagged.select("project", "session_id", "_slab").distinct().withColumnRenamed("_slab", "_live_slab")
    same = F.col("project").eqNullSafe(F.col("_project")) & F.col("session_id").eqNullSafe(F.col("_session_id"))
    spread = slabs.join(writing, same, "left_semi")
    spread = spread.select(F.col("project").alias("_project"), F.col("session_id").alias("_session_id"), "_live_slab")
    return tagged.join(spread, same & (F.col("_slab") == F.col("_live_slab")), "left_anti").drop("_slab")


def redaction_report(redacted: DataFrame) -> DataFrame:
    """Per changed file: lines changed, occurrences replaced and the kinds, most frequent first."""
    keys = ["project", "session_id", "path"]
    changed = redacted.where(F.col("replacements") > 0)
    # A changed line has one row per kind; its first row carries the line's own figures.
    rows = changed.select(*keys, "replacements", F.posexplode("kinds").alias("at", "kind"))
    first = F.col("at") == 0
    per_kind = rows.groupBy(*keys, "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(first).alias("lines"),
        F.sum(F.when(first, F.col("replacements")).otherwise(0)).alias("replacements"),
    )
    entry = F.concat("kind", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    # As many entries per file as there are kinds of secrets.
    entries = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "kind", entry.alias("entry"))))
    return per_kind.groupBy(*keys).agg(
        F.sum("lines").alias("lines"),
        F.sum("replacements").alias("replacements"),
        F.array_join(F.transform(entries, lambda e: e["entry"]), ",").alias("kinds"),
    )


def write_redacted(lines: DataFrame, out: str, salt: str, rules: RuleSet = OWN_RULES) -> None:
    """Write the masked lines to a new place, one directory per session file, in file order.

    The lines come from ``read_lines(..., exact=True)``. Ranges of (file, number)
    spread a long file over several parts, named in order. The ranges are cut
    before the scan, so that sampling them costs no scan, and the last sort is
    the order the writer asks for, so that it adds none of its own.
    """
    # Not nullable, else the writer changes the columns and sorts again, without the record number.
    named = lines.select(
        *[F.coalesce(name, F.lit("")).alias(name) for name in ("project", "session_id")],
        F.coalesce(F.regexp_extract("path", r"([^/]+/subagents/[^/]+|[^/]+)\.jsonl$", 1), F.lit("")).alias("file"),
        "seq",
        "line",
    )
    order = ["project", "session_id", "file", "seq"]
    redacted = redact_lines(named.repartitionByRange(*order), salt, rules).sortWithinPartitions(*order)
    redacted.select("project", "session_id", "file", "line").write.partitionBy("project", "session_id", "file").text(out)
