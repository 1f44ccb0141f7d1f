"""Records of the nested-message format to events and session summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsift.functions.values import (
    first_truthy,
    get,
    list_at,
    spaced,
    string_or_parts,
    text_at,
    truthy,
    word,
)
from spoolsift.model import EVENT_COLUMNS, KEY
from spoolsift.sources.lines import parsed, readable

# The input keys that describe a tool call, and the fields that
# describe a record that is neither talk, system nor attachment, in order.
ARGUMENT_KEYS = ("command", "file_path", "skill", "pattern", "prompt", "url")
NOTE_KEYS = ("aiTitle", "customTitle", "agentName", "lastPrompt", "mode", "permissionMode")


# Fields of a record and of a content block; what may be of several types stays a variant.
_RECORD = (
    "type string, timestamp string, toolDenialKind string, subtype string, content string, isMeta variant, "
    "isCompactSummary variant, message variant, attachment variant, " + ", ".join(f"{key} variant" for key in NOTE_KEYS)
)
_BLOCK = (
    "struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,is_error:variant,"
    "input:struct<" + ",".join(f"{key}:variant" for key in ARGUMENT_KEYS) + ">,content:variant>"
)


# What only the summary of a session needs.
_SUMMARY = "isSidechain variant, isApiErrorMessage variant, effort string, cwd string, gitBranch string, attributionSkill variant"


def claude_records(lines: DataFrame) -> DataFrame:
    """All that events, summaries and attribution need, read from the lines in one parse; keep it as a table.

    Event rows have a block from 0 on. Each line also has a row with block -1 and without text, whose ``record`` holds what the summary
    of its session is made of.
    """
    return _split(_with_facts(parsed(lines, f"{_RECORD}, {_SUMMARY}")), "record")


def events_of(records: DataFrame) -> DataFrame:
    """The events of a table of records."""
    return records.where("block >= 0").select(*EVENT_COLUMNS)


def sessions_of(records: DataFrame) -> DataFrame:
    """The summaries of a table of records; only its narrow columns are read."""
    return _summaries(_of_lines(records))


def attribution_of(records: DataFrame) -> DataFrame:
    """Records per session and skill of a table of records."""
    return _by_skill(_of_lines(records))


def _of_lines(records: DataFrame) -> DataFrame:
    return records.where("block < 0").select("provider", "project", "session_id", KEY, "seq", "record.*")


def claude_events(lines: DataFrame) -> DataFrame:
    """One event per content block, or one per record without blocks."""
    return _split(parsed(lines, _RECORD)).select(*EVENT_COLUMNS)


def _split(parsed_lines: DataFrame, *also: str) -> DataFrame:
    """Rows of events; with ``also`` given, one more row per line that carries those columns and has block -1."""
    empty, kind = F.lit(""), F.col("type")

    def text(name: str) -> Column:
        return F.coalesce(name, empty)

    talk, attachment = kind.isin("user", "assistant"), F.col("rec.attachment")
    records = parsed_lines.select("*", text("rec.type").alias("type"), get(F.col("rec.message"), "$.content").alias("said"))
    records = records.withColumn("items", F.when(talk, list_at(F.col("said"), "$")))
    with_block = F.exists("items", lambda v: get(v, "$", "struct<type:string>").isNotNull())
    plain = talk & F.col("items").isNull()
    # What the record says as a whole, used where no block stands for it.
    records = records.select(
        *("provider", "project", "session_id", "path", "seq", "line", *also),
        text("rec.timestamp").alias("ts"),
        F.when(kind == "user", "user")
        .when(kind == "assistant", "asst")
        .when(kind == "system", "sys")
        .when(kind == "attachment", "attach")
        .otherwise("meta")
        .alias("role"),
        F.when(plain, "text")
        .when(kind == "system", F.concat(F.lit("system."), text("rec.subtype")))
        .when(kind == "attachment", F.concat(F.lit("attachment."), text_at(attachment, "$.type")))
        .otherwise(kind)
        .alias("whole_kind"),
        F.when(plain, text_at(F.col("said"), "$"))
        .when(talk, "")
        .when(kind == "system", text("rec.content"))
        .when(kind == "attachment", F.coalesce(word(get(attachment, "$.content")), empty))
        .otherwise(first_truthy(*[F.col(f"rec.{key}") for key in NOTE_KEYS]))
        .alias("whole_text"),
        F.when(plain & truthy(F.col("rec.isCompactSummary")), "compact")
        .when(plain & truthy(F.col("rec.isMeta")), "meta")
        .otherwise("")
        .alias("whole_tag"),
        text("rec.toolDenialKind").alias("denial"),
        F.when(truthy(F.col("rec.isMeta")), "meta").otherwise("").alias("text_tag"),
        # One row per block, one for a record without blocks, none for a line that is no record.
        F.when(with_block, F.col("items"))
        .when(F.col("rec").isNotNull(), F.array(F.lit(None).cast("variant")))
        .otherwise(F.array().cast("array<variant>"))
        .alias("blocks"),
    )
    if also:
        # The row of the line itself comes first.
        records = records.withColumn("blocks", F.concat(F.array(F.lit(None).cast("variant")), "blocks"))
    own = F.col("at") < 0
    split = (
        # The outer form spares Spark a filter on the array, for which it would parse every line twice.
        records.select("*", F.posexplode_outer("blocks").alias("at", "item"))
        .where("at IS NOT NULL")
        .where(F.col("item").isNull() | get(F.col("item"), "$", "struct<type:string>").isNotNull())
        .withColumn("at", F.col("at") - (1 if also else 0))
        .withColumn("b", get(F.col("item"), "$", _BLOCK))
        .withColumn("block_type", text("b.type"))
    )
    block_type, is_block = F.col("block_type"), F.col("item").isNotNull()
    is_call, is_result = is_block & (block_type == "tool_use"), is_block & (block_type == "tool_result")
    is_text = is_block & (block_type == "text")
    return split.select(
        *("provider", "project", "session_id", "path", "seq"),
        F.col("at").alias("block"),
        "ts",
        "role",
        F.when(~is_block, F.col("whole_kind"))
        .when(is_call, "tool")
        .when(is_result, "result")
        .otherwise(block_type)
        .alias("kind"),
        F.when(own, F.lit(None))
        .when(~is_block, F.col("whole_text"))
        .when(is_text, text("b.text"))
        .when(block_type == "thinking", text("b.thinking"))
        .when(is_call, _argument())
        .when(is_result, string_or_parts(F.col("b.content")))
        .otherwise(_block_json(""))
        .alias("text"),
        F.when(is_call, text("b.name")).otherwise("").alias("tool"),
        F.when(is_result, truthy(F.col("b.is_error"))).otherwise(F.lit(False)).alias("is_error"),
        F.when(~is_block, F.col("whole_tag"))
        .when(is_result, F.col("denial"))
        .when(is_text, F.col("text_tag"))
        .otherwise("")
        .alias("tag"),
        F.when(is_call, text("b.id")).when(is_result, text("b.tool_use_id")).alias("call_id"),
        F.when(~own, F.col("line")).alias("line"),
        *[F.when(own, F.col(name)).alias(name) for name in also],
    )


def skill_of(events: DataFrame) -> DataFrame:
    """Add ``skill``, the input of a Skill call, read from the source line."""
    path = F.concat(F.lit("$.message.content["), F.col("block").cast("string"), F.lit("].input.skill"))
    used = (F.col("kind") == "tool") & (F.col("tool") == "Skill")
    return events.withColumn("skill", F.when(used, F.coalesce(F.call_function("get_json_object", F.make_valid_utf8("line"), path), F.lit(""))))


def claude_sessions(lines: DataFrame) -> DataFrame:
    """One summary row per session file."""
    fields = (
        "type string, timestamp string, isMeta variant, message variant, aiTitle variant, customTitle variant, " + _SUMMARY
    )
    facts = _with_facts(parsed(lines, fields))
    return _summaries(facts.select("provider", "project", "session_id", KEY, "seq", "record.*"))


def _with_facts(records: DataFrame) -> DataFrame:
    """Add ``record``, what one parsed line adds to its session."""
    message = "struct<content:variant,model:string,usage:variant>"
    block = "struct<type:string,text:string,is_error:variant>"
    blank = F.lit("")
    found = (
        records.withColumn("_message", get(F.col("rec.message"), "$", message))
        .withColumn("_items", list_at(F.col("_message.content"), "$"))
        # NULLs stand for what is no object and drop out of every test below.
        .withColumn("_parts", F.transform("_items", lambda v: get(v, "$", block)))
    )
    first_text = F.get(F.filter("_parts", lambda b: b["type"] == "text"), 0)["text"]
    facts = {
        "size_bytes": F.col("size_bytes"),
        "type": F.coalesce("rec.type", blank),
        "ts": F.nullif("rec.timestamp", blank),
        "sidechain": truthy(F.col("rec.isSidechain")),
        "api_error": truthy(F.col("rec.isApiErrorMessage")),
        "meta": truthy(F.col("rec.isMeta")),
        "model": F.col("_message.model"),
        "effort": F.col("rec.effort"),
        "output_tokens": F.coalesce(get(F.col("_message.usage"), "$.output_tokens", "bigint"), F.lit(0)),
        "cwd": F.col("rec.cwd"),
        "branch": F.coalesce("rec.gitBranch", blank),
        "ai_title": get(F.col("rec.aiTitle"), "$", "string"),
        "custom_title": get(F.col("rec.customTitle"), "$", "string"),
        "error_blocks": F.coalesce(F.size(F.filter("_parts", lambda b: truthy(b["is_error"]))), F.lit(0)),
        "typed": F.nullif(F.when(F.col("_items").isNull(), text_at(F.col("_message.content"), "$")).otherwise(first_text), blank),
        "skill": F.when(truthy(F.col("rec.attributionSkill")), word(F.col("rec.attributionSkill"))),
    }
    record = F.struct(*[value.alias(name) for name, value in facts.items()])
    return found.withColumn("record", record).drop("_message", "_items", "_parts")


def _summaries(records: DataFrame) -> DataFrame:
    """Summaries from the facts of each line."""
    blank = F.lit("")
    user, assistant = F.col("type") == "user", F.col("type") == "assistant"
    earliest = F.min_by(F.when(user & ~F.col("meta"), F.col("typed")), _where(user & ~F.col("meta") & F.col("typed").isNotNull()))
    summary = records.groupBy("provider", "project", "session_id", KEY).agg(
        F.min_by("ts", _where(F.col("ts").isNotNull())).alias("started"),
        F.max_by("ts", _where(F.col("ts").isNotNull())).alias("ended"),
        F.max_by(F.when(F.col("type") == "ai-title", F.col("ai_title")), _where((F.col("type") == "ai-title") & F.col("ai_title").isNotNull())).alias("title"),
        F.max_by(F.when(F.col("type") == "custom-title", F.col("custom_title")), _where((F.col("type") == "custom-title") & F.col("custom_title").isNotNull())).alias("name"),
        F.max_by("model", _where(assistant & F.col("model").isNotNull())).alias("model"),
        F.max_by("effort", _where(assistant & F.col("effort").isNotNull())).alias("effort"),
        F.max_by("cwd", _where(user & F.col("cwd").isNotNull())).alias("cwd"),
        F.min_by("branch", _where(user)).alias("git_branch"),
        earliest.alias("first_user"),
        F.count_if(user | assistant).alias("messages"),
        F.sum(F.when(user, F.col("error_blocks")).otherwise(0) + F.when(F.col("api_error"), 1).otherwise(0)).alias("errors"),
        F.sum(F.when(assistant, F.col("output_tokens")).otherwise(0)).alias("tokens"),
        F.count_if("sidechain").alias("sidechain_records"),
        F.max("size_bytes").alias("size_bytes"),
    )
    return summary.select(
        "provider",
        "project",
        "session_id",
        KEY,
        F.coalesce("cwd", blank).alias("cwd"),
        F.coalesce("started", blank).alias("started"),
        F.coalesce("ended", blank).alias("ended"),
        F.coalesce(F.nullif("title", blank), "first_user", blank).alias("title"),
        F.coalesce("name", blank).alias("name"),
        blank.alias("kind"),
        F.coalesce("model", blank).alias("model"),
        "messages",
        "errors",
        "tokens",
        "size_bytes",
        F.coalesce("effort", blank).alias("effort"),
        F.coalesce("git_branch", blank).alias("git_branch"),
        "sidechain_records",
        F.coalesce("first_user", blank).alias("first_user"),
        blank.alias("originator"),
        blank.alias("cli_version"),
    )


def attribution(lines: DataFrame) -> DataFrame:
    """Records per session and skill."""
    skill = word(F.col("rec.attributionSkill"))
    named = readable(lines, "attributionSkill variant").where(truthy(F.col("rec.attributionSkill")))
    return _by_skill(named.withColumn("skill", skill))


def _by_skill(records: DataFrame) -> DataFrame:
    named = records.where(F.col("skill").isNotNull())
    return named.groupBy("provider", "project", "session_id", KEY, "skill").agg(F.count(F.lit(1)).alias("records"))


def _where(condition: Column) -> Column:
    """Record number where the condition holds, so that min_by and max_by skip the others."""
    return F.when(condition, F.col("seq"))


def _argument() -> Column:
    """What a tool call is about: its first known input key, else the whole input."""
    chain = F
    for key in ARGUMENT_KEYS:
        value = F.col(f"b.input.{key}")
        chain = chain.when(value.isNotNull(), word(value))
    return chain.otherwise(_block_json(".input"))


def _block_json(below: str) -> Column:
    """JSON text of the block, or of a part of it, with keys in source order."""
    path = F.concat(F.lit("$.message.content["), F.col("at").cast("string"), F.lit(f"]{below}"))
    return F.coalesce(spaced(F.call_function("get_json_object", F.make_valid_utf8("line"), path)), F.lit("{}"))
