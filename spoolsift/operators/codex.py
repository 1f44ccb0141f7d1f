"""Records of the payload format to events and session summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolsift.functions.values import (
    first_truthy,
    get,
    has,
    is_object,
    is_string,
    spaced,
    string_or_parts,
    text_at,
    truthy,
    word,
)
from spoolsift.model import EVENT_COLUMNS, KEY
from spoolsift.sources.lines import readable

# Payload types by what they become.
MESSAGES = ("message", "agent_message")
CALLS = ("function_call", "custom_tool_call", "tool_search_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")
ENDS = ("exec_command_end", "patch_apply_end", "mcp_tool_call_end")


def codex_events(lines: DataFrame) -> DataFrame:
    """Exactly one event per record."""
    return _with_event(lines).select(*EVENT_COLUMNS)


# Fields of a record and of its payload; what may be of several types stays a variant.
_RECORD = "type string, timestamp string, payload variant"
_PAYLOAD = (
    "struct<type:string,role:variant,phase:variant,name:string,call_id:string,message:variant,model:variant,"
    "effort:variant,content:variant,summary:variant,arguments:variant,input:variant,action:variant,output:variant,"
    "exit_code:variant,stderr:variant,aggregated_output:variant,stdout:variant,success:variant,result:variant,"
    "invocation:variant>"
)


def _with_event(lines: DataFrame) -> DataFrame:
    records = readable(lines, _RECORD).select(
        "*",
        F.coalesce("rec.type", F.lit("")).alias("type"),
        F.coalesce("rec.timestamp", F.lit("")).alias("ts"),
        F.col("rec.payload").alias("payload"),
        get(F.col("rec.payload"), "$", _PAYLOAD).alias("part"),
    )
    output = F.col("part.output")
    inner = F.when(is_string(output), F.try_parse_json(F.try_variant_get(output, "$", "string"))).otherwise(output)
    records = records.withColumns({"inner": inner, "payload_type": F.coalesce("part.type", F.lit(""))})

    item, event = F.col("type") == "response_item", F.col("type") == "event_msg"
    context = F.col("type") == "turn_context"
    payload_type = F.col("payload_type")
    message = item & payload_type.isin(*MESSAGES)
    reasoning = item & (payload_type == "reasoning")
    call, search = item & payload_type.isin(*CALLS), item & (payload_type == "web_search_call")
    result = item & payload_type.isin(*OUTPUTS)
    end, said = event & payload_type.isin(*ENDS), event & (payload_type == "user_message")
    exec_end = payload_type == "exec_command_end"
    patch_end = payload_type == "patch_apply_end"

    def field(key: str) -> Column:
        return F.col(f"part.{key}")

    def as_json(key: str, absent: str) -> Column:
        raw = F.get_json_object(F.make_valid_utf8("line"), f"$.payload.{key}")
        quoted = F.when(is_string(field(key)), F.to_json(field(key))).otherwise(spaced(raw))
        return F.when(field(key).isNotNull(), F.coalesce(quoted, F.lit("null"))).otherwise(absent)

    def named(key: str) -> Column:
        return F.coalesce(word(field(key)), F.lit(""))

    role_word = F.coalesce(word(field("role")), F.lit("assistant"))
    talk_role = F.when(role_word == "user", "user").when(role_word == "assistant", "asst").otherwise("sys")
    failed_end = (
        F.when(exec_end, truthy(field("exit_code")))
        .when(patch_end, F.coalesce(F.to_json(field("success")) == "false", F.lit(False)))
        .otherwise(has(field("result"), "$.Err"))
    )
    end_text = (
        F.when(exec_end, first_truthy(field("stderr"), field("aggregated_output")))
        .when(patch_end, first_truthy(field("stderr"), field("stdout")))
        .otherwise(as_json("invocation", '""'))
    )
    model_text = F.concat(named("model"), F.lit("/"), named("effort"))
    output_text = (
        F.when(F.col("inner").isNull(), text_at(output, "$"))
        .when(is_object(F.col("inner")), F.coalesce(word(get(F.col("inner"), "$.output")), F.lit("")))
        .otherwise(string_or_parts(F.col("inner")))
    )
    return records.withColumns(
        {
            "block": F.lit(0),
            "role": F.when(message, talk_role)
            .when(reasoning | call | search, "asst")
            .when(result | said, "user")
            .when(context, "ctx")
            .otherwise("meta"),
            "kind": F.when(message, "text")
            .when(reasoning, "thinking")
            .when(call | search, "tool")
            .when(result, "result")
            .when(item, F.concat(F.lit("response."), payload_type))
            .when(said, "user_message")
            .when(event, F.concat(F.lit("event."), payload_type))
            .otherwise(F.col("type")),
            "text": F.when(message, string_or_parts(field("content")))
            .when(reasoning, string_or_parts(field("summary")))
            .when(call, first_truthy(field("arguments"), field("input")))
            .when(search, as_json("action", "{}"))
            .when(result, output_text)
            .when(said, named("message"))
            .when(end, end_text)
            .when(context, model_text)
            .otherwise(""),
            "tool": F.when(call, F.coalesce(field("name"), payload_type))
            .when(search, "web_search")
            .otherwise(""),
            "is_error": F.when(
                result, is_object(F.col("inner")) & truthy(get(F.col("inner"), "$.metadata.exit_code"))
            )
            .when(end, failed_end)
            .otherwise(F.lit(False)),
            "tag": F.when(message, first_truthy(field("phase"))).otherwise(""),
            "call_id": F.when(call | result | end, F.coalesce(field("call_id"), F.lit(""))),
        }
    )


def codex_sessions(lines: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One summary row per rollout; files whose first line is no session description give none.

    ``titles`` holds ``session_id, history_title`` and wins over the first user message.
    """
    payload = F.col("payload")
    source = get(payload, "$.source")
    head = (F.col("seq") == 1) & (F.col("type") == "session_meta")
    stem = F.regexp_extract(KEY, r"([^/]+)\.jsonl$", 1)
    rows = _with_event(lines).select(
        "provider",
        KEY,
        "seq",
        "size_bytes",
        "type",
        "payload_type",
        F.nullif("ts", F.lit("")).alias("ts"),
        "kind",
        "is_error",
        F.coalesce(F.nullif("call_id", F.lit("")), F.col("seq").cast("string")).alias("error_key"),
        F.when(F.col("kind") == "user_message", F.nullif("text", F.lit(""))).alias("typed"),
        F.when(F.col("type") == "turn_context", F.col("text")).alias("model"),
        F.when(
            (F.col("kind") == "event.token_count"), get(payload, "$.info.total_token_usage.total_tokens", "bigint")
        ).alias("total_tokens"),
        F.when(
            head,
            F.struct(
                F.coalesce(
                    F.nullif(first_truthy(get(payload, "$.session_id"), get(payload, "$.id")), F.lit("")), stem
                ).alias("session_id"),
                text_at(payload, "$.cwd").alias("cwd"),
                F.col("ts").alias("started"),
                F.when(is_string(source), text_at(source, "$"))
                .otherwise(first_truthy(get(payload, "$.thread_source")))
                .alias("kind"),
                text_at(payload, "$.originator").alias("originator"),
                text_at(payload, "$.cli_version").alias("cli_version"),
            ),
        ).alias("head"),
    )
    summary = rows.groupBy("provider", KEY).agg(
        F.max("head").alias("head"),
        F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq"))).alias("ended"),
        F.count_if((F.col("type") == "response_item") & F.col("payload_type").isin(*MESSAGES)).alias("messages"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"),
        F.max_by("total_tokens", F.when(F.col("total_tokens") != 0, F.col("seq"))).alias("tokens"),
        F.count_distinct(F.when(F.col("is_error"), F.col("error_key"))).alias("errors"),
        F.min_by("typed", F.when(F.col("typed").isNotNull(), F.col("seq"))).alias("first_user"),
        F.max("size_bytes").alias("size_bytes"),
    ).where(F.col("head").isNotNull())
    named = summary.withColumn("session_id", F.col("head.session_id"))
    if titles is None:
        named = named.withColumn("history_title", F.lit(None).cast("string"))
    else:
        named = named.join(titles, "session_id", "left")
    blank = F.lit("")
    return named.select(
        "provider",
        F.col("head.cwd").alias("project"),
        "session_id",
        KEY,
        "head.cwd",
        "head.started",
        F.coalesce("ended", blank).alias("ended"),
        F.coalesce(F.nullif("history_title", blank), "first_user", blank).alias("title"),
        blank.alias("name"),
        "head.kind",
        F.coalesce("model", blank).alias("model"),
        "messages",
        "errors",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "size_bytes",
        blank.alias("effort"),
        blank.alias("git_branch"),
        F.lit(0).cast("bigint").alias("sidechain_records"),
        F.coalesce("first_user", blank).alias("first_user"),
        "head.originator",
        "head.cli_version",
    )
