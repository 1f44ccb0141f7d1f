"""The given tables read as transcripts.

``conversations``: a conversation is a session, a turn a record. ``events``: a
user is a session; clicks are tool calls, purchases and errors their results
(matched on ``props.k``), views thoughts, sign-ups typed texts. ``documents``:
a source is a session, a document a record, with credentials added to its text
that are computed from its id. Each comes as events, or as JSON lines of one of
the two record formats for the jobs that start from lines.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.model import KEY
from spoolsift.operators.slabs import running
from spoolsift.sources.store import spread

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_events(df: DataFrame, **columns: Column) -> DataFrame:
    """Event columns, those not given being empty."""
    blank = F.lit("")
    full = {
        "provider": F.lit("claude"),
        "project": blank,
        "session_id": blank,
        KEY: F.col("session_id"),
        "seq": F.col("seq"),
        "block": F.lit(0),
        "pos": F.col("seq"),
        "ts": blank,
        "role": blank,
        "kind": F.lit("text"),
        "text": F.col("text"),
        "tool": blank,
        "is_error": F.lit(False),
        "tag": blank,
        "call_id": F.lit(None).cast("string"),
        "line": F.lit(None).cast("string"),
    } | columns
    return df.select(*[expr.alias(name) for name, expr in full.items()])


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text events; conversation n starts n hours into 2024, a turn takes a minute."""
    turns = _table(spark, sf_dir, "conversations").withColumn("session_id", F.col("conv_id").cast("string"))
    role = F.when(F.col("role") == "assistant", "asst").when(F.col("role") == "system", "sys").otherwise("user")
    seq = F.col("turn") + 1
    return _as_events(
        turns,
        project=F.lit("chats"),
        session_id=F.col("session_id"),
        seq=seq,
        pos=seq,
        ts=_turn_stamp(),
        role=role,
    )


def _turn_stamp() -> Column:
    seconds = F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def conversation_sessions(events: DataFrame) -> DataFrame:
    """Session rows of the conversations."""
    return simple_sessions(events, F.col("role") == "user")


def simple_sessions(events: DataFrame, titled: Column) -> DataFrame:
    """Session rows from events: start, end and the first text that can be a title."""
    rows = events.groupBy("provider", "project", "session_id", KEY).agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.coalesce(F.min_by(F.when(titled, F.col("text")), F.when(titled, F.col("seq"))), F.lit("")).alias("title"),
        F.count(F.lit(1)).alias("messages"),
        F.count_if("is_error").alias("errors"),
        F.sum(F.length("text")).alias("size_bytes"),
    )
    blank = F.lit("")
    return rows.withColumns(
        {
            "cwd": blank,
            "name": blank,
            "kind": blank,
            "model": blank,
            "tokens": F.lit(0).cast("bigint"),
            "effort": blank,
            "git_branch": blank,
            "sidechain_records": F.lit(0).cast("bigint"),
            "first_user": F.col("title"),
            "originator": blank,
            "cli_version": blank,
        }
    )


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of the nested-message format: plain text by users, a block list by the assistant."""
    turns = _table(spark, sf_dir, "conversations")
    user = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    reply = F.struct(F.lit("assistant").alias("role"), blocks.alias("content"))
    line = (
        F.when(
            F.col("role") == "user",
            F.to_json(F.struct(F.lit("user").alias("type"), _turn_stamp().alias("timestamp"), user.alias("message"))),
        )
        .when(
            F.col("role") == "assistant",
            F.to_json(
                F.struct(F.lit("assistant").alias("type"), _turn_stamp().alias("timestamp"), reply.alias("message"))
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.lit("system").alias("type"),
                    F.lit("note").alias("subtype"),
                    _turn_stamp().alias("timestamp"),
                    F.col("text").alias("content"),
                )
            )
        )
    )
    return _as_lines(turns, "claude", F.lit("chats"), F.col("conv_id").cast("string"), F.col("turn") + 1, line)


def uneven_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of which some are blank, some no single JSON object, and some sound but for what is around them."""
    turns = _table(spark, sf_dir, "conversations")
    sound = F.to_json(F.struct(F.lit("user").alias("type"), F.coalesce("text", F.lit("")).alias("content")))
    forms = (
        F.lit(" \t "),
        F.concat(sound, sound),
        F.concat(sound, F.lit(" junk }")),
        F.lit("{'type': 'user'}"),
        F.concat(sound, F.lit(", "), sound),
        F.concat(sound, F.lit("\x0b")),
        F.concat(F.lit("\u2003"), sound, F.lit("\x1c")),
        sound,
    )
    form = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(forms)))
    return turns.select(
        F.col("conv_id").cast("string").alias(KEY),
        F.col("turn").alias("seq"),
        F.get(F.array(*forms), form.cast("int")).alias("line"),
    )


def _as_lines(df: DataFrame, provider: str, project: Column, sid: Column, seq: Column, line: Column) -> DataFrame:
    return df.select(
        F.lit(provider).alias("provider"),
        project.alias("project"),
        sid.alias("session_id"),
        sid.alias(KEY),
        seq.cast("bigint").alias("seq"),
        line.alias("line"),
        # By the text if there is one, as engines write JSON with other spacing.
        F.octet_length("text" if "text" in df.columns else line).cast("bigint").alias("size_bytes"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table numbered by time within each user, with its key and a text."""
    rows = _table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat("event_type", F.lit(" "), "props", F.lit(" #"), F.col("event_id").cast("string")).alias("text"),
        F.date_format("ts", STAMP).alias("stamp"),
    )
    hour = {"_hour": (F.date_trunc("hour", "ts"), False)}
    return running(rows, ["user_id"], hour, [F.col("ts"), F.col("event_id")], "seq")


def _tool() -> Column:
    k = F.col("k")
    return F.when(k < 10, "Skill").when(k < 40, "Bash").when(k < 70, "Read").otherwise("Edit")


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions; calls and results are not paired yet."""
    rows = activity(spark, sf_dir).withColumn("session_id", F.col("user_id").cast("string"))
    kind, is_call = F.col("event_type"), F.col("event_type") == "click"
    is_result = kind.isin("purchase", "error")
    return _as_events(
        rows,
        project=F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")),
        session_id=F.col("session_id"),
        ts=F.col("stamp"),
        role=F.when(is_call | (kind == "view"), "asst").otherwise("user"),
        kind=F.when(is_call, "tool").when(is_result, "result").when(kind == "view", "thinking").otherwise("text"),
        tool=F.when(is_call, _tool()).otherwise(""),
        is_error=kind == "error",
        tag=F.when((kind == "signup") & (F.col("k") < 10), "meta").otherwise(""),
        call_id=F.when(is_call | is_result, F.col("k").cast("string")),
    )


def activity_sessions(events: DataFrame) -> DataFrame:
    """Session rows of the users; the first typed text is the title."""
    return simple_sessions(events, (F.col("role") == "user") & (F.col("kind") == "text"))


def activity_lines_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions of the nested-message format."""
    kind, k, text = F.col("event_type"), F.col("k"), F.col("text")
    key = k.cast("string")

    def record(kind_name: str, message: Column, *extra: Column) -> Column:
        fields = [F.lit(kind_name).alias("type"), F.col("stamp").alias("timestamp"), *extra, message.alias("message")]
        return F.to_json(F.struct(*fields))

    def reply(block: Column) -> Column:
        return F.struct(
            F.concat(F.lit("model-"), (k % 3).cast("string")).alias("model"),
            F.struct(k.alias("output_tokens")).alias("usage"),
            F.array(block).alias("content"),
        )

    user_fields = (
        F.concat(F.lit("/w/"), (F.col("user_id") % 5).cast("string")).alias("cwd"),
        F.concat(F.lit("branch-"), (F.col("user_id") % 4).cast("string")).alias("gitBranch"),
    )
    skill = F.when(k < 10, F.concat(F.lit("skill-"), key))
    call = F.struct(
        F.lit("tool_use").alias("type"),
        key.alias("id"),
        _tool().alias("name"),
        F.struct(skill.alias("skill"), F.when(skill.isNull(), text).alias("command")).alias("input"),
    )
    parts = F.array(F.struct(text.alias("text")), F.struct(key.alias("text")))

    def answer(content: Column) -> Column:
        block = F.struct(
            F.lit("tool_result").alias("type"),
            key.alias("tool_use_id"),
            (kind == "error").alias("is_error"),
            content.alias("content"),
        )
        return F.struct(F.array(block).alias("content"))

    thought = F.struct(F.lit("thinking").alias("type"), text.alias("thinking"))
    line = (
        F.when(kind == "click", record("assistant", reply(call), skill.alias("attributionSkill")))
        .when(kind == "view", record("assistant", reply(thought)))
        .when(
            kind.isin("purchase", "error"),
            F.when(k % 2 == 0, record("user", answer(text), *user_fields)).otherwise(
                record("user", answer(parts), *user_fields)
            ),
        )
        .otherwise(
            record("user", F.struct(text.alias("content")), *user_fields, F.when(k < 10, True).alias("isMeta"))
        )
    )
    project = F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))
    sid = F.col("user_id").cast("string")
    return _as_lines(activity(spark, sf_dir), "claude", project, sid, F.col("seq"), line)


def activity_lines_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as rollouts of the payload format; line one describes the session."""
    rows = activity(spark, sf_dir)
    kind, k, text = F.col("event_type"), F.col("k"), F.col("text")
    key = k.cast("string")

    def record(kind_name: str, *payload: Column) -> Column:
        return F.to_json(
            F.struct(
                F.col("stamp").alias("timestamp"), F.lit(kind_name).alias("type"), F.struct(*payload).alias("payload")
            )
        )

    def item(name: str, *payload: Column) -> Column:
        return record("response_item", F.lit(name).alias("type"), *payload)

    def event(name: str, *payload: Column) -> Column:
        return record("event_msg", F.lit(name).alias("type"), *payload)

    part = F.array(F.struct(text.alias("text")))
    exit_code = F.when(kind == "error", k + 1).otherwise(F.lit(0))
    output = F.to_json(
        F.struct(text.alias("output"), F.struct(exit_code.alias("exit_code")).alias("metadata"))
    )
    call = item("function_call", _tool().alias("name"), text.alias("arguments"), key.alias("call_id"))
    result = item("function_call_output", key.alias("call_id"), output.alias("output"))
    ended = event(
        "exec_command_end", key.alias("call_id"), exit_code.alias("exit_code"), text.alias("stderr")
    )
    total = F.struct(F.struct(F.col("event_id").alias("total_tokens")).alias("total_token_usage"))
    line = (
        F.when(kind == "click", call)
        .when((kind == "error") & (k >= 50), ended)
        .when(kind.isin("purchase", "error"), result)
        .when((kind == "view") & (k < 50), event("user_message", text.alias("message")))
        .when(kind == "view", item("reasoning", part.alias("summary")))
        .when(k < 10, record("turn_context", F.concat(F.lit("model-"), key).alias("model"), F.lit("high").alias("effort")))
        .when(k < 40, event("token_count", total.alias("info")))
        .otherwise(item("message", F.lit("user").alias("role"), part.alias("content")))
    )
    sid = F.col("user_id").cast("string")
    cwd = F.concat(F.lit("/w/"), (F.col("user_id") % 5).cast("string"))
    head = F.to_json(
        F.struct(
            F.col("stamp").alias("timestamp"),
            F.lit("session_meta").alias("type"),
            F.struct(
                sid.alias("session_id"),
                cwd.alias("cwd"),
                F.lit("table").alias("originator"),
                F.lit("exec").alias("source"),
                F.lit("1.0").alias("cli_version"),
            ).alias("payload"),
        )
    )
    own = F.struct((F.col("seq") + 1).alias("at"), line.alias("line"))
    described = F.array(F.struct(F.lit(1).cast("bigint").alias("at"), head.alias("line")), own)
    made = rows.withColumn("made", F.when(F.col("seq") == 1, described).otherwise(F.array(own)))
    made = made.select("user_id", F.explode_outer("made").alias("made"))
    return _as_lines(made, "codex", cwd, sid, F.col("made.at"), F.col("made.line"))


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history file: every click of a user as an entry, in time order."""
    clicks = activity(spark, sf_dir).where(F.col("event_type") == "click")
    entry = F.to_json(F.struct(F.col("user_id").cast("string").alias("session_id"), "text"))
    return clicks.select("seq", entry.alias("line"))


def credential_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents followed by a key, a password and a URL password computed from the id: ``session_id, seq, text``."""
    code = F.md5((F.col("doc_id") % 97).cast("string"))
    key = F.concat(F.lit("AKIA"), F.substring(F.translate(F.upper(code), "0189", "WXYZ"), 1, 16))
    added = F.concat(
        F.lit("\nkey "),
        key,
        F.lit("\npwd="),
        F.substring(code, 1, 12),
        F.lit("\nsee https://bot:"),
        F.substring(F.md5(F.concat(F.lit("u"), F.col("doc_id").cast("string"))), 1, 10),
        F.lit("@db.example.com/x\ntoken "),
        F.upper(F.md5(F.concat(F.lit("t"), F.col("doc_id").cast("string")))),
        F.lit("xyz"),
    )
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("source").alias("session_id"), (F.col("doc_id") + 1).alias("seq"), F.concat("text", added).alias("text")
    )


def credential_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as lines of the nested-message format."""
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    line = F.to_json(F.struct(F.lit("user").alias("type"), message.alias("message")))
    return _as_lines(
        credential_documents(spark, sf_dir), "claude", F.lit("docs"), F.col("session_id"), F.col("seq"), line
    )


def dated_credential_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dealt to 61 sessions, of which session n was written n hours into 2024."""
    number = (F.col("seq") - 1) % 61
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + number * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    line = F.to_json(F.struct(F.lit("user").alias("type"), stamp.alias("timestamp"), message.alias("message")))
    return _as_lines(credential_documents(spark, sf_dir), "claude", F.lit("docs"), number.cast("string"), F.col("seq"), line)
