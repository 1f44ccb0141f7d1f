"""The registered queries: every job run over the given tables."""

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolsift.operators import claude, clean, codex, detect, redact, scope, search, views
from spoolsift.operators.events import pair_tools, ready_events
from spoolsift.session import prepare
from spoolsift.sources import codex as codex_source
from spoolsift.sources import lines as line_source
from spoolsift.sources import tables
from spoolsift.sources.store import kept

NOW = datetime(2024, 1, 30, 23, 55, tzinfo=UTC)
SALT = "a salt for the checks"
WORD = "th[aeiou]r"
RESOLVED = (None, "@2", "@4:@2", "@9999", "7", "1", "#1", 'SIGNUP {"k": 5', "not there")

Query = Callable[[SparkSession, str], DataFrame]


def _chats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = tables.conversation_events(prepare(spark), sf_dir)
    return events, tables.conversation_sessions(events)


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = tables.activity_events(prepare(spark), sf_dir)
    return events, tables.activity_sessions(events)


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired events; the numbered ones are kept, as pairing and what follows read them several times."""
    return pair_tools(kept(tables.activity_events(prepare(spark), sf_dir), "activity"))


def _paired_users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = kept(tables.activity_events(prepare(spark), sf_dir), "activity")
    return pair_tools(events), tables.activity_sessions(events)


def _secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.credential_documents(prepare(spark), sf_dir)


def search_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions ranked by matching turns."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_table(events, sessions, WORD, NOW)


def search_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the sessions that do not match."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_table(events, sessions, "entre", NOW, include_all=True, sort="started")


def search_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that repeats a group without end, and so is Python's."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_table(events, sessions, r"(?:th|an|er)+ing\b", NOW)


def line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file that are blank or hold no record."""
    return line_source.line_report(tables.uneven_lines(prepare(spark), sf_dir))


def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and matching sessions before any cap."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_totals(events, sessions, WORD)


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every matching turn with its preview."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_hits(events, sessions, WORD, limit=0).drop("block")


def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold a fixed text in exactly this case."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_hits(events, sessions, "The ", fixed=True, limit=0).drop("block")


def search_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching turns until 40,000 characters are printed."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_hits(events, sessions, "the", fixed=True).drop("block")


def search_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 matching turns."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_hits(events, sessions, "the", fixed=True, limit=25).drop("block")


def search_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching turns with two turns before and after, within the budget."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_context(events, sessions, "entre", 2).drop("hit_block")


def search_context_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a budget, over calls, results and thoughts."""
    events, sessions = _paired_users(spark, sf_dir)
    return search.search_context(events, sessions, "#.*77", 1, limit=0).drop("hit_block")


def search_context_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with windows that overlap or touch joined, so that each event comes once."""
    events, sessions = _paired_users(spark, sf_dir)
    found = search.search_context_merged(events, sessions, "#.*77", 2)
    return found.select("session_id", "group", "pos", "seq", "is_hit", "role", "kind", "event_line")


def search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of sessions with a match."""
    events, sessions = _chats(spark, sf_dir)
    return search.search_sessions(events, sessions, WORD)


def pair_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with ok or err, results with their tool."""
    return _paired(spark, sf_dir).where(F.col("kind").isin("tool", "result")).select(
        "session_id", "seq", "kind", "tool", "tag", "call_id", "is_error"
    )


def normalize_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' lines of the nested-message format as numbered, paired events."""
    lines = tables.activity_lines_claude(prepare(spark), sf_dir)
    return ready_events(claude.claude_events(lines)).select(
        "session_id", "seq", "block", "pos", "ts", "role", "kind", "text", "tool", "is_error", "tag", "call_id"
    )


def normalize_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' lines of the nested-message format as events."""
    lines = tables.conversation_lines(prepare(spark), sf_dir)
    return claude.claude_events(lines).select("session_id", "seq", "block", "ts", "role", "kind", "text")


def normalize_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' lines of the payload format as numbered, paired events."""
    lines = tables.activity_lines_codex(prepare(spark), sf_dir)
    return ready_events(codex.codex_events(lines)).select(
        "session_id", "seq", "block", "pos", "ts", "role", "kind", "text", "tool", "is_error", "tag", "call_id"
    )


def session_summary_claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session summaries of the nested-message format."""
    lines = tables.activity_lines_claude(prepare(spark), sf_dir)
    return claude.claude_sessions(lines).select(
        "project", "session_id", "cwd", "started", "ended", "title", "model", "messages", "errors", "tokens", "git_branch"
    )


def session_summary_codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session summaries of the payload format, titled from the history."""
    lines = tables.activity_lines_codex(prepare(spark), sf_dir)
    titles = codex_source.first_titles(tables.history_lines(spark, sf_dir))
    return codex.codex_sessions(lines, titles).select(
        "session_id", "cwd", "started", "ended", "title", "kind", "model", "messages", "errors", "tokens", "originator"
    )


def codex_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per rollout recorded for one working directory."""
    lines = tables.activity_lines_codex(prepare(spark), sf_dir)
    kept = codex_source.in_scope(lines, "/w/3")
    return kept.groupBy("session_id", "project").agg(F.count(F.lit(1)).alias("lines"), F.max("seq").alias("last_seq"))


def history_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First history entry per session."""
    return codex_source.first_titles(tables.history_lines(prepare(spark), sf_dir))


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per session and skill."""
    lines = tables.activity_lines_claude(prepare(spark), sf_dir)
    return claude.attribution(lines).select("session_id", "skill", "records")


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions numbered from the newest within each project."""
    _, sessions = _users(spark, sf_dir)
    return scope.session_list(scope.handles(sessions), NOW).select(
        "project", "n", "session_id", "started", "messages", "errors", "live", "title"
    )


def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What handles, ids, beginnings of ids and parts of titles name in each project."""
    _, sessions = _users(spark, sf_dir)
    found = scope.resolve_each(kept(scope.handles(sessions), "numbered"), RESOLVED)
    return found.select("project", "arg", "state", "total", "n", "session_id", "title")


def scope_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions started in a time window, numbered afresh."""
    _, sessions = _users(spark, sf_dir)
    kept = scope.in_window(sessions, since="2024-01-01T06:00:00Z", before="2024-01-02")
    return scope.handles(kept).select("project", "n", "session_id", "started")


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and whether they are still written."""
    _, sessions = _users(spark, sf_dir)
    return scope.live_sessions(sessions, NOW).select("session_id", "ended", "live")


def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and failures per session and tool."""
    return views.tool_counts(_paired(spark, sf_dir))


def skill_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill calls by the skill asked for, read from the lines."""
    lines = tables.activity_lines_claude(prepare(spark), sf_dir)
    return views.skill_inputs(claude.skill_of(claude.claude_events(lines)))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a session in long form."""
    records = kept(claude.claude_records(tables.activity_lines_claude(prepare(spark), sf_dir)), "records")
    return views.session_stats(claude.events_of(records), claude.sessions_of(records), claude.attribution_of(records))


def errors_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First error of every call."""
    rows = views.error_records(_paired(spark, sf_dir))
    return rows.select("session_id", "error_key", "seq", "what", "tag", "body")


def errors_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of them per session."""
    rows = views.error_records(_paired(spark, sf_dir), limit=3)
    return rows.select("session_id", "error_key", "seq", "what")


def errors_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records by tool."""
    events, sessions = _paired_users(spark, sf_dir)
    return views.errors_by_tool(events, sessions)


def hidden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events the skeleton leaves out."""
    return views.hidden_counts(_users(spark, sf_dir)[0])


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls that match a pattern, with their state."""
    events, sessions = _paired_users(spark, sf_dir)
    return views.commands(events, sessions, "click.*7").select(
        "session_id", "seq", "tool", "command", "state"
    )


def commands_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 tool calls of the scope."""
    events, sessions = _paired_users(spark, sf_dir)
    return views.commands(events, sessions, limit=50).select(
        "session_id", "started", "seq", "tool", "command", "state"
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users wrote in rollouts that may or may not have message records."""
    lines = tables.activity_lines_codex(prepare(spark), sf_dir)
    return views.prompts(codex.codex_events(lines)).select("session_id", "seq", "kind", "text")


def prompts_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two prompts of every session."""
    lines = tables.activity_lines_codex(prepare(spark), sf_dir)
    return views.prompts(codex.codex_events(lines), limit=2).select("session_id", "seq", "kind", "text")


def show_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of the last three selected events."""
    return _shown(views.show(_users(spark, sf_dir)[0], views.Selection(tail=3), limit=2))


def prompts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a user."""
    events, _ = _users(spark, sf_dir)
    return views.prompts(events, include_all=True).select("session_id", "seq", "kind", "text")


def prompt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User records shown and left out."""
    return views.prompt_counts(_users(spark, sf_dir)[0])


def _shown(events: DataFrame) -> DataFrame:
    return events.select("session_id", "seq", "role", "kind", "text")


def show_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, calls and thoughts."""
    return _shown(views.show(_users(spark, sf_dir)[0], views.Selection(thinking=True)))


def show_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed results and the calls they answer."""
    return _shown(views.show(_paired(spark, sf_dir), views.Selection(errors=True)))


def show_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a kind and its sub-kinds."""
    lines = tables.activity_lines_codex(prepare(spark), sf_dir)
    return _shown(views.show(codex.codex_events(lines), views.Selection(kind="event")))


def show_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns around a record."""
    return _shown(views.show(_chats(spark, sf_dir)[0], views.Selection(around=5, context=2)))


def show_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a range of records."""
    return _shown(views.show(_chats(spark, sf_dir)[0], views.Selection(span="2-4")))


def show_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three of the selected events."""
    return _shown(views.show(_users(spark, sf_dir)[0], views.Selection(tail=3)))


def trim_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sessions are too long to be shown whole."""
    return views.trim_decision(_chats(spark, sf_dir)[0], budget=2500)


def secret_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-looking tokens."""
    return detect.random_tokens(_secret_texts(spark, sf_dir), "text")


def url_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passwords in URLs."""
    return detect.url_credentials(_secret_texts(spark, sf_dir), "text")


def password_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values assigned to a password name."""
    return detect.password_assignments(_secret_texts(spark, sf_dir), "text")


def secret_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in the documents, as spans and fingerprints."""
    return detect.scan_table(_secret_texts(spark, sf_dir), "text", SALT)


def secret_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per secret over all lines."""
    lines = tables.credential_lines(prepare(spark), sf_dir)
    return detect.audit(redact.line_audit_rows(lines, SALT))


def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with secrets masked, shown by the text they hold."""
    lines = redact.redact_lines(tables.credential_lines(prepare(spark), sf_dir), SALT)
    return lines.select(
        "session_id", "seq", "replacements", F.get_json_object("line", "$.message.content").alias("text")
    )


def redact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masking changes per file."""
    lines = redact.redact_lines(tables.credential_lines(prepare(spark), sf_dir), SALT)
    return redact.redaction_report(lines).select("session_id", "lines", "replacements", "kinds")


def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean job would change per file, sessions that are still written left out."""
    lines = kept(tables.dated_credential_lines(prepare(spark), sf_dir), "lines")
    found = clean.scan(lines, claude.claude_sessions(lines), SALT, datetime(2024, 1, 2, 6, 5, tzinfo=UTC))
    return found.report.select("project", "session_id", "lines", "replacements", "kinds")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        search_table,
        search_table_all,
        search_repeated,
        line_report,
        search_totals,
        search_hits,
        search_literal,
        search_budget,
        search_capped,
        search_context,
        search_context_all,
        search_context_merged,
        search_sessions,
        pair_tool_calls,
        normalize_claude,
        normalize_turns,
        normalize_codex,
        session_summary_claude,
        session_summary_codex,
        codex_scope,
        history_titles,
        attribution,
        handles,
        resolve,
        scope_window,
        live_sessions,
        tool_counts,
        skill_inputs,
        session_stats,
        errors_dedup,
        errors_capped,
        errors_by_tool,
        hidden_counts,
        commands,
        commands_capped,
        prompts,
        prompts_all,
        prompts_capped,
        show_capped,
        prompt_counts,
        show_skeleton,
        show_errors,
        show_kind,
        show_around,
        show_range,
        show_tail,
        trim_decision,
        secret_candidates,
        url_credentials,
        password_assignments,
        secret_rules,
        secret_audit,
        redact_lines,
        redact_report,
        clean_report,
    )
}
