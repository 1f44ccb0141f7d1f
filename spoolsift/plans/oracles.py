"""SQL over the same tables that gives what each registered query must give."""

from spoolsift.functions.secrets import TAG
from spoolsift.operators.detect import PASSWORD, PLACEHOLDER, RANDOM_TOKEN, URL_CREDENTIAL
from spoolsift.operators.rules import OWN_RULES
from spoolsift.plans.catalog import SALT

NOW = "TIMESTAMP '2024-01-30 23:55:00'"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _flat(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def _preview(text: str) -> str:
    flat = _flat(text)
    return (
        f"CASE WHEN length({flat}) > 200 THEN left({flat}, 200) || '... [+' || (length({flat}) - 200) || ' chars]' "
        f"ELSE {flat} END"
    )


def _live(ended: str) -> str:
    return f"abs(epoch_us(CAST({ended} AS TIMESTAMP)) - epoch_us({NOW})) < 600000000"


CHATS = """
c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn + 1 AS seq, text,
    CASE role WHEN 'assistant' THEN 'asst' WHEN 'system' THEN 'sys' ELSE 'user' END AS role,
    strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
  FROM conversations),
cs AS (SELECT session_id, min(ts) AS started, max(ts) AS ended,
    coalesce(arg_min(text, seq) FILTER (WHERE role = 'user'), '') AS title FROM c GROUP BY ALL)"""

USERS = """
a AS (SELECT *, CAST(user_id AS VARCHAR) AS session_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    event_type || ' ' || props || ' #' || event_id AS text, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp
  FROM events),
t AS (SELECT *, CASE WHEN event_type <> 'click' THEN '' WHEN k < 10 THEN 'Skill' WHEN k < 40 THEN 'Bash'
    WHEN k < 70 THEN 'Read' ELSE 'Edit' END AS own_tool FROM a),
u AS (SELECT 'p' || (user_id % 5) AS project, session_id, seq, stamp AS ts, text, own_tool AS tool, k,
    CASE WHEN event_type IN ('click', 'view') THEN 'asst' ELSE 'user' END AS role,
    CASE event_type WHEN 'click' THEN 'tool' WHEN 'view' THEN 'thinking' WHEN 'signup' THEN 'text'
      ELSE 'result' END AS kind,
    event_type = 'error' AS is_error, CASE WHEN event_type = 'signup' AND k < 10 THEN 'meta' ELSE '' END AS tag,
    CASE WHEN event_type IN ('click', 'purchase', 'error') THEN CAST(k AS VARCHAR) END AS call_id FROM t),
us AS (SELECT project, session_id, min(ts) AS started, max(ts) AS ended, count(*) AS messages,
    count(*) FILTER (WHERE is_error) AS errors,
    coalesce(arg_min(text, seq) FILTER (WHERE kind = 'text'), '') AS title FROM u GROUP BY ALL)"""


def _pairing(source: str, name: str) -> str:
    return f"""
{name}_calls AS (SELECT session_id, call_id, max(seq) AS last_call, arg_max(tool, seq) AS call_tool FROM {source}
    WHERE kind = 'tool' GROUP BY ALL),
{name}_results AS (SELECT session_id, call_id, arg_max(is_error, seq) AS failed FROM {source}
    WHERE kind = 'result' GROUP BY ALL),
{name} AS (SELECT e.* REPLACE (
    CASE WHEN e.kind = 'result' AND l.last_call IS NOT NULL THEN l.call_tool ELSE e.tool END AS tool,
    CASE WHEN e.kind = 'tool' AND e.seq = l.last_call AND r.failed IS NOT NULL
      THEN CASE WHEN r.failed THEN 'err' ELSE 'ok' END ELSE e.tag END AS tag)
  FROM {source} e LEFT JOIN {name}_calls l ON e.session_id = l.session_id AND e.call_id = l.call_id
    LEFT JOIN {name}_results r ON e.session_id = r.session_id AND e.call_id = r.call_id)"""


PAIRED = USERS + "," + _pairing("u", "p")

# Users as lines of the nested-message format.
NESTED = USERS + """,
n0 AS (SELECT * REPLACE (CASE WHEN kind = 'tool' AND k < 10 THEN 'skill-' || k
    WHEN kind = 'result' AND k % 2 = 1 THEN text || chr(10) || k ELSE text END AS text) FROM u),""" + _pairing("n0", "n")

# Users as lines of the payload format.
PAYLOAD = USERS + """,
x0 AS (SELECT session_id, user_id, seq + 1 AS seq, stamp AS ts, own_tool AS tool, '' AS tag,
    CASE WHEN event_type = 'click' OR (event_type = 'view' AND k >= 50) THEN 'asst'
      WHEN event_type = 'purchase' OR (event_type = 'error' AND k < 50) THEN 'user'
      WHEN event_type = 'view' OR (event_type = 'signup' AND k >= 40) THEN 'user'
      WHEN event_type = 'signup' AND k < 10 THEN 'ctx' ELSE 'meta' END AS role,
    CASE WHEN event_type = 'click' THEN 'tool'
      WHEN event_type = 'error' AND k >= 50 THEN 'event.exec_command_end'
      WHEN event_type IN ('purchase', 'error') THEN 'result'
      WHEN event_type = 'view' THEN CASE WHEN k < 50 THEN 'user_message' ELSE 'thinking' END
      WHEN k < 10 THEN 'turn_context' WHEN k < 40 THEN 'event.token_count' ELSE 'text' END AS kind,
    CASE WHEN event_type = 'signup' AND k < 10 THEN 'model-' || k || '/high'
      WHEN event_type = 'signup' AND k < 40 THEN '' ELSE text END AS text,
    event_type = 'error' AS is_error,
    CASE WHEN event_type IN ('click', 'purchase', 'error') THEN CAST(k AS VARCHAR) END AS call_id,
    k, event_id, event_type FROM t
  UNION ALL SELECT session_id, user_id, 1, stamp, '', '', 'meta', 'session_meta', '', false, NULL, NULL, NULL, NULL
    FROM t WHERE seq = 1),""" + _pairing("x0", "x")

_CODE = "md5(CAST(doc_id % 97 AS VARCHAR))"
_AWS, _GENERIC = OWN_RULES.rules[0].regex, OWN_RULES.rules[-1].regex
_SHAPES = (
    ("aws-access-token", "certain", _AWS, 1),
    ("password-assignment", "probable", "(?i)" + PASSWORD, 2),
    ("url-credential", "probable", URL_CREDENTIAL, 2),
    ("generic-api-key", "probable", _GENERIC, 1),
)
DOCS = f"""
d AS (SELECT source AS session_id, doc_id + 1 AS seq, text || chr(10) || 'key AKIA' ||
    substr(translate(upper({_CODE}), '0189', 'WXYZ'), 1, 16) || chr(10) || 'pwd=' || substr({_CODE}, 1, 12) || chr(10) ||
    'see https://bot:' || substr(md5('u' || doc_id), 1, 10) || '@db.example.com/x' || chr(10) || 'token ' ||
    upper(md5('t' || doc_id)) || 'xyz' AS text FROM documents)"""


def _entropy(value: str) -> str:
    share = f"(length({value}) - length(replace({value}, c, ''))) / length({value})"
    return f"list_sum(list_transform(list_distinct(string_split({value}, '')), lambda c: -({share}) * log2({share})))"


def _found(kind: str, severity: str, regex: str, group: int) -> str:
    """Matches of one shape with their place: the lengths of the gaps and matches before, and of the part before the value."""
    pattern = _quote(regex)
    return f"""SELECT session_id, seq, '{kind}' AS kind, '{severity}' AS severity, value,
    CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) +
      coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) +
      strpos(hits[i], value) - 1 AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i, unnest(vals) AS value
    FROM (SELECT session_id, seq, regexp_extract_all(text, {pattern}) AS hits,
      regexp_extract_all(text, {pattern}, {group}) AS vals, string_split_regex(text, {pattern}) AS gaps FROM d))"""


FINDINGS = DOCS + ",\nraw AS (" + " UNION ALL ".join(_found(*shape) for shape in _SHAPES) + f"""),
f AS (SELECT *, left(sha256({_quote(SALT)} || value), 8) AS fp FROM raw WHERE CASE kind
    WHEN 'aws-access-token' THEN {_entropy('value')} >= 3.0
    WHEN 'generic-api-key' THEN {_entropy('value')} >= 3.5
      AND NOT regexp_matches(lower(value), 'example|placeholder|redacted')
    ELSE NOT regexp_matches(value, {_quote('(?i)' + PLACEHOLDER)}) END)"""

_MARK = f"'[{TAG}:redacted:' || kind || ':' || fp || ']'"
MASKED = FINDINGS + f""",
v AS (SELECT DISTINCT session_id, seq, kind, value, {_MARK} AS mark FROM f),
r AS (SELECT d.session_id, d.seq, d.text, list(struct_pack(value := value, mark := mark, kind := kind))
    FILTER (WHERE value IS NOT NULL) AS vs FROM d LEFT JOIN v USING (session_id, seq) GROUP BY ALL),
m AS (SELECT session_id, seq, coalesce(list_reduce(list_prepend(struct_pack(value := '', mark := text, kind := ''), vs),
      lambda acc, x: struct_pack(value := '', mark := replace(acc.mark, x.value, x.mark), kind := '')).mark, text) AS text,
    CAST(coalesce(list_sum(list_transform(vs, lambda x:
      (length(text) - length(replace(text, x.value, ''))) // length(x.value))), 0) AS INTEGER) AS replacements,
    vs FROM r)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def _shown(condition: str, source: str = "u") -> str:
    return f"SELECT session_id, seq, role, kind, text FROM {source} WHERE {condition}"


def _hits(condition: str) -> str:
    return f"""SELECT c.session_id, left(c.session_id, 8) AS short_id, started, seq, role, {_preview('text')} AS preview
  FROM c JOIN cs ON c.session_id = cs.session_id WHERE {condition}"""


_THE = "contains(lower(text), 'the')"
_NEWEST = "started DESC, session_id DESC, seq"
_TABLE = f"""left(started, 10) AS started, {_live('ended')} AS live, left({_flat('title')}, 50) AS title"""
_LINE = f"""CASE kind WHEN 'tool' THEN tool || ' "' || {_preview('text')} || '"' ||
      CASE WHEN tag <> '' THEN ' -> ' || tag ELSE '' END
    WHEN 'result' THEN '(' || tool || CASE WHEN is_error THEN ', is_error)' ELSE ')' END || ' "' || {_flat('text')} || '"'
    ELSE CASE WHEN tag <> '' THEN '(' || tag || ') ' ELSE '' END || '"' || {_preview('text')} || '"' END"""

ORACLES: dict[str, str] = {
    "search_table": _with(
        CHATS,
        f"""SELECT session_id, left(session_id, 8) AS short_id, matches, first, {_TABLE} FROM cs JOIN
    (SELECT session_id, count(*) AS matches, min(seq) AS first FROM c WHERE regexp_matches(text, '(?i)th[aeiou]r')
      GROUP BY ALL) USING (session_id)""",
    ),
    "search_table_all": _with(
        CHATS,
        f"""SELECT session_id, left(session_id, 8) AS short_id, coalesce(matches, 0) AS matches,
    coalesce(first, 0) AS first, {_TABLE} FROM cs LEFT JOIN (SELECT session_id, count(*) AS matches, min(seq) AS first
      FROM c WHERE regexp_matches(text, '(?i)entre') GROUP BY ALL) USING (session_id)""",
    ),
    "search_repeated": _with(
        CHATS,
        f"""SELECT session_id, left(session_id, 8) AS short_id, matches, first, {_TABLE} FROM cs JOIN
    (SELECT session_id, count(*) AS matches, min(seq) AS first FROM c
      WHERE regexp_matches(text, '(?i)(th|an|er)+ing([^0-9a-z_à-öø-ÿ]|$)') GROUP BY ALL) USING (session_id)""",
    ),
    "line_report": """SELECT CAST(conv_id AS VARCHAR) AS path, count(*) AS lines,
    count(*) FILTER (WHERE (conv_id + turn) % 8 = 0) AS blank,
    count(*) FILTER (WHERE (conv_id + turn) % 8 BETWEEN 1 AND 4) AS unreadable FROM conversations GROUP BY conv_id""",
    "search_totals": _with(
        CHATS,
        """SELECT count(*) AS matches, count(DISTINCT session_id) AS sessions_matched,
    (SELECT count(*) FROM cs) AS sessions_scanned FROM c WHERE regexp_matches(text, '(?i)th[aeiou]r')""",
    ),
    "search_hits": _with(CHATS, _hits("regexp_matches(text, '(?i)th[aeiou]r')")),
    "search_literal": _with(CHATS, _hits("contains(text, 'The ')")),
    "search_budget": _with(
        CHATS,
        f"""SELECT session_id, short_id, started, seq, role, preview FROM (SELECT *,
    row_number() OVER (ORDER BY {_NEWEST}) AS place, sum(length(short_id) + length(printf('#%04d', seq)) +
      length(role) + length(preview) + 6) OVER (ORDER BY {_NEWEST} ROWS UNBOUNDED PRECEDING) AS used
    FROM ({_hits(_THE)})) WHERE place = 1 OR used <= 40000""",
    ),
    "search_capped": _with(CHATS, f"{_hits(_THE)} ORDER BY started DESC, c.session_id DESC, seq LIMIT 25"),
    "search_context": _with(
        CHATS,
        f"""SELECT session_id, hit_seq, pos, seq, is_hit, role, kind, event_line FROM (SELECT *,
    sum(cost) OVER (ORDER BY started DESC, session_id DESC, hit_seq) AS used,
    dense_rank() OVER (ORDER BY started DESC, session_id DESC, hit_seq) AS place FROM (SELECT h.session_id, started,
      h.seq AS hit_seq, c.seq AS pos, c.seq, c.seq = h.seq AS is_hit, c.role, 'text' AS kind,
      '"' || {_preview('c.text')} || '"' AS event_line, 15 + length(left(h.session_id, 8)) +
      length(printf('#%04d', c.seq)) + greatest(length(c.role), 5) + length('"' || {_preview('c.text')} || '"') +
      CASE WHEN c.seq = h.seq THEN 3 ELSE 0 END AS cost
      FROM c h JOIN cs ON h.session_id = cs.session_id JOIN c ON c.session_id = h.session_id
        AND c.seq BETWEEN h.seq - 2 AND h.seq + 2 WHERE regexp_matches(h.text, '(?i)entre')))
    WHERE place = 1 OR used <= 40000""",
    ),
    "search_context_all": _with(
        PAIRED,
        f"""SELECT p.session_id, h.seq AS hit_seq, p.seq AS pos, p.seq, p.seq = h.seq AS is_hit, role, kind,
    {_LINE} AS event_line FROM p JOIN (SELECT session_id AS hit_session, seq FROM p WHERE regexp_matches(text, '#.*77')) h
    ON p.session_id = hit_session AND p.seq BETWEEN h.seq - 1 AND h.seq + 1""",
    ),
    "search_context_merged": _with(
        PAIRED
        + """,
h AS (SELECT session_id AS hit_session, seq AS hit FROM p WHERE regexp_matches(text, '#.*77')),
near AS (SELECT p.*, EXISTS (SELECT 1 FROM h WHERE hit_session = p.session_id AND hit = p.seq) AS is_hit FROM p
  WHERE EXISTS (SELECT 1 FROM h WHERE hit_session = p.session_id AND p.seq BETWEEN hit - 2 AND hit + 2)),
begun AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY session_id ORDER BY seq) = 1 THEN 0 ELSE 1 END AS begins FROM near)""",
        f"""SELECT session_id, CAST(sum(begins) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS "group", seq AS pos, seq,
    is_hit, role, kind, {_LINE} AS event_line FROM begun""",
    ),
    "search_sessions": _with(
        CHATS,
        """SELECT DISTINCT session_id, left(session_id, 8) AS short_id FROM c
    WHERE regexp_matches(text, '(?i)th[aeiou]r')""",
    ),
    "pair_tool_calls": _with(
        PAIRED, "SELECT session_id, seq, kind, tool, tag, call_id, is_error FROM p WHERE kind IN ('tool', 'result')"
    ),
    "normalize_claude": _with(
        NESTED,
        """SELECT session_id, seq, 0 AS block, seq AS pos, ts, role, kind, text, tool, is_error, tag, call_id FROM n""",
    ),
    "normalize_turns": _with(
        CHATS,
        """SELECT session_id, seq, 0 AS block, ts, role, CASE role WHEN 'sys' THEN 'system.note' ELSE 'text' END AS kind,
    text FROM c""",
    ),
    "normalize_codex": _with(
        PAYLOAD,
        """SELECT session_id, seq, 0 AS block, seq AS pos, ts, role, kind, text, tool, is_error, tag, call_id FROM x""",
    ),
    "session_summary_claude": _with(
        USERS,
        """SELECT project, session_id, coalesce('/w/' || any_value(CAST(session_id AS BIGINT) % 5)
      FILTER (WHERE role = 'user'), '') AS cwd, min(ts) AS started, max(ts) AS ended,
    coalesce(arg_min(text, seq) FILTER (WHERE kind = 'text' AND tag = ''), '') AS title,
    coalesce('model-' || (arg_max(k, seq) FILTER (WHERE role = 'asst') % 3), '') AS model, count(*) AS messages,
    count(*) FILTER (WHERE is_error) AS errors, CAST(coalesce(sum(k) FILTER (WHERE role = 'asst'), 0) AS BIGINT) AS tokens,
    coalesce('branch-' || any_value(CAST(session_id AS BIGINT) % 4) FILTER (WHERE role = 'user'), '') AS git_branch
    FROM u GROUP BY project, session_id""",
    ),
    "session_summary_codex": _with(
        PAYLOAD,
        """SELECT session_id, '/w/' || (any_value(user_id) % 5) AS cwd, min(ts) AS started, max(ts) AS ended,
    coalesce(arg_min(text, seq) FILTER (WHERE kind = 'tool'), arg_min(text, seq) FILTER (WHERE kind = 'user_message'),
      '') AS title, 'exec' AS kind, coalesce(arg_max(text, seq) FILTER (WHERE kind = 'turn_context'), '') AS model,
    count(*) FILTER (WHERE kind = 'text') AS messages, count(DISTINCT call_id) FILTER (WHERE is_error) AS errors,
    coalesce(arg_max(event_id, seq) FILTER (WHERE kind = 'event.token_count' AND event_id <> 0), 0) AS tokens,
    'table' AS originator FROM x0 GROUP BY session_id""",
    ),
    "codex_scope": _with(
        PAYLOAD,
        """SELECT session_id, '/w/3' AS project, count(*) AS lines, max(seq) AS last_seq FROM x0 WHERE user_id % 5 = 3
    GROUP BY session_id""",
    ),
    "history_titles": _with(
        USERS,
        """SELECT session_id, arg_min(text, seq) AS history_title FROM u WHERE kind = 'tool' GROUP BY session_id""",
    ),
    "attribution": _with(
        USERS,
        """SELECT session_id, 'skill-' || k AS skill, count(*) AS records FROM u WHERE tool = 'Skill' GROUP BY ALL""",
    ),
    "handles": _with(
        USERS,
        f"""SELECT project, row_number() OVER (PARTITION BY project ORDER BY started DESC, session_id DESC) AS n,
    session_id, started, messages, errors, {_live('ended')} AS live, left({_flat('title')}, 80) AS title FROM us""",
    ),
    "resolve": _with(
        USERS,
        """SELECT project, arg, CASE total WHEN 0 THEN 'none' ELSE CASE WHEN low IS NULL AND total > 1 THEN 'several' ELSE 'one' END END AS state,
    total, n, session_id, left(regexp_replace(title, '\\s+', ' ', 'g'), 60) AS title FROM (
    SELECT r.project, r.arg, r.low, coalesce(count(f.n) OVER (PARTITION BY r.project, r.arg), 0) AS total, f.n, f.session_id, f.title,
      row_number() OVER (PARTITION BY r.project, r.arg ORDER BY f.n) AS place
    FROM (SELECT s.project, q.*, least(low, high) >= 1 AND high <= s.sessions AS inside
        FROM (SELECT project, count(*) AS sessions FROM us GROUP BY ALL) s,
        (VALUES (NULL, 1, 1), ('@2', 2, 2), ('@4:@2', 2, 4), ('@9999', 9999, 9999), ('7', NULL, NULL), ('1', NULL, NULL),
          ('#1', NULL, NULL), ('SIGNUP {"k": 5', NULL, NULL), ('not there', NULL, NULL)) q(arg, low, high)) r
    LEFT JOIN (SELECT *, min(tier) OVER (PARTITION BY project, arg) AS least_tier FROM (
        SELECT h.*, q.arg, CASE WHEN session_id = q.arg THEN 1 WHEN q.arg IN ('7', '1') AND starts_with(session_id, q.arg) THEN 2
            WHEN contains(lower(title), lower(q.arg)) THEN 3 END AS tier
        FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY started DESC, session_id DESC) AS n FROM us) h,
          (VALUES ('@'), ('7'), ('1'), ('#1'), ('SIGNUP {"k": 5'), ('not there')) q(arg))
        WHERE tier IS NOT NULL OR arg = '@') f
      ON f.project = r.project AND ((r.low IS NULL AND f.arg = r.arg AND f.tier = f.least_tier)
        OR (r.low IS NOT NULL AND f.arg = '@' AND r.inside AND f.n BETWEEN r.low AND r.high)))
    WHERE place <= 5 OR low IS NOT NULL""",
    ),
    "scope_window": _with(
        USERS,
        """SELECT project, row_number() OVER (PARTITION BY project ORDER BY started DESC, session_id DESC) AS n,
    session_id, started FROM us WHERE CAST(started AS TIMESTAMP) >= TIMESTAMP '2024-01-01 06:00:00'
      AND CAST(started AS TIMESTAMP) < TIMESTAMP '2024-01-02'""",
    ),
    "live_sessions": _with(USERS, f"SELECT session_id, ended, {_live('ended')} AS live FROM us"),
    "tool_counts": _with(
        PAIRED,
        """SELECT session_id, tool, count(*) AS calls, count(*) FILTER (WHERE tag = 'err') AS errors FROM p
    WHERE kind = 'tool' GROUP BY ALL""",
    ),
    "skill_inputs": _with(
        USERS, "SELECT session_id, 'skill-' || k AS skill, count(*) AS calls FROM u WHERE tool = 'Skill' GROUP BY ALL"
    ),
    "session_stats": _with(
        USERS
        + """,
s AS (SELECT session_id, min(ts) AS started, max(ts) AS ended,
    coalesce('model-' || (arg_max(k, seq) FILTER (WHERE role = 'asst') % 3), '') AS model,
    CAST(count(*) AS VARCHAR) AS messages, CAST(count(*) FILTER (WHERE is_error) AS VARCHAR) AS errors,
    CAST(coalesce(sum(k) FILTER (WHERE role = 'asst'), 0) AS VARCHAR) AS tokens,
    coalesce('branch-' || any_value(CAST(session_id AS BIGINT) % 4) FILTER (WHERE role = 'user'), '') AS git_branch,
    CAST(max(strlen(text)) AS VARCHAR) AS size,
    CAST(count(*) FILTER (WHERE tag = 'meta') AS VARCHAR) AS text_meta FROM u GROUP BY session_id)""",
        """SELECT session_id, 'provider' AS field, 'claude' AS value FROM s
    UNION ALL SELECT session_id, 'session', session_id FROM s UNION ALL SELECT session_id, 'file', session_id FROM s
    UNION ALL SELECT session_id, 'size', size FROM s
    UNION ALL SELECT session_id, 'started', started FROM s UNION ALL SELECT session_id, 'ended', ended FROM s
    UNION ALL SELECT session_id, 'model', model FROM s UNION ALL SELECT session_id, 'messages', messages FROM s
    UNION ALL SELECT session_id, 'errors', errors FROM s UNION ALL SELECT session_id, 'tokens', tokens FROM s
    UNION ALL SELECT session_id, 'git_branch', git_branch FROM s WHERE git_branch <> ''
    UNION ALL SELECT session_id, 'user.text_meta', text_meta FROM s
    UNION ALL SELECT session_id, 'interruption_markers', '0' FROM s
    UNION ALL SELECT session_id, 'records.' || kind, CAST(count(*) AS VARCHAR) FROM u GROUP BY session_id, kind
    UNION ALL SELECT session_id, 'attribution.skill-' || k, CAST(count(*) AS VARCHAR) FROM u WHERE tool = 'Skill'
      GROUP BY session_id, k""",
    ),
    "errors_dedup": _with(
        PAIRED,
        """SELECT session_id, call_id AS error_key, seq, CASE WHEN tool <> '' THEN tool ELSE kind END AS what, tag,
    text AS body FROM p WHERE is_error QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq) = 1""",
    ),
    "errors_capped": _with(
        PAIRED,
        """SELECT * FROM (SELECT session_id, call_id AS error_key, seq,
    CASE WHEN tool <> '' THEN tool ELSE kind END AS what FROM p WHERE is_error
    QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq) = 1)
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 3""",
    ),
    "errors_by_tool": _with(
        PAIRED,
        """SELECT what AS tool, count(*) AS errors FROM (SELECT CASE WHEN tool <> '' THEN tool ELSE kind END AS what FROM p
    WHERE is_error QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq) = 1) GROUP BY what""",
    ),
    "hidden_counts": _with(
        USERS,
        """SELECT session_id, count(*) FILTER (WHERE kind = 'thinking') AS thinking,
    count(*) FILTER (WHERE kind = 'result') AS results, CAST(0 AS BIGINT) AS others FROM u WHERE kind NOT IN ('text', 'tool')
    GROUP BY session_id""",
    ),
    "commands": _with(
        PAIRED,
        f"""SELECT session_id, seq, tool, {_preview('text')} AS command, CASE tag WHEN '' THEN '?' ELSE tag END AS state
    FROM p WHERE kind = 'tool' AND regexp_matches(text, '(?i)click.*7')""",
    ),
    "commands_capped": _with(
        PAIRED,
        f"""SELECT p.session_id, started, seq, tool, {_preview('text')} AS command,
    CASE tag WHEN '' THEN '?' ELSE tag END AS state FROM p JOIN us ON p.session_id = us.session_id WHERE kind = 'tool'
    ORDER BY started DESC, p.session_id DESC, seq LIMIT 50""",
    ),
    "prompts": _with(
        PAYLOAD,
        """SELECT session_id, seq, kind, text FROM x WHERE role = 'user' AND kind = CASE WHEN session_id IN
    (SELECT session_id FROM x WHERE kind = 'user_message') THEN 'user_message' ELSE 'text' END""",
    ),
    "prompts_capped": _with(
        PAYLOAD,
        """SELECT session_id, seq, kind, text FROM x WHERE role = 'user' AND kind = CASE WHEN session_id IN
    (SELECT session_id FROM x WHERE kind = 'user_message') THEN 'user_message' ELSE 'text' END
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 2""",
    ),
    "show_capped": _with(
        USERS,
        """SELECT session_id, seq, role, kind, text FROM (SELECT * FROM u WHERE kind IN ('text', 'tool')
      QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3)
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) <= 2""",
    ),
    "prompts_all": _with(USERS, "SELECT session_id, seq, kind, text FROM u WHERE role = 'user'"),
    "prompt_counts": _with(
        USERS,
        """SELECT session_id, count(*) FILTER (WHERE kind = 'text') AS shown,
    count(*) FILTER (WHERE kind <> 'text') AS left_out FROM u WHERE role = 'user' GROUP BY session_id""",
    ),
    "show_skeleton": _with(USERS, _shown("kind IN ('text', 'tool', 'thinking')")),
    "show_errors": _with(PAIRED, _shown("is_error OR tag = 'err'", "p")),
    "show_kind": _with(PAYLOAD, _shown("kind LIKE 'event.%'", "x")),
    "show_around": _with(CHATS, "SELECT session_id, seq, role, 'text' AS kind, text FROM c WHERE seq BETWEEN 3 AND 7"),
    "show_range": _with(CHATS, "SELECT session_id, seq, role, 'text' AS kind, text FROM c WHERE seq BETWEEN 2 AND 4"),
    "show_tail": _with(
        USERS,
        _shown("kind IN ('text', 'tool')")
        + " QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3",
    ),
    "trim_decision": _with(
        CHATS,
        "SELECT session_id, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) > 2500 AS trim FROM c GROUP BY session_id",
    ),
    "secret_candidates": _with(
        DOCS,
        f"""SELECT * FROM (SELECT session_id, seq, unnest(regexp_extract_all(text, {_quote(RANDOM_TOKEN)})) AS value FROM d)
    WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
      AND NOT regexp_full_match(value, '[0-9a-fA-F-]+') AND {_entropy('value')} >= 3.4""",
    ),
    "url_credentials": _with(
        DOCS,
        f"""SELECT * FROM (SELECT session_id, seq, unnest(regexp_extract_all(text, {_quote(URL_CREDENTIAL)}, 2)) AS value
    FROM d) WHERE NOT regexp_matches(value, {_quote('(?i)' + PLACEHOLDER)})""",
    ),
    "password_assignments": _with(
        DOCS,
        f"""SELECT * FROM (SELECT session_id, seq, unnest(regexp_extract_all(text, {_quote('(?i)' + PASSWORD)}, 2)) AS value
    FROM d) WHERE NOT regexp_matches(value, {_quote('(?i)' + PLACEHOLDER)})""",
    ),
    "secret_rules": _with(
        FINDINGS,
        'SELECT session_id, seq, kind, severity, start, start + length(value) AS "end", fp FROM f',
    ),
    "secret_audit": _with(
        FINDINGS,
        """SELECT kind, severity, fp, count(*) AS occurrences, count(DISTINCT session_id) AS sessions,
    min(session_id) AS first_session, arg_min(seq, struct_pack(a := session_id, b := seq)) AS first_seq FROM f
    GROUP BY ALL""",
    ),
    "redact_lines": _with(MASKED, "SELECT session_id, seq, replacements, text FROM m"),
    "redact_report": _with(
        MASKED
        + """,
k AS (SELECT session_id, x.kind AS kind, count(*) AS n FROM (SELECT session_id, unnest(vs) AS x FROM m) GROUP BY ALL)""",
        """SELECT session_id, lines, replacements, kinds FROM (SELECT session_id, count(*) AS lines,
      CAST(sum(replacements) AS BIGINT) AS replacements FROM m WHERE replacements > 0 GROUP BY session_id)
    JOIN (SELECT session_id, string_agg(kind || '(' || n || ')', ',' ORDER BY n DESC, kind) AS kinds FROM k
      GROUP BY session_id) USING (session_id)""",
    ),
    # Session 30 was written at six o'clock of the second day, five minutes before now.
    "clean_report": _with(
        MASKED
        + """,
c AS (SELECT 'docs' AS project, CAST((seq - 1) % 61 AS VARCHAR) AS session_id, replacements, vs FROM m WHERE (seq - 1) % 61 <> 30),
k AS (SELECT project, session_id, x.kind AS kind, count(*) AS n FROM (SELECT project, session_id, unnest(vs) AS x FROM c) GROUP BY ALL)""",
        """SELECT project, session_id, lines, replacements, kinds FROM (SELECT project, session_id, count(*) AS lines,
      CAST(sum(replacements) AS BIGINT) AS replacements FROM c WHERE replacements > 0 GROUP BY ALL)
    JOIN (SELECT project, session_id, string_agg(kind || '(' || n || ')', ',' ORDER BY n DESC, kind) AS kinds FROM k
      GROUP BY ALL) USING (project, session_id)""",
    ),
}
