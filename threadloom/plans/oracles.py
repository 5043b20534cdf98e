"""The same results as DuckDB SQL, put together from common table expressions."""

from __future__ import annotations

from ..functions.patterns import PATTERNS, RE2_SAFE
from ..functions.text import FILE_NAME, PATH_LIKE, URL
from . import branches, strategy_queries


def _paths(t: str) -> str:
    every = f"list_filter(list_concat(regexp_extract_all({t}, '{PATH_LIKE}'), regexp_extract_all({t}, '{FILE_NAME}'), regexp_extract_all({t}, '{URL}')), lambda p: length(p) >= 4)"
    return f"list_filter({every}, lambda p, i: list_position({every}, p) = i)"


MESSAGES = r"""
e as (
  select user_id::varchar as conv_id, event_id, event_type, (props->>'k')::int as k,
    (row_number() over (partition by user_id order by ts, event_id) - 1)::int as idx,
    last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as call
  from events
), m as (
  select conv_id, idx, case
    when event_type = 'signup' and k % 7 = 0 then '{"role":"system","content":"You are careful."}'
    when event_type = 'signup' then '{"role":"user","content":"Please fix src/mod' || k || '/file' || (k % 5) || '.ts and keep the API stable"}'
    when event_type = 'view' then '{"role":"assistant","content":"Reading module ' || (k % 3) || ' of docs/guide.md"}'
    when event_type = 'click' then '{"role":"assistant","content":null,"tool_calls":[{"id":"c' || event_id || '","type":"function","function":{"name":"read_file","arguments":"{\"path\":\"src/a' || (k % 5) || '.py\"}"}}]}'
    when event_type = 'error' then '{"role":"tool","tool_call_id":"' || case when k % 2 = 0 then 'c' || coalesce(call, 0) else 'orphan' || event_id end || '","content":"line ' || k || '\nerror at step ' || (k % 4) || '"}'
    when k % 4 = 0 then '{"role":"assistant","content":"```\ncode ' || (k % 2) || '\n```"}'
    when k % 4 = 1 then '{"role":"assistant","content":"git push --force origin main"}'
    when k % 4 = 2 then '{"role":"assistant","content":"All good, step ' || (k % 3) || '"}'
    else '{"role":"assistant","content":"rm -rf /srv/data' || (k % 2) || '"}' end as message_json
  from e
)"""
FRAMES = MESSAGES + rf"""
, j as (
  select conv_id, idx, message_json, message_json->>'role' as role, message_json->>'content' as content, message_json->'tool_calls'->0 as tc, message_json->>'tool_call_id' as tid from m
), f as (
  select *, length(text)::int as chars, ceil(length(message_json) / 2.5)::int as tokens, sha1(role || chr(0) || text) as hash, contains(text, '```') as code, {_paths("text")} as paths from (
    select *, case role when 'tool' then 'tool_result' when 'assistant' then case when tc is null then 'assistant' else 'tool_call' end else role end as kind,
      case when tc is null then coalesce(content, '') else '[tool_call ' || (tc->'function'->>'name') || ' ' || (tc->>'id') || '] ' || (tc->'function'->>'arguments') end as text,
      case when tc is not null then [tc->>'id'] when tid is not null then [tid] else []::varchar[] end as ids,
      case when tc is not null then [tc->'function'->>'name'] else []::varchar[] end as names
    from j)
)"""
UNITS = FRAMES + """
, h as (
  select *, last_value(case when kind <> 'tool_result' then idx end ignore nulls) over w as hidx, last_value(case when kind <> 'tool_result' then kind end ignore nulls) over w as hkind,
    last_value(case when kind <> 'tool_result' then ids end ignore nulls) over w as hids
  from f window w as (partition by conv_id order by idx rows between unbounded preceding and current row)
), g as (
  select *, case when kind = 'tool_result' and hkind = 'tool_call' and list_has_any(ids, hids) then hidx else idx end as unit_head from h
), u0 as (
  select conv_id, unit_head, list(idx order by idx) as indices, sum(tokens)::int as tokens, bool_or(kind in ('tool_call', 'tool_result')) as is_tool, string_agg(text, chr(10) order by idx) as text,
    string_agg(hash, ',' order by idx) as unit_hash, first(role order by idx) as first_role, first(kind order by idx) as first_kind, bool_or(kind = 'system') as has_system, bool_or(code) as has_code,
    flatten(list(paths order by idx)) as paths, list(idx order by idx) filter (where role = 'assistant') as actions, flatten(list(names order by idx)) as names,
    string_agg(case when kind = 'tool_call' then regexp_replace(text, '^\\[(tool_call|tool_use) [^\\]\\n]*\\] ?', '', 'g') end, chr(10) order by idx) as input,
    string_agg(case when kind = 'tool_result' then text end, chr(10) order by idx) as result, bool_or(kind = 'tool_call') as has_call,
    flatten(list(case when kind = 'tool_call' then names end order by idx) filter (where kind = 'tool_call')) as call_names
  from g group by conv_id, unit_head
), u as (
  select *, (row_number() over (partition by conv_id order by unit_head) - 1)::int as unit_pos, 'u' || (row_number() over (partition by conv_id order by unit_head) - 1) as unit_id, count(*) over (partition by conv_id) as n_units from u0
)"""
GOALS = """
, gl as (select conv_id, coalesce(left(arg_max(text, idx) filter (where kind = 'user'), 500), '') as goal from f group by conv_id)"""
PRE = UNITS + GOALS + rf"""
, p0 as (
  select u.*, gl.goal, coalesce(list_filter(paths, lambda p: contains(lower(goal), lower(p)))[1], list_filter({_paths("goal")}, lambda p: contains(lower(text), lower(p)))[1]) as gp from u join gl using (conv_id)
), p1 as (
  select *, case when has_system then 'pinned:system' when unit_pos >= n_units - 2 then 'pinned:recent' when goal <> '' and gp is not null then 'pinned:goal-path ' || gp when has_code and unit_pos >= n_units - 6 then 'pinned:code' end as pin_reason from p0
), p2 as (
  select *, max(unit_pos) filter (where pin_reason is null) over (partition by conv_id, unit_hash) as last_same from p1
), pre as (
  select *, case when pin_reason is null and last_same <> unit_pos then 'duplicate of u' || last_same end as dup_reason, pin_reason is null and not (last_same <> unit_pos) as is_candidate from p2
)"""
_P = "case when unit_pos % 13 <> 5 then ((unit_pos * 37 + tokens * 11) % 101) / 100.0::double end"


def decided(name: str = "d", max_tokens: int = 900, min_keep: int = 2, threshold: float = 0.7, where: str = "true", p: str = _P, src: str = "pre") -> str:
    ok = "('kept', 'pinned', 'flagged')"
    return f"""
, {name}0 as (
  select *, case when is_candidate then {p} end as p_keep from {src} where {where}
), {name}1 as (
  select *, case when pin_reason is not null then 'pinned' when dup_reason is not null then 'duplicate' when p_keep is not null and 1 - p_keep >= {threshold} - 1e-9 then 'dropped' else 'kept' end as dec0,
    coalesce(pin_reason, dup_reason, case when p_keep is null then 'unjudged' end, case when 1 - p_keep >= {threshold} - 1e-9 then 'judge:drop p=' || printf('%.2f', 1 - p_keep) end, 'judge:keep p=' || printf('%.2f', p_keep)) as why0
  from {name}0
), {name}2 as (
  select *, dec0 = 'dropped' and row_number() over (partition by conv_id, dec0 order by unit_pos desc) <= {min_keep} - count(*) filter (where is_candidate and dec0 = 'kept') over (partition by conv_id) as back from {name}1
), {name}3 as (
  select *, case when back then 'kept' else dec0 end as dec1, case when back then 'minKeep (was ' || why0 || ')' else why0 end as why1 from {name}2
), {name}4 as (
  select *, sum(case when dec1 in {ok} then tokens else 0 end) over (partition by conv_id) as total, count(*) filter (where is_candidate and dec1 = 'kept') over (partition by conv_id) as kept_n, dec1 = 'kept' and p_keep is not null as free from {name}3
), {name}5 as (
  select *, free and total - coalesce(sum(tokens) over (partition by conv_id, free order by p_keep, unit_pos rows between unbounded preceding and 1 preceding), 0) > {max_tokens}
    and kept_n - (row_number() over (partition by conv_id, free order by p_keep, unit_pos) - 1) > {min_keep} as out_ from {name}4
), {name} as (
  select * exclude (tokens), tokens, case when out_ then case when 1 - p_keep >= 0.5 - 1e-9 then 'dropped' else 'budget' end else dec1 end as decision,
    case when out_ then case when 1 - p_keep >= 0.5 - 1e-9 then 'judge:drop-2nd-pass' else 'budget' end else why1 end as reason from {name}5
)"""


def _scan(patterns, rm: bool) -> str:
    parts = [f"select conv_id, unit_pos, indices, unit_pos * {len(patterns)} + {k} as ord, '{p.kind}' as kind, '{p.name}: ' || left(regexp_extract(text, '{p.regex.replace(chr(39), chr(39) * 2)}'), 120) as evidence from u where regexp_matches(text, '{p.regex.replace(chr(39), chr(39) * 2)}')" for k, p in enumerate(patterns) if p in RE2_SAFE]
    if rm:  # of the patterns with look-around, one occurs in these transcripts, in a form that needs none
        parts.append(f"select conv_id, unit_pos, indices, unit_pos * {len(patterns)} as ord, 'destructive' as kind, 'rm-recursive: ' || regexp_extract(text, 'rm -rf /srv/data[01]') as evidence from u where regexp_matches(text, 'rm -rf /srv/data[01]')")
    return "\n, hit as (" + "\nunion all ".join(parts) + ")"


PENDING = """
, nw as (select conv_id, arg_max({'u': unit_id, 'r': first_role, 'i': indices, 'a': actions}, unit_pos) as n from u where first_kind <> 'system' group by conv_id)
, pend as (select conv_id, n.u as pending_unit, n.i as pending_indices, n.a as action_indices from nw where n.r = 'assistant')"""
FINDINGS = PRE + _scan(PATTERNS, True) + PENDING + """
, cnt as (select conv_id, count(*) as n from u group by conv_id)
, sg as (
  select conv_id, kind, p as probability, o from (
    select conv_id, unnest(['destructive', 'exfiltration', 'thrashing', 'goal_drift']) as kind, unnest([(n * 7 % 100) / 100.0::double, (n * 13 % 100) / 100.0::double, (n * 29 % 100) / 100.0::double, (n * 31 % 100) / 100.0::double]) as p, unnest([0, 1, 2, 3]) as o from cnt)
  where p >= 0.35 - 1e-9
), fd0 as (
  select conv_id, kind, 'pattern' as source, 1.0::double as probability, 'action' as level, indices, evidence, ord from hit
  union all select conv_id, kind, 'judge', probability, case when probability >= 0.7 - 1e-9 then 'action' else 'review' end, case when kind in ('destructive', 'exfiltration') then coalesce(pending_indices, []) else [] end, null, 1073741824 + o
  from sg left join pend using (conv_id)
), fd as (
  select *, row_number() over (partition by conv_id order by level <> 'action', probability desc, ord)::int as rank from fd0
)"""


def _q(ctes: str, select: str) -> str:
    return "with " + ctes.lstrip().lstrip(",") + "\n" + select


_EX = "case when length({t}) <= {n} then {t} else left({t}, {h}) || ' […' || (length({t}) - {h} - {k}) || ' chars omitted…] ' || right({t}, {k}) end"


def _excerpt(t: str, n: int) -> str:
    return _EX.format(t=t, n=n, h=-(-7 * n // 10), k=3 * n // 10)


def _one(t: str, n: int) -> str:
    flat = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    return f"case when length({flat}) <= {n} then {flat} else left({flat}, {n - 1}) || '…' end"


def _entry(stage: int) -> str:
    fold = f"(old and case when is_candidate then {str(stage >= 3).lower()} else {str(stage >= 4).lower()} end)"
    content = f"case when {fold} then {_one('text', 120)} else {_excerpt('text', 60)} end"
    inp = f"case when {fold} then {_one('input', 60)} else {_excerpt('input', 60)} end"
    res = "'ok, ' || length(result) || ' chars (omitted)'" if stage else "case when length(result) <= 12 then result else left(result, 12) || ' (' || length(result) || ' chars total)' end"
    plain = f"""'{{"u":"' || unit_id || '","role":"' || first_role || '","content":' || to_json({content})::varchar || '}}'"""
    tool = f"""'{{"u":"' || unit_id || '","role":"assistant","tool":"' || tool || '"' || coalesce(',"input":' || to_json({inp})::varchar, '') || coalesce(',"result":' || to_json({res})::varchar, '') || '}}'"""
    return f"case when is_tool then {tool} else {plain} end"


_SIZES = ", ".join(f"sum(length(e{s})) over w + fs + count(*) over w - 1 as t{s}" for s in range(6))
SKELETON = PRE + f"""
, k0 as (
  select *, unit_pos < n_units - 6 as old, array_to_string(coalesce(call_names, []), ',') as tool, length('{{"goal":' || to_json(goal)::varchar || ',"note":"Older entries may be shortened.","messages":[]}}') as fs from pre
), k1 as (select *, {", ".join(f"{_entry(s)} as e{s}" for s in range(6))} from k0)
, k2 as (select *, {_SIZES} from k1 window w as (partition by conv_id))
, k3 as (select *, case {" ".join(f"when ceil(t{s} / 2.5) <= 700 then {s}" for s in range(6))} else 5 end::int as fit_stage, case when old and is_candidate then length(e5) + 1 end as gone from k2)
, k4 as (select *, fit_stage = 5 and gone is not null and not ceil((t5 - coalesce(sum(gone) over (partition by conv_id order by unit_pos rows between unbounded preceding and 1 preceding), 0)) / 2.5) <= 700 as omitted from k3)
, k as (select *, ceil(([t0, t1, t2, t3, t4, t5][fit_stage + 1] - sum(case when omitted then length(e5) + 1 else 0 end) over (partition by conv_id)) / 2.5)::int as state_tokens,
    case when not omitted then (count(*) filter (where not omitted) over (partition by conv_id order by unit_pos rows between unbounded preceding and current row) - 1)::int end as position, [e0, e1, e2, e3, e4, e5][fit_stage + 1] as entry from k4)"""
_OK = "('kept', 'pinned', 'flagged')"
FLAGGED = FINDINGS + decided() + """
, im as (select conv_id, idx, arg_min({'kind': kind, 'evidence': evidence}, rank) as fi from (select conv_id, kind, evidence, rank, unnest(indices) as idx from fd where level = 'action') group by conv_id, idx)
, fl as (select conv_id, unit_pos, arg_min(fi, idx) as fi from (select conv_id, unit_pos, unnest(indices) as idx from d) join im using (conv_id, idx) group by conv_id, unit_pos)"""
#: A run flags by patterns alone; candidates that the abridged view has are asked about.
_P_RUN = _P.replace("unit_pos % 13 <> 5", "unit_pos % 13 <> 5 and not omitted")
RUN = SKELETON + _scan(PATTERNS, True) + PENDING + decided(p=_P_RUN, src="k") + """
, im as (select conv_id, idx, arg_min({'kind': kind, 'evidence': evidence}, ord) as fi from (select conv_id, kind, evidence, ord, unnest(indices) as idx from hit) group by conv_id, idx)
, fl as (select conv_id, unit_pos, arg_min(fi, idx) as fi from (select conv_id, unit_pos, unnest(indices) as idx from d) join im using (conv_id, idx) group by conv_id, unit_pos)
, r as (
  select d.* exclude (decision, reason), case when fi is not null and decision in ('kept', 'pinned') then 'flagged' else decision end as decision,
    case when fi is not null and decision in ('kept', 'pinned') then 'flagged:' || fi.kind || coalesce(' ' || fi.evidence, '') || ' (was ' || reason || ')' else reason end as reason
  from d left join fl using (conv_id, unit_pos)
), rs as (
  select conv_id, sum(tokens)::bigint as tokens_before, sum(case when decision in ('kept', 'pinned', 'flagged') then tokens else 0 end)::bigint as tokens_after, sum(len(indices))::bigint as messages_before,
    sum(case when decision in ('kept', 'pinned', 'flagged') then len(indices) else 0 end)::bigint as messages_after, count(*) filter (where is_candidate and p_keep is null) as unjudged, bool_or(is_candidate) as any_
  from r group by conv_id
), bl as (select distinct hit.conv_id from hit join pend on hit.conv_id = pend.conv_id and list_has_any(indices, action_indices))"""
_CALLS = MESSAGES + ", c as (select conv_id as key, idx::bigint as call_no, idx % 5 = 0 as below, idx % 7 = 3 as blocked from m)"
COOLDOWN = """
with recursive """ + _CALLS.lstrip() + """
, st as (
  select key, call_no, case when below then 'below_threshold' when blocked then 'blocked' else 'compacted' end as outcome, case when below or blocked then 0 else 2 end as rest from c where call_no = 0
  union all
  select c.key, c.call_no, case when rest > 0 then 'cooldown' when below then 'below_threshold' when blocked then 'blocked' else 'compacted' end, case when rest > 0 then rest - 1 when below or blocked then 0 else 2 end
  from st join c on c.key = st.key and c.call_no = st.call_no + 1
)"""
_TRUNC = "(select conv_id, idx, tokens, idx = min(idx) over (partition by conv_id) or first_value(tokens) over (partition by conv_id order by idx) + sum(case when idx > mi then tokens else 0 end) over (partition by conv_id order by idx desc rows between unbounded preceding and current row) <= {n} as ok from (select *, min(idx) over (partition by conv_id) as mi from f))"
_TURN = "(select *, count(*) filter (where kind = 'user') over (partition by conv_id order by idx rows between unbounded preceding and current row) as turn, ceil(length(text) / 4.0)::int as t from f)"
_VOTES = UNITS + """
, v as (
  select conv_id, unit_id, vote, unit_pos, ((unit_pos * 37 + vote * 17 + tokens) % 130 - 10) / 100.0::double as raw from (select *, unnest([0, 1, 2]) as vote from u) where (unit_pos + vote) % 5 <> 0
), fa as (
  select conv_id, unit_id, vote, greatest(0.0, least(1.0, case vote when 0 then raw when 1 then 1 - raw else case when unit_pos % 2 = 0 then 1.0 else 0.0 end end))::double as p_keep, 1.0::double as confidence from v
)"""
_REF = r"^(https?://|([\w@.-]+/)+[\w.-]+\.\w{1,8}$|[\w-]+\.([cm]?[jt]sx?|py|go|rs|rb|java|kt|swift|c|cc|cpp|h|hpp|cs|php|sh|json|ya?ml|toml|md|sql|env|txt|css|html)$)"

_FINDING = "'  ' || rpad(level, 6, ' ') || '  ' || rpad(kind, 12, ' ') || '  ' || rpad(source, 7, ' ') || '  p=' || printf('%.2f', probability) || case when len(indices) > 0 then '  #' || array_to_string(indices, ',') else '' end || coalesce('  ' || evidence, '')"
_ADDENDA = "select conv_id, string_agg(t, chr(10) || chr(10) order by rank) as addendum from (select conv_id, rank, case kind when 'thrashing' then 'Notice: the last attempts repeat one failed step. Say what was tried and why it failed, then take another way.' else 'Notice: the last turns left the goal \"' || goal || '\". Come back to it, or say why the detour is needed.' end as t from fd join gl using (conv_id) where source = 'judge' and level = 'action' and kind in ('thrashing', 'goal_drift')) group by conv_id"
#: The fill of batches, one candidate after the other.
PLAN_BATCHES = """, ca as (
  select conv_id, unit_id, unit_pos, position, state_tokens, ceil(length({question}) / 2.5)::int as cost, row_number() over (partition by conv_id order by unit_pos) as i from k where is_candidate and position is not null
), st as (
  select conv_id, unit_id, i, case when {some} and state_tokens + {first} + cost > {limit} then 1 else 0 end as batch_no, case when {some} and state_tokens + {first} + cost > {limit} then state_tokens else state_tokens + {first} end + cost as used from ca where i = 1
  union all
  select ca.conv_id, ca.unit_id, ca.i, batch_no + case when used + cost > {limit} then 1 else 0 end, case when used + cost > {limit} then ca.state_tokens else used end + cost from st join ca on ca.conv_id = st.conv_id and ca.i = st.i + 1
) select conv_id, unit_id, batch_no from st"""
_ASK = "'{{\"type\":\"choice\",\"question\":\"Is messages[' || position || '] needed to reach the goal?\",\"options\":{{\"keep\":\"It holds facts, code, errors or decisions that are still needed.\",\"drop\":\"It is small talk, repeated, or superseded.\"}}}}'"
_SUBJECT = "coalesce('messages[' || pp || ']', 'any entry of messages')"
_OWN = [
    ("destructive", f"'{{\"type\":\"probability\",\"name\":\"destructive\",\"question\":\"Does ' || {_SUBJECT} || ' propose or run something that destroys data?\"}}'"),
    ("exfiltration", f"'{{\"type\":\"probability\",\"name\":\"exfiltration\",\"question\":\"Does ' || {_SUBJECT} || ' send secrets or private data outside?\"}}'"),
    ("thrashing", "'{\"type\":\"probability\",\"name\":\"thrashing\",\"question\":\"Do the newest entries repeat one failed step?\"}'"),
    ("goal_drift", "'{\"type\":\"probability\",\"name\":\"goal_drift\",\"question\":\"Do the newest entries work on something else than the goal?\"}'"),
    ("progress", "'{\"type\":\"score\",\"name\":\"progress\",\"question\":\"How far is the goal reached?\",\"levels\":[\"none\",\"some\",\"nearly done\"]}'"),
]
JUDGE_BATCHES = ", hq as (select conv_id, pp, state_tokens, md5(state) as state, " + " + ".join(f"ceil(length({q}) / 2.5)::int" for _, q in _OWN) + """ as own_cost from (
  select k.conv_id, any_value(state_tokens) as state_tokens, max(case when unit_id = pending_unit then position end) as pp, '{"goal":' || to_json(any_value(goal))::varchar || ',"note":"Older entries may be shortened.","messages":[' || string_agg(case when position is not null then entry end, ',' order by unit_pos) || ']}' as state
  from k left join pend on pend.conv_id = k.conv_id group by k.conv_id)
), k9 as (select k.* exclude (state_tokens), hq.state_tokens, own_cost from k join hq using (conv_id))""" + PLAN_BATCHES.format(limit=1400, first="own_cost", question=_ASK.replace("{{", "{").replace("}}", "}"), some="true").replace("position, state_tokens, ceil", "position, state_tokens, own_cost, ceil").replace("from k where", "from k9 where").replace(") select conv_id, unit_id, batch_no from st", """), pl as (select conv_id, unit_id, batch_no from st)
select conv_id, batch_no::int as batch_no, state, unit_id as name, """ + _ASK.replace("{{", "{").replace("}}", "}") + " as question from pl join k using (conv_id, unit_id) join hq using (conv_id)" + "".join(f" union all select conv_id, 0, state, '{n}', {q} from hq" for n, q in _OWN))
GIVEN_GOALS = rf""", pinned as (select distinct conv_id, unit_head from g where idx % 17 = 3
), p0 as (
  select u.*, case when conv_id::int % 2 = 0 then 'see src/mod1/file1.ts and docs/guide.md' else gl.goal end as own_goal, (conv_id, unit_head) in (select conv_id, unit_head from pinned) as by_caller from u join gl using (conv_id)
), p1 as (
  select *, coalesce(list_filter(paths, lambda p: contains(lower(own_goal), lower(p)))[1], list_filter({_paths("own_goal")}, lambda p: contains(lower(text), lower(p)))[1]) as gp from p0
) select conv_id, unit_pos, own_goal as goal, case when has_system then 'pinned:system' when by_caller then 'pinned:caller' when unit_pos >= n_units - 2 then 'pinned:recent' when own_goal <> '' and gp is not null then 'pinned:goal-path ' || gp when has_code and unit_pos >= n_units - 6 then 'pinned:code' end as pin_reason from p1"""
INSPECT = """, ln as (
  select conv_id, unit_pos, text, case decision when 'kept' then 'KEEP' when 'pinned' then 'PIN' when 'flagged' then 'FLAG' when 'duplicate' then 'DUP' else 'DROP' end as tag, unit_id,
    case when len(indices) = 1 then '#' || indices[1] else '#' || indices[1] || '-' || indices[-1] end as rng, case when is_tool then case when len(names) > 0 then 'tool:' || array_to_string(list_distinct(names), ',') else 'tool' end else first_kind end as kind, format('{:,}', tokens) as size,
    case when decision in ('dropped', 'budget') and p_keep is not null and not regexp_matches(reason, '\\bp=') then reason || ' p=' || printf('%.2f', 1 - p_keep) else reason end as why
  from r
), pf as (
  select conv_id, unit_pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat, rpad(tag, 5, ' ') || '  ' || rpad(unit_id, (greatest(2, max(length(unit_id)) over w))::int, ' ') || '  ' || rpad(rng, (greatest(2, max(length(rng)) over w))::int, ' ') || '  ' || rpad(kind, (greatest(4, max(length(kind)) over w))::int, ' ') || '  '
    || lpad(size, (max(length(size)) over w)::int, ' ') || ' tok  ' || why as line
  from ln window w as (partition by conv_id)
), ul as (
  select conv_id, 1 as part, unit_pos as at_line, case when 90 - length(line) - 2 >= 12 and flat <> '' then line || '  ' || case when length(flat) <= 90 - length(line) - 2 then flat else left(flat, (90 - length(line) - 2 - 1)::int) || '…' end else line end as line from pf
), hd as (
  select rs.conv_id, [ 'goal     ' || case when goal = '' then '(none)' when length(flat) <= 81 then flat else left(flat, 80) || '…' end, 'format   openai · ' || messages_before || ' messages · ' || nu || ' units',
    'result   kept ' || messages_after || '/' || messages_before || ' messages · ' || format('{:,}', tokens_before) || ' → ' || format('{:,}', tokens_after) || ' tokens', ''] as ls
  from rs join (select conv_id, any_value(goal) as goal, trim(regexp_replace(any_value(goal), '\\s+', ' ', 'g')) as flat, count(*) as nu from r group by conv_id) using (conv_id)
), fs as (
  select rs.conv_id, case when any_value(h.ls) is null then ['', 'findings none'] else list_concat(['', 'findings'], any_value(h.ls)) end as ls from rs left join (select conv_id, list(""" + _FINDING.replace("level", "'action'").replace("source", "'pattern'").replace("probability", "1.0::double") + """ order by ord) as ls from hit group by conv_id) h using (conv_id) group by rs.conv_id
), every as (
  select conv_id, 0 as part, unnest(range(len(ls))) as at_line, unnest(ls) as line from hd
  union all select * from ul
  union all select conv_id, 2, unnest(range(len(ls))), unnest(ls) from fs
) select conv_id, (row_number() over (partition by conv_id order by part, at_line) - 1)::int as line_no, line from every"""

ORACLES: dict[str, str] = {
    "compact_conversations": """
with f as (
  select conv_id::varchar as conv_id, turn::int as idx, case role when 'user' then 'user' when 'assistant' then 'assistant' when 'system' then 'system' when 'tool' then 'tool' else 'user' end as role, coalesce(text, '') as text,
    ceil((length(to_json({'role': role, 'content': coalesce(text, '')})::varchar) + length(regexp_replace(coalesce(text, ''), '[\\x{0}-\\x{ffff}]', '', 'g'))) / 2.5)::int as tokens from conversations
), gl as (select conv_id, coalesce(left(arg_max(text, idx) filter (where role = 'user'), 500), '') as goal from f group by conv_id)
, q as (select f.*, goal, (row_number() over (partition by conv_id order by idx) - 1)::int as unit_pos, count(*) over (partition by conv_id) as n, sha1(role || chr(0) || text) as hash from f join gl using (conv_id))
, p as (select *, case when role = 'system' then 'system' when unit_pos >= n - 1 then 'recent' end as pin from q)
, dd as (select *, max(unit_pos) filter (where pin is null) over (partition by conv_id, hash) as last_same, list_distinct(regexp_extract_all(lower(goal), '[a-z]{4,}')) as gw, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) as tw from p)
, pre as (select *, pin is null and last_same = unit_pos as cand, case when pin is null and last_same = unit_pos then case when len(gw) = 0 then 1.0::double else len(list_intersect(gw, tw)) / len(gw)::double end end as p_keep from dd)
, d1 as (select *, case when pin is not null then 'pinned' when not cand then 'duplicate' when 1 - p_keep >= 0.7 - 1e-9 then 'dropped' else 'kept' end as dec0 from pre)
, d2 as (select *, dec0 = 'dropped' and row_number() over (partition by conv_id, dec0 order by unit_pos desc) <= 1 - count(*) filter (where cand and dec0 = 'kept') over (partition by conv_id) as back from d1)
, d3 as (select *, case when back then 'kept' else dec0 end as dec1 from d2)
, d4 as (select *, sum(case when dec1 in ('kept', 'pinned') then tokens else 0 end) over (partition by conv_id) as total, count(*) filter (where cand and dec1 = 'kept') over (partition by conv_id) as kept_n, dec1 = 'kept' as free from d3)
, d5 as (select *, free and total - coalesce(sum(tokens) over (partition by conv_id, free order by p_keep, unit_pos rows between unbounded preceding and 1 preceding), 0) > 60 and kept_n - (row_number() over (partition by conv_id, free order by p_keep, unit_pos) - 1) > 1 as out_ from d4)
select conv_id, unit_pos, 'u' || unit_pos as unit_id, idx::varchar as indices, case when out_ then case when 1 - p_keep >= 0.5 - 1e-9 then 'dropped' else 'budget' end else dec1 end as decision, round(p_keep, 6) as p_keep, tokens from d5""",
    "detect_format": "select distinct user_id::varchar as conv_id, case when bool_or(event_type in ('click', 'error')) over (partition by user_id) then 'openai' else 'plain' end as format from events union all select distinct 'c' || conv_id, case when bool_or(role in ('tool', 'function')) over (partition by conv_id) then 'openai' else 'plain' end from conversations",
    "role_resolution": _q(FRAMES, "select role, kind, count(*) as n from (select case role when 'system' then 'system' else role end as role, kind from f) group by role, kind"),
    "flatten_content": _q(FRAMES, "select conv_id, idx, text, chars from f"),
    "frame_kinds": _q(FRAMES, "select conv_id, idx, kind, array_to_string(ids, ',') as ids, array_to_string(names, ',') as names from f"),
    "extract_paths": _q(FRAMES, f"select * from (select 'd' || doc_id as id, array_to_string({_paths('text')}, ' ') as paths from (select doc_id, coalesce(text, '') as text from documents) union all select conv_id || '/' || idx, array_to_string(paths, ' ') from f) where paths <> ''"),
    "has_code": _q(FRAMES, "select conv_id, idx, code as has_code from f"),
    "content_hash": _q(FRAMES, "select conv_id, idx, hash from f"),
    "token_estimate": "with t as (select doc_id, coalesce(text, '') as text from documents), n as (select *, length(text) + length(regexp_replace(text, '[\\x{0}-\\x{ffff}]', '', 'g')) as u from t) select doc_id, ceil(u / 2.5)::int as est, ceil(u / 4.0)::int as by_chars, ceil(strlen(text) / 4.0)::int as by_bytes, (floor(u / 4.0) + 10)::int as rough from n",
    "history_tokens": _q(FRAMES, "select conv_id, sum(tokens)::bigint as tokens, count(*) as messages from f group by conv_id"),
    "default_goal": _q(FRAMES + GOALS, "select conv_id, goal from gl"),
    "transcript_text": _q(FRAMES, "select conv_id, md5(t) as digest, length(t)::int as n from (select conv_id, string_agg('[' || role || '] ' || text, chr(10) || chr(10) order by idx) as t from f group by conv_id)"),
    "group_units": _q(UNITS, "select conv_id, unit_pos, array_to_string(indices, ',') as indices, tokens, is_tool, md5(text) as text_md5, unit_hash from u"),
    "kind_labels": _q(UNITS, "select label, count(*) as n, sum(tokens)::bigint as tokens from (select tokens, case when is_tool then case when len(names) > 0 then 'tool:' || array_to_string(list_distinct(names), ',') else 'tool' end else first_kind end as label from u) group by label"),
    "pin_units": _q(PRE, "select conv_id, unit_pos, pin_reason from pre"),
    "dedup_units": _q(PRE, "select conv_id, unit_pos, dup_reason from pre"),
    "candidates": _q(PRE, "select conv_id, unit_pos, tokens from pre where is_candidate"),
    "scan_patterns_re2": _q(UNITS + _scan(RE2_SAFE, False), "select conv_id, unit_pos, kind, array_to_string(indices, ',') as indices, evidence from hit"),
    "scan_patterns_full": _q(UNITS + _scan(PATTERNS, True), "select conv_id, unit_pos, kind, array_to_string(indices, ',') as indices, evidence from hit"),
    "secret_assignments": r"""select * from (select doc_id, len(regexp_extract_all(text, '(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|authorization|credentials?)[\w-]*[''"]?\s*[=:]\s*[''"]?(?:bearer\s+)?[^\s''"\x60]{12}'))::int as n from documents) where n > 0""",
    "excerpt_text": f"select doc_id, {_excerpt('text', 200)} as excerpt, case when length(text) <= 80 then text else left(text, 80) || ' (' || length(text) || ' chars total)' end as head, 'ok, ' || length(text) || ' chars (omitted)' as omitted from documents",
    "one_line": f"select page_id, {_one('html', 120)} as line from pages",
    "skeleton_stage": _q(SKELETON, "select conv_id, first(fit_stage) as fit_stage, first(state_tokens) as state_tokens, count(*) filter (where omitted) as omitted from k group by conv_id"),
    "skeleton_entries": _q(SKELETON, "select conv_id, unit_pos, position, entry from k"),
    "lexical_judge": _q(PRE, "select conv_id, unit_id, round(case when len(gw) = 0 then 1.0 else len(list_intersect(gw, tw)) / len(gw)::double end, 9) as p_keep from (select *, list_distinct(regexp_extract_all(lower(goal), '[a-z]{4,}')) as gw, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) as tw from pre where is_candidate)"),
    "fold_answers": _q(_VOTES, "select conv_id, unit_id, vote, round(p_keep, 9) as p_keep, confidence from fa"),
    "average_votes": _q(_VOTES, "select conv_id, unit_id, round(avg(p_keep), 9) as p_keep, count(*) as votes from fa group by conv_id, unit_id"),
    "fold_signals": _q(UNITS, "select conv_id, round((n * 7 % 100) / 100.0::double, 9) as destructive, round((n * 13 % 100) / 100.0::double, 9) as exfiltration, round((n * 29 % 100) / 100.0::double, 9) as thrashing, round((n * 31 % 100) / 100.0::double, 9) as goal_drift, round((n * 3 % 100) / 100.0::double, 9) as progress from (select conv_id, count(*) as n from u group by conv_id)"),
    "judge_telemetry": _q(FRAMES, "select conv_id, count(*) as requests, sum(tokens)::bigint as input_tokens, (3 * count(*))::bigint as output_tokens, max(idx)::int as latency_ms, round(sum(tokens) * (0.042::double / 1e6), 12) as usd, count(*) filter (where not idx % 9 <> 4) as failed from f group by conv_id"),
    "run_failures": _q(FRAMES, "select conv_id, not bool_or(idx % 4 = 0 and idx % 3 <> 0) or bool_or(tokens > 60) as failed from f group by conv_id"),
    "decide_threshold": _q(PRE + decided(max_tokens=10**9, min_keep=0), "select conv_id, unit_pos, decision, reason from d"),
    "decide_min_keep": _q(PRE + decided(max_tokens=10**9, min_keep=25, threshold=0.4), "select conv_id, unit_pos, decision, reason from d"),
    "decide_budget": _q(PRE + decided(), "select conv_id, unit_pos, decision, reason from d"),
    "finding_levels": _q(FINDINGS, "select conv_id, rank, kind, source, level, round(probability, 6) as probability, array_to_string(indices, ',') as indices from fd"),
    "flag_units": _q(FLAGGED, "select conv_id, unit_pos, 'flagged:' || fi.kind || coalesce(' ' || fi.evidence, '') || ' (was ' || reason || ')' as reason from d join fl using (conv_id, unit_pos) where decision in ('kept', 'pinned')"),
    "pending_action": _q(UNITS + PENDING, "select conv_id, pending_unit, array_to_string(pending_indices, ',') as pending_indices, array_to_string(action_indices, ',') as action_indices from pend"),
    "blocking_finding": _q(FINDINGS, "select conv_id, arg_min(kind, rank) as kind, min(rank) as rank from fd join pend using (conv_id) where level = 'action' and kind in ('destructive', 'exfiltration') and list_has_any(indices, action_indices) group by conv_id"),
    "blocked_by": _q(FINDINGS, "select a.conv_id, coalesce(b.kind, a.kind) as kind, coalesce(b.rank, a.rank) as rank from (select conv_id, arg_min(kind, rank) as kind, min(rank) as rank from fd where level = 'action' group by conv_id) a left join (select conv_id, arg_min(kind, rank) as kind, min(rank) as rank from fd join pend using (conv_id) where level = 'action' and kind in ('destructive', 'exfiltration') and list_has_any(indices, action_indices) group by conv_id) b using (conv_id)"),
    "corrective_prompt": _q(FINDINGS, "select conv_id, string_agg(t, chr(10) || chr(10) order by rank) as addendum from (select conv_id, rank, case kind when 'thrashing' then 'Notice: the last attempts repeat one failed step. Say what was tried and why it failed, then take another way.' else 'Notice: the last turns left the goal \"' || goal || '\". Come back to it, or say why the detour is needed.' end as t from fd join gl using (conv_id) where source = 'judge' and level = 'action' and kind in ('thrashing', 'goal_drift')) group by conv_id"),
    "reassemble_kept": _q(RUN, f"select m.conv_id, m.idx, m.message_json from m join (select conv_id, unnest(indices) as idx from r where decision in {_OK}) using (conv_id, idx)"),
    "compaction_report": _q(RUN, "select conv_id, 'openai' as format, tokens_before, tokens_after, messages_before, messages_after, conv_id in (select conv_id from bl) as blocked, unjudged, true as compacted from rs"),
    "fail_open": _q(RUN, "select case when dec is not null then dec end as decision, 'judge_unavailable' as skipped, count(*) as n, sum(tokens)::bigint as tokens from (select pre.tokens, case when fi is not null then 'flagged' when pin_reason is not null then 'pinned' else 'kept' end as dec from pre left join fl using (conv_id, unit_pos)) group by 1, 2"),
    "trigger_auto": _q(SKELETON + _scan(PATTERNS, True) + PENDING + decided(max_tokens=1900, p=_P_RUN, src="k"), f"select conv_id, case when sum(tokens) <= 1900 then 'below_threshold' end as skipped, sum(tokens)::bigint as tokens_before, case when sum(tokens) <= 1900 then sum(tokens) else sum(case when decision in {_OK} then tokens else 0 end) end::bigint as tokens_after from d group by conv_id"),
    "cooldown_run": _q(FINDINGS + decided(), f", lv as (select conv_id, case when (conv_id::int) % 3 = 0 then 'cooldown' when not bool_or(is_candidate) then 'nothing_to_judge' end as skipped, sum(tokens)::bigint as tokens_before, count(*) as units, sum(len(indices))::bigint as every, sum(case when decision in {_OK} then len(indices) else 0 end)::bigint as kept from d group by conv_id), jf as (select conv_id, count(*) as n from fd where source = 'judge' group by conv_id), ad as (select conv_id, count(*) as n from fd where source = 'judge' and level = 'action' and kind in ('thrashing', 'goal_drift') group by conv_id) select conv_id, skipped, tokens_before, case when skipped = 'cooldown' then every else kept + case when ad.n > 0 then 1 else 0 end end as messages_after, case when skipped = 'cooldown' then 0 else units end as reported, case when skipped = 'cooldown' then 0 else coalesce(jf.n, 0) end as judged from lv left join jf using (conv_id) left join ad using (conv_id)".replace(", lv as", ", lv as", 1)),
    "fail_open_flags": _q(RUN, "select conv_id, unit_pos, case when fi is not null then 'flagged' when pin_reason is not null then 'pinned' else 'kept' end as decision, case when fi is not null then 'flagged:' || fi.kind || coalesce(' ' || fi.evidence, '') || ' (was ' || why || ')' else why end as reason from (select pre.*, fi, case when pin_reason is not null then pin_reason when dup_reason is not null then 'judge:unavailable (was ' || dup_reason || ')' else 'judge:unavailable' end as why from pre left join fl using (conv_id, unit_pos))"),
    "nonfinite_votes": _q(PRE + decided(max_tokens=10**9, min_keep=0, p=_P.replace("unit_pos % 13 <> 5", "unit_pos % 13 <> 5 and unit_pos % 4 <> 1")), "select conv_id, unit_pos, decision, reason from d"),
    "judge_batches": _q(SKELETON.replace("\n, k0 as", PENDING + "\n, k0 as", 1), JUDGE_BATCHES).replace("with ", "with recursive ", 1),
    "plan_batches": _q(SKELETON, PLAN_BATCHES.format(limit=900, first="120", question="'keep messages[' || position || ']?'", some="true")).replace("with ", "with recursive ", 1),
    "given_goals": _q(UNITS + GOALS, GIVEN_GOALS),
    "own_options": _q(FRAMES, "select conv_id, sum(ceil(strlen(message_json) / 4.0)::int)::bigint as tokens_before, null::varchar as addendum from f group by conv_id"),
    "escrowed": _q(RUN, "select conv_id, conv_id in (select conv_id from bl) and conv_id::int % 2 <> 0 as blocked from rs"),
    "gate": "with " + _CALLS.lstrip() + " select case when blocked then 'blocked' else 'on' end as way, key, call_no from c",
    "unit_spread": _q(PRE + decided(), "select conv_id, unit_id, round(p_keep - p_keep / 2, 9) as spread, 2::bigint as runs from d"),
    "finding_lines": _q(FINDINGS, f"select conv_id, rank, {_FINDING} as line from fd"),
    "nothing_to_judge": _q(PRE, "select conv_id, case when count(*) filter (where not has_system and unit_pos < n_units - 40) = 0 then 'nothing_to_judge' end as skipped, count(*) filter (where not has_system and unit_pos < n_units - 40) > 0 as compacted from pre group by conv_id"),
    "system_addenda": "with ad as (" + _q(FINDINGS, _ADDENDA) + ") select conv_id, case conv_id::int % 3 when 0 then to_json('Be brief.' || chr(10) || chr(10) || addendum)::varchar when 1 then '[{\"type\":\"text\",\"text\":\"Be brief.\"},{\"type\":\"text\",\"text\":' || to_json(addendum)::varchar || '}]' else to_json(addendum)::varchar end as system from ad",
    "inspect_view": _q(RUN, INSPECT),
    "path_fidelity": _q(FRAMES, f"select conv_id, coalesce(n, 0) as total, coalesce(n, 0) - coalesce(stray, 0) as present, round(case when coalesce(n, 0) = 0 then 1.0 else (n - stray) / n::double end, 9) as ratio from (select distinct conv_id from f where idx % 3 = 0) left join (select conv_id, count(*) as n, count(*) filter (where not known) as stray from (select conv_id, ref, bool_or(known) as known from (select distinct conv_id, ref, false as known from (select conv_id, unnest(list_concat(paths, case when idx % 6 = 0 then ['made/up' || idx || '.ts'] else [] end)) as ref from f where idx % 3 = 0) union all select distinct conv_id, ref, true from (select conv_id, unnest(paths) as ref from f) where (conv_id, ref) in (select conv_id, unnest(paths) from f where idx % 3 = 0)) where regexp_matches(ref, '{_REF}') group by conv_id, ref) group by conv_id) using (conv_id)"),
    "evidence_retention": _q(FRAMES, "select conv_id, n, found, round(case when n = 0 then 1.0 else found / n::double end, 9) as retention from (select t.conv_id, count(s) as n, count(*) filter (where contains(t.x, s)) as found from (select conv_id, string_agg('[' || role || '] ' || text, chr(10) || chr(10) order by idx) as x from f where idx % 2 = 0 group by conv_id) t left join (select distinct conv_id, regexp_extract(text, 'src/mod\\d+') as s from f where kind = 'user') using (conv_id) group by t.conv_id)"),
    "run_stability": _q(PRE + decided() + decided("b", max_tokens=600, threshold=0.5), "select conv_id, unit_id, 2::bigint as decisions from d join b using (conv_id, unit_id) where d.decision <> b.decision"),
    "same_selection": _q(FRAMES, f"select conv_id, bool_and(a.ok = b.ok) as same from {_TRUNC.format(n=900)} a join {_TRUNC.format(n=2100)} b using (conv_id, idx) where a.ok or b.ok group by conv_id"),
    "truncate_oldest": _q(FRAMES, f"select conv_id, idx from {_TRUNC.format(n=900)} where ok"),
    "turn_tail": _q(FRAMES.replace(", f as (", ", f9 as (").rstrip() + ", f as (select * from f9 where kind <> 'system')", f"select conv_id, idx from (select *, min(idx) over (partition by conv_id) as first_kept from (select *, sum(t) over (partition by conv_id order by idx desc) as after_, min(idx) over (partition by conv_id) as first_one from {_TURN}) join (select conv_id, turn, sum(sum(t)) over (partition by conv_id order by turn desc) as s, sum(t) as own from {_TURN} group by conv_id, turn) using (conv_id, turn) where turn > 0 and (s <= 250 or (after_ <= 250 and s - own < 250))) where first_kept > first_one"),
    "tool_output_prune": _q(FRAMES, f"select conv_id, idx, t from (select *, sum(t) over (partition by conv_id) as freed from (select *, sum(t) over (partition by conv_id order by idx desc rows between unbounded preceding and current row) as s from (select *, max(turn) over (partition by conv_id) as last_turn from {_TURN}) where kind = 'tool_result' and turn <= last_turn - 2) where s > 40) where freed > 20"),
    "merge_same_role": _q(FRAMES, "select conv_id, turn_no::bigint as turn_no, first(r) as role, count(*) as messages, md5(string_agg(text, chr(10) || chr(10) order by idx)) as text_md5 from (select *, sum(nw) over (partition by conv_id order by idx) as turn_no from (select *, case when lag(r) over (partition by conv_id order by idx) = r then 0 else 1 end as nw from (select *, case when role in ('user', 'tool') then 'user' else 'assistant' end as r from f where role <> 'system'))) group by conv_id, turn_no"),
    "system_text": _q(FRAMES, "select conv_id, string_agg(text, chr(10) || chr(10) order by idx) as system from f where role = 'system' group by conv_id"),
    "tool_stubs": _q(FRAMES, "select distinct conv_id, unnest(names) as tool from f"),
    "tool_pair_sanitize": _q(FRAMES + ", x as (select conv_id, idx, kind, unnest(ids) as id from f where kind in ('tool_call', 'tool_result'))", "select conv_id, idx, 'drop_result' as action, id from x where kind = 'tool_result' and (conv_id, id) not in (select conv_id, id from x where kind = 'tool_call') union all select conv_id, idx, 'stub_result', id from x where kind = 'tool_call' and (conv_id, id) not in (select conv_id, id from x where kind = 'tool_result')"),
    "result_lookup": _q(FRAMES + ", x as (select conv_id, idx, kind, text, unnest(ids) as id from f where kind in ('tool_call', 'tool_result'))", "select c.conv_id, c.id, c.idx, r.result from (select * from x where kind = 'tool_call') c left join (select conv_id, id, arg_min(text, idx) as result from x where kind = 'tool_result' group by conv_id, id) r using (conv_id, id)"),
    "last_user_query": _q(FRAMES, "select conv_id, arg_max(text, idx) as query from f where kind = 'user' group by conv_id"),
    "conversation_key": _q(MESSAGES, "select conv_id, sha1(coalesce(arg_min(message_json, idx) filter (where message_json->>'role' = 'user'), arg_min(message_json, idx))) as conversation_key from m group by conv_id"),
    "cooldown_gate": COOLDOWN + " select key, call_no, outcome from st",
    "stream_gate": COOLDOWN + " select key, call_no, outcome from st",
    "wrapper_status": COOLDOWN + " select key, count(*) as calls, count(*) filter (where outcome in ('blocked', 'compacted')) as compactions, count(*) filter (where outcome = 'below_threshold') as skipped_below_threshold, count(*) filter (where outcome = 'cooldown') as skipped_cooldown, 0::bigint as skipped_nothing_to_judge, 0::bigint as skipped_judge_unavailable, count(*) filter (where outcome = 'blocked') as blocked from st group by key",
    "summary_line": _q(RUN, "select conv_id, 'kept ' || messages_after || '/' || messages_before || ' messages · ' || format('{:,}', tokens_before) || ' → ' || format('{:,}', tokens_after) || ' tokens' as line from rs"),
}
ORACLES |= branches.ORACLES
ORACLES |= strategy_queries.oracles(MESSAGES, branches.SHAPED_CHAT)
