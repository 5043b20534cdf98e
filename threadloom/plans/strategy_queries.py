"""Queries over the strategies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import strategies as S
from ..sources.samples import shaped_messages
from ..sources.shapes import to_openai
from ..sources.transcripts import agent_messages, conversations


def _rows(s: SparkSession, d: str, systems: bool = True) -> DataFrame:
    return S.chat_rows(agent_messages(s, d), systems)


def structural_prune(s, d):
    return S.prune_parts(_rows(s, d), 6)


def prune_shapes(s, d):
    """Over histories of all shapes, and one tool only."""
    return S.prune_parts(S.chat_rows(to_openai(shaped_messages(s, d))), 2, ("read", "g"))


def newest_user_messages(s, d):
    return S.newest_users(S.chat_rows(conversations(s, d)), 60)


def split_point_70(s, d):
    return S.split_place(_rows(s, d, False))


def tool_output_budget(s, d):
    return S.tool_outputs(_rows(s, d), 120, 1)


def keep_last_20(s, d):
    return S.keep_last(_rows(s, d, False), 20).select("conv_id", "idx")


def trim_last(s, d):
    return S.trim_last(_rows(s, d), 300)


def half_split(s, d):
    return S.half_split(_rows(s, d, False), 900)


def tail_cut(s, d):
    return S.middle(_rows(s, d), 250)


def prune_results(s, d):
    return S.prune_results(_rows(s, d), 8, 150, 10).select("conv_id", "idx", "role", "content", F.array_join("args", "|").alias("args"))


def serialize_xml(s, d):
    return S.as_xml(S.chat_rows(to_openai(shaped_messages(s, d)))).select("conv_id", F.md5("xml").alias("digest"))


def serialize_turns(s, d):
    return S.as_turns(_rows(s, d)).select("conv_id", F.md5("serialized").alias("digest"))


def without_open_calls(s, d):
    return S.without_open_calls(_rows(s, d)).select("conv_id", "idx")


def real_query(s, d):
    rows = _rows(s, d).withColumn("content", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("x <user_query>\n"), "content", F.lit("\n</user_query> y"))).otherwise(F.col("content")))
    return S.real_query(rows)


def summary_text(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce(F.substring("text", 1, 400), F.lit("")).alias("t"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<analysis>\nhm </analysis>\n<summary>\n"), "t", F.lit("\n\n\n\n<summary_request>b</summary> end\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), "t", F.lit("</summary>"))).otherwise(F.col("t"))
    return docs.select("doc_id", F.md5(S.summary_of(raw)).alias("digest"))


def assemblies(s, d):
    """The five ways in which summary and tail are put together."""
    rows = _rows(s, d)
    own = rows.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("content", "pos").alias("query"))
    sums = rows.select("conv_id").distinct().join(own, "conv_id", "left").withColumn("summary", F.concat(F.lit("Summary of "), "conv_id"))
    note = F.lit("Got it.")
    last = S.keep_last(S.chat_rows(agent_messages(s, d), False), 3)
    ways = {
        "snapshot": S.assembled(rows, [("user", F.col("summary")), ("assistant", note)], last, (), sums),
        "query": S.assembled(rows, [("user", F.concat(F.lit("<user_query>\n"), "query", F.lit("\n</user_query>"))), ("user", F.col("summary"))], None, (), sums),
        "answer": S.assembled(rows, [("assistant", F.col("summary"))], last, [("user", F.lit("Go on."))], sums),
        "replay": S.assembled(rows, [("user", F.col("summary")), ("assistant", note), ("user", F.col("query"))], None, (), sums),
        "tail": S.assembled(rows, [("user", F.col("summary"))], last, (), sums),
    }
    out = None
    for way, df in ways.items():
        part = df.select(F.lit(way).alias("way"), "conv_id", "idx", "role", F.md5("content").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def truncate_oldest(s, d):
    from ..operators.baselines import truncate_oldest as oldest

    sized = agent_messages(s, d).select("conv_id", "idx", T.est_tokens("message_json").alias("tokens"))  # nothing else of a message is read
    return oldest(sized, 900).select("conv_id", "idx")


def strategy_compare(s, d):
    """Every registered strategy's savings, beside truncation."""
    from ..operators import metrics as M

    rows = _rows(s, d)
    size = T.est_tokens("message_json")
    before = rows.groupBy("conv_id").agg(F.sum(size).alias("tokens_before"))
    arms, out = {k: f(rows) for k, f in S.STRATEGIES.items()} | {"truncate": truncate_oldest(s, d).join(rows, ["conv_id", "idx"])}, None
    for arm, kept in arms.items():
        after = kept.groupBy("conv_id").agg(F.sum(size).alias("tokens_after"))
        part = before.join(after, "conv_id").select(F.lit(arm).alias("arm"), "tokens_before", "tokens_after", F.lit(0).alias("stray"))
        out = part if out is None else out.unionAll(part)
    return M.compare_arms(out)


QUERIES = {
    f.__name__: f
    for f in (
        structural_prune, prune_shapes, newest_user_messages, split_point_70, tool_output_budget, keep_last_20, trim_last, half_split, tail_cut, prune_results, serialize_xml, serialize_turns, without_open_calls,
        real_query, summary_text, assemblies, truncate_oldest, strategy_compare,
    )
}


def oracles(messages: str, shaped: str) -> dict[str, str]:
    """SQL of the queries, from the CTEs of the transcripts' messages (m) and of messages of all shapes as a chat service has them (x: conv_id, idx, message_json)."""
    rows = """
, r0 as (
  select conv_id, idx, message_json, message_json->>'role' as role, coalesce(message_json->>'content', '') as content, message_json->'tool_calls' as tcs, message_json->>'tool_call_id' as call_id from {source}
), r as (
  select *, row_number() over (partition by conv_id order by idx) - 1 as pos, count(*) over (partition by conv_id) as n, case when tcs is null then [] else from_json(tcs, '[{{"id":"VARCHAR","type":"VARCHAR","function":{{"name":"VARCHAR","arguments":"VARCHAR"}}}}]') end as calls
  from r0 where {where}
)"""
    with_ = lambda source="m", where="true": "with " + (messages if source == "m" else shaped).lstrip() + rows.format(source=source, where=where)
    no_system = "role <> 'system'"
    prune = lambda last, spared: f"""
, k as (
  select conv_id, list_distinct(flatten(list(case when role = 'tool' then [call_id] else list_transform(calls, lambda c: c.id) end))) as kept from r where pos >= n - {last} group by conv_id
), names as (
  select conv_id, c.id as id, any_value(c.function.name) as tool from (select conv_id, unnest(calls) as c from r) group by 1, 2
), z as (
  select r.*, pos >= n - {last} as recent, list_filter(calls, lambda c: list_contains(kept, c.id) or {spared.format(tool="c.function.name")}) as left_, list_contains(kept, call_id) or {spared.format(tool="coalesce(tool, 'tool')")} as stays
  from r join k using (conv_id) left join names on names.conv_id = r.conv_id and names.id = r.call_id
)
select conv_id, idx, case when role = 'assistant' and not recent and len(left_) < len(calls) then '{{"role":"assistant","content":' || to_json(content)::varchar
    || case when len(left_) > 0 then ',"tool_calls":[' || list_reduce(list_transform(left_, lambda c: '{{"id":"' || c.id || '","type":"function","function":{{"name":"' || c.function.name || '","arguments":' || to_json(c.function.arguments)::varchar || '}}}}'), lambda a, b: a || ',' || b) || ']' else '' end || '}}'
  else message_json end as message_json
from z where case role when 'tool' then recent or stays when 'assistant' then content <> '' or (recent and len(calls) > 0) or len(left_) > 0 else content <> '' end"""  # noqa: E731
    last = "(select conv_id, idx, pos, role, content from (select *, case when n - {n} <= 0 then 0 when run_end > n - {n} then coalesce((select max(b.pos) from r b, (select unnest(calls) as c, conv_id as cc, pos as pp from r) u where b.conv_id = q.conv_id and u.cc = b.conv_id and u.pp = b.pos and b.pos < q.n - {n} and u.c.id in (select call_id from r t where t.conv_id = q.conv_id and t.pos >= q.n - {n} and t.pos < q.run_end)), run_end) else n - {n} end as at_pos from (select *, coalesce(min(pos) filter (where pos >= n - {n} and role <> 'tool') over (partition by conv_id), n) as run_end from r) q) where pos >= at_pos)"
    json_size = "length(message_json)"
    approx = "(ceil((length({c}) + case when role = 'assistant' and len(calls) > 0 then 2 + 2 * (len(calls) - 1) + list_sum(list_transform(calls, lambda c: length('{{''name'': ''' || c.function.name || ''', ''args'': , ''id'': ''' || c.id || ''', ''type'': ''tool_call''}}') + length(c.function.arguments) + 1)) else 0 end + case when role = 'tool' then length(coalesce(call_id, '')) else 0 end + length(role)) / 3.3)::int + 3)"
    rough = "(length(content) // 4 + 10 + coalesce(list_sum(list_transform(calls, lambda c: length(c.function.arguments) // 4)), 0))::int"
    kind = "case role when 'user' then 'human' when 'assistant' then 'ai' when 'tool' then 'tool' else 'system' end"
    esc = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    chars = "list_max(list_filter(range(0, length(content) + 1), lambda i: strlen({side}(content, i)) <= {most}))"
    summary, got, query = ("user", "'Summary of ' || conv_id"), ("assistant", "'Got it.'"), ("user", "query")
    wholes = {
        "snapshot": ([summary, got], True, []), "query": ([("user", "'<user_query>' || chr(10) || query || chr(10) || '</user_query>'"), summary], False, []),
        "answer": ([("assistant", summary[1])], True, [("user", "'Go on.'")]), "replay": ([summary, got, query], False, []), "tail": ([summary], True, []),
    }

    def whole(way: str) -> str:
        before, tail, after = wholes[way]
        made = lambda part, some: " union all ".join(f"select conv_id, {part} as part, {i} as ord, '{role}' as role, {text} as content from ids where {text} is not null" for i, (role, text) in enumerate(some))
        parts = ["select conv_id, 0 as part, idx as ord, role, content from sy", made(1, before)]
        parts += ["select conv_id, 2, pos, role, content from tl"] * tail + [made(3, after)] * bool(after)
        return f"select '{way}' as way, conv_id, (row_number() over (partition by conv_id order by part, ord) - 1)::int as idx, role, md5(content) as digest from ({' union all '.join(parts)})"

    old = "(select conv_id, idx, message_json from (select *, pos = 0 or first_value(size) over (partition by conv_id order by pos) + sum(case when pos > 0 then size else 0 end) over (partition by conv_id order by pos desc rows between unbounded preceding and current row) <= 900 as ok from (select *, ceil(length(message_json) / 2.5)::int as size from r)) where ok)"
    arms = {"prune": with_() + prune(6, "false"), "last": with_() + f" select conv_id, idx, message_json from {last.format(n=10)} join r using (conv_id, idx)", "closed": with_() + " select conv_id, idx, message_json from (select *, max(case when not (role = 'assistant' and len(calls) > 0) then pos end) over (partition by conv_id) as last_pos from r) where pos <= last_pos", "truncate": with_() + f" select * from {old}"}
    return {
        "strategy_compare": "with b as (" + with_() + " select conv_id, sum(ceil(length(message_json) / 2.5)::int) as b from r group by conv_id) select arm, count(*) as histories, sum(b)::bigint as tokens_before, sum(a)::bigint as tokens_after, round(avg(1 - a / b::double), 6) as mean_saved, 0::bigint as stray from ("
        + " union all ".join(f"select '{arm}' as arm, conv_id, sum(ceil(length(message_json) / 2.5)::int) as a from ({q}) group by conv_id" for arm, q in arms.items()) + ") join b using (conv_id) group by arm",
        "structural_prune": with_() + prune(6, "false"),
        "prune_shapes": with_("x") + prune(2, "{tool} not in ('read', 'g')"),
        "newest_user_messages": "with c as (select conv_id::varchar as conv_id, turn::int as idx, coalesce(text, '') as content from conversations where role = 'user'), z as (select *, ceil(strlen(content) / 4.0)::int as cost from c), "
        "y as (select *, 60 - (sum(cost) over (partition by conv_id order by idx desc rows between unbounded preceding and current row) - cost) as rest from z) "
        f"select conv_id, idx, case when cost <= rest then content else left(content, {chars.format(side='left', most='rest * 4 // 2')}) || '…' || ceil((strlen(content) - rest * 4) / 4.0)::int || ' tokens truncated…' || right(content, {chars.format(side='right', most='rest * 4 - rest * 4 // 2')}) end as content from y where rest > 0",
        "split_point_70": with_(where=no_system) + f", z as (select *, sum({json_size}) over (partition by conv_id) as total, sum({json_size}) over (partition by conv_id order by pos) - {json_size} as before from r) select conv_id, coalesce(min(pos) filter (where role = 'user' and before >= total * 0.7), case when arg_max(role = 'assistant' and len(calls) = 0, pos) then count(*) end, max(pos) filter (where role = 'user'), 0)::int as split from z group by conv_id",
        "tool_output_budget": with_().replace("with ", "with recursive ", 1) + """
, t as (
  select conv_id, idx, content, row_number() over (partition by conv_id order by pos desc) as k, '[Tool output truncated to its last 1 lines during compression; the full ' || len(string_split(content, chr(10))) || '-line output was saved to a temporary file.]' || chr(10) || string_split(content, chr(10))[-1] as short
  from r where role = 'tool'
), st as (
  select conv_id, k, idx, case when ceil(length(content) / 4.0) <= 120 then content else short end as content, case when ceil(length(content) / 4.0) <= 120 then ceil(length(content) / 4.0) else ceil(length(short) / 4.0) end as used from t where k = 1
  union all
  select t.conv_id, t.k, t.idx, case when used + ceil(length(t.content) / 4.0) <= 120 then t.content else short end, used + case when used + ceil(length(t.content) / 4.0) <= 120 then ceil(length(t.content) / 4.0) else ceil(length(short) / 4.0) end
  from st join t on t.conv_id = st.conv_id and t.k = st.k + 1
) select conv_id, idx, content from st""",
        "keep_last_20": with_(where=no_system) + f" select conv_id, idx from {last.format(n=20)}",
        "trim_last": with_() + f"""
, a as (select *, {approx.format(c="content")} as t, pos = 0 and role = 'system' as lead_ from r
), b as (select *, 300 - coalesce(max(case when lead_ then t end) over (partition by conv_id), 0) as budget, sum(case when lead_ then 0 else t end) over (partition by conv_id order by pos desc) as after_ from a
), c as (select *, not lead_ and after_ > budget and pos = max(case when not lead_ and after_ > budget then pos end) over (partition by conv_id) as crossing, budget - (after_ - t) as rest, string_split(content, chr(10)) as ls from b
), e9 as (select *, {approx.format(c="''")} as bare, (length(role) + case when role = 'tool' then length(coalesce(call_id, '')) else 0 end) as extra from c
), f1 as (select *, list_filter(list_transform(range(1, len(ls) + 1), lambda k: array_to_string(ls[-k:], chr(10))), lambda x: case when len(calls) > 0 then false else ceil((length(x) + extra) / 3.3)::int + 3 <= rest end) as fits from e9
), g as (select conv_id, idx, pos, role, lead_, case when crossing then case when len(calls) > 0 then case when bare <= rest then content end else fits[-1] end else content end as content from f1 where lead_ or after_ <= budget or crossing
), h as (select *, min(case when not lead_ and role = 'user' then pos end) over (partition by conv_id) as from_ from g where lead_ or content is not null)
select conv_id, idx, role, content from h where lead_ or pos >= from_""",
        "half_split": with_(where=no_system) + f", a as (select *, sum(ceil({json_size} / 4.0)) over (partition by conv_id order by pos desc) as after_ from r), b as (select *, coalesce(min(case when after_ < 450 then pos end) over (partition by conv_id), n) as sp from a), c as (select conv_id, max(n) as n, max(after_) as total, coalesce(max(case when role = 'assistant' and pos < sp then pos + 1 end), 1) as sp from b group by conv_id) select conv_id, (case when total <= 900 then null when n <= 4 or sp <= 4 then n else sp end)::int as split from c",
        "tail_cut": with_() + f"""
, a as (select *, sum({rough}) over (partition by conv_id order by pos desc) as after_, coalesce(min(case when pos >= 3 and role <> 'tool' then pos end) over (partition by conv_id), n) as h from r
), b as (select *, case when n - h > 1 then least(3, n - h - 1) else 0 end as least_ from a
), c as (select conv_id, max(n) as n, max(h) as h, max(least_) as least_, least(coalesce(min(case when pos >= h and (after_ <= 375 or n - pos < least_) then pos end), max(n)), max(n - least_)) as cut from b group by conv_id
), d as (select conv_id, n, h, case when cut <= h then greatest(n - least_, h + 1) else cut end as cut from c
), e9 as (select d.*, (select max(r.pos) from r where r.conv_id = d.conv_id and r.pos < d.cut and r.role <> 'tool') as before, (select max(r.pos) from r where r.conv_id = d.conv_id and r.role = 'user' and r.pos >= d.h) as last_user from d
), f1 as (select e9.*, case when cut > 0 and cut < n and exists (select 1 from r where r.conv_id = e9.conv_id and r.pos = e9.before and r.role = 'assistant' and len(r.calls) > 0) then before else cut end as cut1 from e9)
select conv_id, h::int as head_end, greatest(case when last_user < cut1 then greatest(last_user, h + 1) else cut1 end, h + 1)::int as cut from f1""",
        "prune_results": with_() + f"""
, a as (select *, sum({rough}) over (partition by conv_id order by pos desc) as after_ from r
), b as (select *, coalesce(max(case when after_ > 150 and n - pos >= least(8, n) then pos end) over (partition by conv_id), 0) as boundary from a
), c as (select *, least(boundary, n - least(8, n)) as end_, role = 'tool' and length(content) >= 10 and pos <> max(pos) over (partition by conv_id, role = 'tool' and length(content) >= 10, left(md5(content), 12)) as copy_ from b
), w as (select conv_id, c.id as id, arg_max(c.function.name, pos) as tool, arg_max(c.function.arguments, pos) as args from (select conv_id, pos, unnest(calls) as c from r) group by 1, 2)
select c.conv_id, idx, role, case when copy_ then '[Duplicate tool output — same content as a more recent call]' when pos < end_ and role = 'tool' and length(content) > 10 then
    case when w.tool = 'read_file' then '[read_file] read ' || (w.args->>'path') || ' from line 1 (' || length(content) || ' chars)' else '[unknown] (' || length(content) || ' chars result)' end else content end as content,
  case when len(calls) > 0 then array_to_string(list_transform(calls, lambda x: x.function.arguments), '|') end as args
from c left join w on w.conv_id = c.conv_id and w.id = c.call_id""",
        "serialize_xml": with_("x") + f" select conv_id, md5(string_agg(case when role = 'assistant' and len(calls) > 0 then '<message type=\"ai\">' || chr(10) || case when content <> '' then '  <content>' || {esc.format(x='content')} || '</content>' || chr(10) else '' end || list_reduce(list_transform(calls, lambda c: '  <tool_call id=\"' || c.id || '\" name=\"' || c.function.name || '\">' || replace(c.function.arguments, ':', ': ') || '</tool_call>'), lambda a, b: a || chr(10) || b) || chr(10) || '</message>' else '<message type=\"' || {kind} || '\">' || {esc.format(x='content')} || '</message>' end, chr(10) order by pos)) as digest from r group by conv_id",
        "serialize_turns": with_() + " select conv_id, md5(string_agg(case when role = 'tool' then '[TOOL RESULT ' || call_id || ']: ' || content when len(calls) > 0 then '[ASSISTANT]: ' || content || chr(10) || '[Tool calls:' || chr(10) || '  ' || calls[1].function.name || '(' || calls[1].function.arguments || ')' || chr(10) || ']' else '[' || upper(role) || ']: ' || content end, chr(10) || chr(10) order by pos)) as digest from r group by conv_id",
        "without_open_calls": with_() + " select conv_id, idx from (select *, max(case when not (role = 'assistant' and len(calls) > 0) then pos end) over (partition by conv_id) as last_pos from r) where pos <= last_pos",
        "real_query": with_() + " select conv_id, arg_max(content, pos) as query from r where role = 'user' group by conv_id",
        "summary_text": r"""with t as (select doc_id, coalesce(left(text, 400), '') as t from documents), raw as (
  select doc_id, case when doc_id % 3 = 0 then 'Summary:' || chr(10) || regexp_replace(regexp_replace(t || chr(10) || chr(10) || chr(10) || chr(10) || '<summary_request>b', '^\s+', ''), '\s+$', '') || ' end' when doc_id % 3 = 1 then t || '</summary>' else t end as x from t
) select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<(/?(summary|analysis|summary_request))>', '<' || chr(8203) || '\1>', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) as digest from raw""",
        "assemblies": with_(where=no_system) + ", sy as (select conv_id, idx, 'system' as role, message_json->>'content' as content from m where message_json->>'role' = 'system'), ids as (select conv_id, arg_max(content, pos) filter (where role = 'user') as query from (select conv_id, null as content, -1 as pos, '' as role from m union all select conv_id, content, pos, role from r) group by conv_id), "
        f"tl as (select * from {last.format(n=3)}) " + " union all ".join(whole(w) for w in wholes),
    }
