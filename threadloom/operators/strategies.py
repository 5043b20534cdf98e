"""Strategies over messages as a chat service has them: role, content, tool calls, tool_call_id.

``chat_rows`` makes these rows; every strategy is windows over a conversation's rows,
by position ``pos``. What a model writes is an input column, never made here.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

_BY = lambda: W.partitionBy("conv_id")
_ORDER = lambda: W.partitionBy("conv_id").orderBy("pos")
_UP = lambda: _ORDER().rowsBetween(W.unboundedPreceding, 0)
_AFTER = lambda: W.partitionBy("conv_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)

# Notes and names that the results carry.
DUPLICATE = "[Duplicate tool output — same content as a more recent call]"
TYPE_NAMES = {"user": "human", "assistant": "ai", "tool": "tool"}
CUT_NOTE = ("[Tool output truncated to its last 30 lines during compression; the full ", "-line output was saved to a temporary file.]\n")


def chat_rows(messages: DataFrame, systems: bool = True) -> DataFrame:
    """conv_id, idx, pos, role, content, calls (id, name, args, raw), call_id, name and message_json; without system messages if these are not asked for. Content blocks are their texts, end to end."""
    m = F.from_json("message_json", "role string, content string, tool_call_id string, name string, tool_calls array<string>")
    field = lambda c, p: F.get_json_object(c, p)
    call = lambda c: F.struct(field(c, "$.id").alias("id"), field(c, "$.function.name").alias("name"), F.coalesce(field(c, "$.function.arguments"), F.lit("")).alias("args"), c.alias("raw"))
    none = F.array().cast("array<struct<id:string,name:string,args:string,raw:string>>")
    blocks = F.from_json("m.content", "array<struct<text:string>>")
    content = F.when(F.col("message_json").rlike(r'"content"\s*:\s*\[') & F.col("m.content").startswith("["), F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "")).otherwise(F.coalesce("m.content", F.lit("")))
    df = messages.withColumn("m", m).select("conv_id", "idx", F.col("m.role").alias("role"), content.alias("content"), F.coalesce(F.transform("m.tool_calls", call), none).alias("calls"), F.col("m.tool_call_id").alias("call_id"), F.col("m.name").alias("name"), "message_json")
    df = df if systems else df.filter("role <> 'system'")
    return df.withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("idx")) - 1)


def _n() -> Column:
    return F.count(F.lit(1)).over(_BY())


def prune_parts(rows: DataFrame, last: int | None = 2, only: tuple[str, ...] | None = None) -> DataFrame:
    """conv_id, idx and message_json without the tool calls and results that lie before the last messages, unless their id is used there; messages left with nothing go.

    last: None prunes everywhere. only: tools that are pruned; others stay. A message that loses no call comes back as it was.
    """
    recent = F.lit(False) if last is None else F.col("pos") >= _n() - last
    own = F.concat(F.transform("calls", lambda c: c["id"]), F.when(F.col("role") == "tool", F.array("call_id")).otherwise(F.array().cast("array<string>")))
    df = rows.withColumn("_recent", recent).withColumn("_own", own)
    df = df.withColumn("_kept", F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_recent"), F.col("_own"))).over(_BY()))))
    spared = lambda name: ~name.isin(*only) if only is not None else F.lit(False)
    if only is not None:  # a result's tool is its call's
        every = F.collect_list(F.transform("calls", lambda c: F.struct(c["id"].alias("id"), F.coalesce(c["name"], F.lit("tool")).alias("tool")))).over(_BY())
        df = df.withColumn("_names", F.array_distinct(F.flatten(every)))
        df = df.withColumn("_tool", F.coalesce(F.get(F.filter("_names", lambda x: x["id"] == F.col("call_id")), F.lit(0))["tool"], F.lit("tool")))
    stays = lambda c: F.array_contains("_kept", c["id"]) | spared(F.coalesce(c["name"], F.lit("tool")))
    df = df.withColumn("_calls", F.when(F.col("_recent"), F.col("calls")).otherwise(F.filter("calls", stays)))
    tool = F.col("_recent") | F.array_contains("_kept", F.col("call_id")) | (spared(F.col("_tool")) if only is not None else F.lit(False))
    something = (F.col("content") != "") | (F.size("_calls") > 0)
    df = df.filter(F.when(F.col("role") == "tool", F.coalesce(tool, F.lit(False))).when(F.col("role") == "assistant", something).otherwise(F.col("content") != ""))
    text = F.regexp_replace(F.to_json(F.struct(F.lit("assistant").alias("role"), "content")), r"\}\z", "")
    made = F.concat(text, F.when(F.size("_calls") > 0, F.concat(F.lit(',"tool_calls":['), F.array_join(F.col("_calls")["raw"], ","), F.lit("]"))).otherwise(F.lit("")), F.lit("}"))
    changed = (F.col("role") == "assistant") & (F.size("_calls") < F.size("calls"))
    return df.select("conv_id", "idx", F.when(changed, made).otherwise(F.col("message_json")).alias("message_json"))


def _starts_character(text: Column, at: Column) -> Column:
    """Whether the byte at a place (from 0) of a UTF-8 string begins a character, or is past its end."""
    byte = F.hex(F.substring(F.encode(text, "UTF-8"), at + 1, F.lit(1)))
    return (byte < "80") | (byte > "BF") | (byte == "")


def head_bytes(text: Column, n: Column) -> Column:
    """The longest beginning of at most so many bytes that ends with a character."""
    end = F.coalesce(*[F.when(_starts_character(text, n - k), n - k) for k in range(4)])
    return F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), end), "UTF-8")


def tail_bytes(text: Column, n: Column) -> Column:
    start = F.octet_length(text) - n
    at = F.coalesce(*[F.when(_starts_character(text, start + k), start + k) for k in range(4)])
    return F.decode(F.substring(F.encode(text, "UTF-8"), at + 1, F.octet_length(text)), "UTF-8")


def newest_users(rows: DataFrame, budget: int = 20000) -> DataFrame:
    """conv_id, idx and content of the newest user messages within a budget of UTF-8 bytes / 4, in order; the one that crosses it loses its middle, and none before it is kept."""
    cost = T.tokens_by_bytes("content")
    df = rows.filter("role = 'user'").withColumn("_after", F.sum(cost).over(_AFTER()))
    df = df.withColumn("_left", F.lit(budget) - (F.col("_after") - cost)).filter("_left > 0")
    size = (F.col("_left") * 4).cast("int")
    left = F.floor(size / 2).cast("int")
    gone = F.ceil((F.octet_length("content") - size) / 4).cast("string")
    text = F.concat(head_bytes(F.col("content"), left), F.lit("…"), gone, F.lit(" tokens truncated…"), tail_bytes(F.col("content"), size - left))
    return df.select("conv_id", "idx", F.when(F.col("_after") <= budget, F.col("content")).otherwise(text).alias("content"))


def split_place(rows: DataFrame, fraction: float = 0.7) -> DataFrame:
    """conv_id and split, the number of messages to compress (rows without systems): up to the first user message at or past the fraction of JSON characters; all, if the history ends with an answer that calls nothing; else up to the last user message."""
    size = T.u16len("message_json")
    before = F.sum(size).over(_UP()) - size
    df = rows.withColumn("_past", (F.col("role") == "user") & (before >= F.sum(size).over(_BY()) * fraction)).withColumn("_end", (F.col("role") == "assistant") & (F.size("calls") == 0))
    pick = F.coalesce(F.min(F.when(F.col("_past"), F.col("pos"))), F.when(F.max_by("_end", "pos"), F.count(F.lit(1))), F.max(F.when(F.col("role") == "user", F.col("pos"))), F.lit(0))
    return df.groupBy("conv_id").agg(pick.cast("int").alias("split"))


def tool_outputs(rows: DataFrame, budget: int = 50000, lines: int = 30) -> DataFrame:
    """conv_id, idx and content of tool results, newest first as they are while they fit; one that doesn't keeps its last lines under a note, and counts with what it keeps.

    What is kept feeds the count, so it is a fold over a history's results, inside one row.
    """
    parts = F.split("content", "\n")
    cut = F.concat(F.lit(CUT_NOTE[0].replace("30", str(lines))), F.size(parts).cast("string"), F.lit(CUT_NOTE[1]), F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - lines + 1), lines), "\n"))
    f = rows.filter("role = 'tool'").withColumn("_cut", cut)
    per = f.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("o"), T.tokens_by_chars("content").alias("whole"), T.tokens_by_chars("_cut").alias("short")))).alias("r"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("gone"))
    fits = lambda a, x: a["used"] + x["whole"] <= budget
    step = lambda a, x: F.struct((a["used"] + F.when(fits(a, x), x["whole"]).otherwise(x["short"])).alias("used"), F.when(fits(a, x), a["gone"]).otherwise(F.concat(a["gone"], F.array(-x["o"]))).alias("gone"))
    gone = per.select("conv_id", F.explode(F.aggregate("r", start, step)["gone"]).alias("pos")).withColumn("_is", F.lit(True))
    return f.join(gone, ["conv_id", "pos"], "left").select("conv_id", "idx", F.when(F.col("_is"), F.col("_cut")).otherwise(F.col("content")).alias("content"))


def keep_last(rows: DataFrame, n: int = 20) -> DataFrame:
    """The last n rows; a cut on tool results moves back to the call that one of the run answers, else forward past the run."""
    df = rows.withColumn("_cut", F.greatest(F.lit(0), _n() - n))
    df = df.withColumn("_end", F.coalesce(F.min(F.when((F.col("pos") >= F.col("_cut")) & (F.col("role") != "tool"), F.col("pos"))).over(_BY()), _n()))
    run = (F.col("pos") >= F.col("_cut")) & (F.col("pos") < F.col("_end"))  # tool results from the cut on, fewer than n
    df = df.withColumn("_ids", F.collect_list(F.when(run, F.col("call_id"))).over(_BY()))
    answers = (F.col("pos") < F.col("_cut")) & F.arrays_overlap(F.transform("calls", lambda c: c["id"]), "_ids")
    at = F.when(F.col("_end") > F.col("_cut"), F.coalesce(F.max(F.when(answers, F.col("pos"))).over(_BY()), F.col("_end"))).otherwise(F.col("_cut"))
    return df.withColumn("_at", F.when(F.col("_cut") > 0, at).otherwise(F.lit(0))).filter("pos >= _at").drop("_cut", "_end", "_ids", "_at")


def _repr_length(args: Column) -> Column:
    """Characters of a JSON value as Python prints it: spaces after separators, escapes undone, quotes escaped."""
    bare = F.regexp_replace(args, r'"(?:[^"\\]|\\.)*"', "")
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    return F.length(args) + count(bare, "[,:]") - count(args, r"\\[^u]") - 5 * count(args, r"\\u[0-9a-fA-F]{4}") + count(args, "'")


def approximate_tokens(content: Column | str) -> Column:
    """Tokens of a message: 3.3 characters each of content, calls, id, role and name, rounded up, and 3."""
    c = F.col(content) if isinstance(content, str) else content
    args = lambda x: F.when(x == "", F.lit(2)).otherwise(_repr_length(x))
    one = lambda x: F.length(F.concat(F.lit("{'name': '"), F.coalesce(x["name"], F.lit("")), F.lit("', 'args': , 'id': '"), F.coalesce(x["id"], F.lit("")), F.lit("', 'type': 'tool_call'}"))) + args(x["args"])
    calls = F.when(F.size("calls") > 0, F.aggregate(F.transform("calls", one), F.lit(2) + 2 * (F.size("calls") - 1), lambda a, x: a + x)).otherwise(F.lit(0))
    chars = T.u16len(c) + F.when(F.col("role") == "assistant", calls).otherwise(F.lit(0)) + F.when(F.col("role") == "tool", F.length(F.coalesce("call_id", F.lit("")))).otherwise(F.lit(0)) + F.length("role") + F.length(F.coalesce("name", F.lit("")))
    return (F.ceil(chars / 3.3) + 3).cast("int")


def trim_last(rows: DataFrame, budget: int = 4000) -> DataFrame:
    """conv_id, idx, role and content of a leading system message and the newest messages that fit beside it, the one that crosses the budget by its last lines, from the first user message of these on."""
    first_system = (F.col("pos") == 0) & (F.col("role") == "system")
    df = rows.withColumn("_t", approximate_tokens("content")).withColumn("_lead", first_system)
    df = df.withColumn("_budget", F.lit(budget) - F.coalesce(F.max(F.when(F.col("_lead"), F.col("_t"))).over(_BY()), F.lit(0)))
    df = df.withColumn("_after", F.sum(F.when(F.col("_lead"), 0).otherwise(F.col("_t"))).over(_AFTER()))
    left = F.col("_budget") - (F.col("_after") - F.col("_t"))
    crossing = ~F.col("_lead") & (F.col("_after") > F.col("_budget")) & (F.row_number().over(W.partitionBy("conv_id", ~F.col("_lead") & (F.col("_after") > F.col("_budget"))).orderBy(F.desc("pos"))) == 1)
    df = df.withColumn("_left", left).withColumn("_crossing", crossing)
    lines = F.split("content", "\n")
    tails = F.transform(F.sequence(F.lit(1), F.size(lines)), lambda k: F.array_join(F.slice(lines, F.size(lines) - k + 1, k), "\n"))
    fitting = F.filter(tails, lambda t: approximate_tokens(t) <= F.col("_left"))
    part = F.when(F.col("_crossing"), F.get(fitting, F.size(fitting) - 1))
    df = df.withColumn("content", F.when(F.col("_crossing"), part).otherwise(F.col("content"))).filter(F.col("_lead") | (F.col("_after") <= F.col("_budget")) | (F.col("_crossing") & F.col("content").isNotNull()))
    df = df.withColumn("_from", F.min(F.when(~F.col("_lead") & (F.col("role") == "user"), F.col("pos"))).over(_BY()))
    return df.filter(F.col("_lead") | (F.col("pos") >= F.col("_from"))).select("conv_id", "idx", "role", "content")


def half_split(rows: DataFrame, limit: int = 8192, least: int = 4) -> DataFrame:
    """conv_id and split, the number of messages to summarize (null: the history fits): the rest stays under half the limit and begins after an answer; all of them where there are few, or few would be left to summarize."""
    cost = F.ceil(T.u16len("message_json") / 4)
    df = rows.withColumn("_after", F.sum(cost).over(_AFTER())).withColumn("_n", _n())
    df = df.withColumn("_split", F.coalesce(F.min(F.when(F.col("_after") < limit // 2, F.col("pos"))).over(_BY()), F.col("_n")))
    answer = F.max(F.when((F.col("role") == "assistant") & (F.col("pos") < F.col("_split")), F.col("pos") + 1))
    per = df.groupBy("conv_id").agg(F.max("_n").alias("n"), F.max("_after").alias("total"), F.coalesce(answer, F.lit(1)).alias("split"))
    out = F.when(F.col("total") <= limit, None).when((F.col("n") <= least) | (F.col("split") <= least), F.col("n")).otherwise(F.col("split"))
    return per.select("conv_id", out.cast("int").alias("split"))


def rough_tokens() -> Column:
    """4 characters a token of content and arguments, each rounded down, and 10."""
    return (F.floor(T.u16len("content") / 4) + 10 + F.aggregate(F.transform("calls", lambda c: F.floor(F.length(c["args"]) / 4).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)).cast("int")


def middle(rows: DataFrame, budget: int, head: int = 3, least: int = 3) -> DataFrame:
    """conv_id, head_end and cut: the messages between them are to be summarized. The head takes the results after it; the tail fits budget × 1.5, has at least ``least``, does not part a call from its results, and holds the last user message."""
    n = F.col("n")
    df = rows.withColumn("n", _n()).withColumn("_after", F.sum(rough_tokens()).over(_AFTER()))
    df = df.withColumn("h", F.coalesce(F.min(F.when((F.col("pos") >= head) & (F.col("role") != "tool"), F.col("pos"))).over(_BY()), n))
    df = df.withColumn("_least", F.when(n - F.col("h") > 1, F.least(F.lit(least), n - F.col("h") - 1)).otherwise(0))
    inside = (F.col("pos") >= F.col("h")) & ((F.col("_after") <= int(budget * 1.5)) | (n - F.col("pos") < F.col("_least")))
    df = df.withColumn("_cut", F.least(F.coalesce(F.min(F.when(inside, F.col("pos"))).over(_BY()), n), n - F.col("_least")))
    df = df.withColumn("_cut", F.when(F.col("_cut") <= F.col("h"), F.greatest(n - F.col("_least"), F.col("h") + 1)).otherwise(F.col("_cut")))
    before = F.max_by(F.struct("pos", (F.col("role") == "assistant") & (F.size("calls") > 0)), F.when((F.col("pos") < F.col("_cut")) & (F.col("role") != "tool"), F.col("pos")))
    user = F.max(F.when((F.col("role") == "user") & (F.col("pos") >= F.col("h")), F.col("pos")))
    per = df.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("h").alias("h"), F.max("_cut").alias("cut"), before.alias("b"), user.alias("user"))
    cut = F.when((F.col("cut") > 0) & (F.col("cut") < F.col("n")) & F.coalesce(F.col("b.col2"), F.lit(False)), F.col("b.pos")).otherwise(F.col("cut"))
    per = per.withColumn("cut", cut)
    per = per.withColumn("cut", F.when(F.col("user") < F.col("cut"), F.greatest(F.col("user"), F.col("h") + 1)).otherwise(F.col("cut")))
    return per.select("conv_id", F.col("h").cast("int").alias("head_end"), F.greatest(F.col("cut"), F.col("h") + 1).cast("int").alias("cut"))


def result_line(tool: Column, args: Column, content: Column) -> Column:
    """One line for an old tool result, by its tool."""
    get = lambda k, other: F.coalesce(F.get_json_object(args, f"$.{k}"), F.lit(other))
    size = F.format_number(T.u16len(content), 0)
    lines = F.when(F.trim(content) != "", F.size(F.split(content, "\n"))).otherwise(0).cast("string")
    found = lambda p: F.coalesce(F.nullif(F.regexp_extract(content, p, 1), F.lit("")), F.lit("?"))
    cut = lambda c, most, head: F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit("..."))).otherwise(c)
    written = F.get_json_object(args, "$.content")
    pairs = F.slice(F.map_entries(F.coalesce(F.from_json(args, "map<string,string>"), F.create_map().cast("map<string,string>"))), 1, 2)
    some = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit(" "), p["key"], F.lit("="), F.substring(F.coalesce(p["value"], F.lit("null")), 1, 40))), "")
    by = {
        "terminal": F.concat(F.lit("[terminal] ran `"), cut(get("command", ""), 80, 77), F.lit("` -> exit "), found(r'"exit_code"\s*:\s*(-?\d+)'), F.lit(", "), lines, F.lit(" lines output")),
        "read_file": F.concat(F.lit("[read_file] read "), get("path", "?"), F.lit(" from line "), get("offset", "1"), F.lit(" ("), size, F.lit(" chars)")),
        "write_file": F.concat(F.lit("[write_file] wrote to "), get("path", "?"), F.lit(" ("), F.when(F.coalesce(written, F.lit("")) != "", F.size(F.split(written, "\n")).cast("string")).otherwise("?"), F.lit(" lines)")),
        "search_files": F.concat(F.lit("[search_files] "), get("target", "content"), F.lit(" search for '"), get("pattern", "?"), F.lit("' in "), get("path", "."), F.lit(" -> "), found(r'"total_count"\s*:\s*(\d+)'), F.lit(" matches")),
        "patch": F.concat(F.lit("[patch] "), get("mode", "replace"), F.lit(" in "), get("path", "?"), F.lit(" ("), size, F.lit(" chars result)")),
        "web_search": F.concat(F.lit("[web_search] query='"), get("query", "?"), F.lit("' ("), size, F.lit(" chars result)")),
        "execute_code": F.concat(F.lit("[execute_code] `"), F.translate(F.substring(get("code", ""), 1, 60), "\n", " "), F.when(F.length(get("code", "")) > 60, "...").otherwise(""), F.lit("` ("), lines, F.lit(" lines output)")),
    }
    out = F.concat(F.lit("["), tool, F.lit("]"), some, F.lit(" ("), size, F.lit(" chars result)"))
    for name, line in by.items():
        out = F.when(tool == name, line).otherwise(out)
    return out


def shortened(args: Column, most: int = 500, head: int = 200) -> Column:
    """Arguments over ``most`` characters with every long string in them cut; what is no JSON is cut as a whole."""

    def shrink(v):
        if isinstance(v, str):
            return v if len(v) <= head else f"{v[:head]}...[truncated {len(v) - head} chars]"
        if isinstance(v, list):
            return [shrink(x) for x in v]
        return {k: shrink(x) for k, x in v.items()} if isinstance(v, dict) else v

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return json.dumps(shrink(json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return f"{t[:head]}..."

        return texts.map(lambda t: t if t is None or len(t) <= most else one(t))

    return run(args)


def prune_results(rows: DataFrame, protect: int = 20, protect_tokens: int = 0, least: int = 200) -> DataFrame:
    """conv_id, idx, role, content and args: copies of a tool result of ``least`` characters become a note, all but the newest; before the protected end, longer results become a line and long arguments are shortened.

    The end is the last messages, or (with protect_tokens) from the message that crosses so many tokens on, ``protect`` at least. args: of a message's calls, in order.
    """
    n = _n()
    df = rows.withColumn("_n", n).withColumn("_after", F.sum(rough_tokens()).over(_AFTER()))
    fewest = F.least(F.lit(protect), F.col("_n"))
    over = (F.col("_after") > protect_tokens) & (F.col("_n") - F.col("pos") >= fewest)
    boundary = F.coalesce(F.max(F.when(over, F.col("pos"))).over(_BY()), F.lit(0)) if protect_tokens else F.col("_n")
    df = df.withColumn("_end", F.least(boundary, F.col("_n") - (fewest if protect_tokens else F.lit(protect))))
    is_long = (F.col("role") == "tool") & (T.u16len("content") >= least)
    newest = F.row_number().over(W.partitionBy("conv_id", is_long, F.substring(F.md5("content"), 1, 12)).orderBy(F.desc("pos"))) == 1
    df = df.withColumn("_copy", is_long & ~newest)
    calls = rows.select("conv_id", "pos", F.explode("calls").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "pos", F.coalesce("c.name", F.lit("unknown")).alias("tool"), F.col("c.args").alias("tool_args"))
    calls = calls.groupBy("conv_id", "call_id").agg(F.max_by("tool", "pos").alias("tool"), F.max_by("tool_args", "pos").alias("tool_args"))
    df = df.join(calls, ["conv_id", "call_id"], "left").withColumn("tool", F.coalesce("tool", F.lit("unknown"))).withColumn("tool_args", F.coalesce("tool_args", F.lit("")))
    old = (F.col("pos") < F.col("_end")) & (F.col("role") == "tool") & (T.u16len("content") > least)
    text = F.when(F.col("_copy"), F.lit(DUPLICATE)).when(old, result_line(F.col("tool"), F.col("tool_args"), F.col("content"))).otherwise(F.col("content"))
    parts = df.select("conv_id", "pos", "_end", F.posexplode("calls").alias("k", "c")).select("conv_id", "pos", "k", F.when(F.col("pos") < F.col("_end"), shortened(F.col("c.args"))).otherwise(F.col("c.args")).alias("a"))
    args = parts.groupBy("conv_id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "a"))), lambda x: x["a"]).alias("args"))
    return df.join(args, ["conv_id", "pos"], "left").select("conv_id", "idx", "role", text.alias("content"), "args")


def as_xml(rows: DataFrame) -> DataFrame:
    """conv_id and its messages as XML elements, calls as elements of their own with spaced JSON."""
    attribute = lambda c: F.concat(F.lit('"'), F.replace(T.xml_escape(F.coalesce(c, F.lit(""))), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    kind = F.lit("system")
    for role, name in TYPE_NAMES.items():
        kind = F.when(F.col("role") == role, name).otherwise(kind)
    spaced = lambda a: F.when(a == "", "{}").otherwise(F.regexp_replace(a, r'([,:])(?=(?:[^"]*"(?:[^"\\]|\\.)*")*[^"]*\z)', "$1 "))
    call = lambda c: F.concat(F.lit("  <tool_call id="), attribute(c["id"]), F.lit(" name="), attribute(c["name"]), F.lit(">"), T.xml_escape(spaced(c["args"])), F.lit("</tool_call>"))
    body = T.xml_escape("content")
    open_ = F.concat(F.lit("<message type="), attribute(kind), F.lit(">"))
    inner = F.when(F.col("content") != "", F.concat(F.lit("  <content>"), body, F.lit("</content>")))
    with_calls = F.concat_ws("\n", open_, inner, F.array_join(F.transform("calls", call), "\n"), F.lit("</message>"))
    line = F.when((F.col("role") == "assistant") & (F.size("calls") > 0), with_calls).otherwise(F.concat(open_, body, F.lit("</message>")))
    lines = F.sort_array(F.collect_list(F.struct("pos", line.alias("x"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["x"]), "\n").alias("xml"))


def as_turns(rows: DataFrame, most: int = 1500, head: int = 1200) -> DataFrame:
    """conv_id and its messages as text for a summary: long contents lose their middle, long arguments their end."""
    body = T.clip_middle("content")
    args = lambda a: F.when(F.length(a) > most, F.concat(F.substring(a, 1, head), F.lit("..."))).otherwise(a)
    calls = F.concat(F.lit("\n[Tool calls:\n"), F.array_join(F.transform("calls", lambda c: F.concat(F.lit("  "), F.coalesce(c["name"], F.lit("?")), F.lit("("), args(c["args"]), F.lit(")"))), "\n"), F.lit("\n]"))
    line = (
        F.when(F.col("role") == "tool", F.concat(F.lit("[TOOL RESULT "), F.coalesce("call_id", F.lit("")), F.lit("]: "), body))
        .when((F.col("role") == "assistant") & (F.size("calls") > 0), F.concat(F.lit("[ASSISTANT]: "), body, calls)).otherwise(F.concat(F.lit("["), F.upper("role"), F.lit("]: "), body))
    )
    lines = F.sort_array(F.collect_list(F.struct("pos", line.alias("x"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["x"]), "\n\n").alias("serialized"))


def without_open_calls(rows: DataFrame) -> DataFrame:
    """The rows without the calls at their end that nothing answers."""
    call = (F.col("role") == "assistant") & (F.size("calls") > 0)
    return rows.withColumn("_last", F.max(F.when(~call, F.col("pos"))).over(_BY())).filter("pos <= _last").drop("_last")


def real_query(rows: DataFrame) -> DataFrame:
    """conv_id and the newest user message's text, its wrapper taken off; none without any."""
    last = rows.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("content", "pos").alias("t"))
    inside = F.regexp_extract("t", r"(?s)<user_query>\n?(.*?)\n?</user_query>", 1)
    text = F.trim(F.when(F.col("t").rlike(r"(?s)<user_query>.*?</user_query>"), inside).otherwise(F.col("t")))
    return last.select("conv_id", text.alias("query")).filter("query <> ''")


def summary_of(text: Column) -> Column:
    """A written summary: scratch before it taken off, what stands between its tags (if it has them) under a heading, control tags disarmed, blank lines collapsed."""
    strip = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    before = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(?s)\A(.*?)<summary>", 1), r"(?s)<analysis>.*?</analysis>", ""), r"(?s)<analysis>.*\z", "")
    inner = strip(F.regexp_extract(text, r"(?s)<summary>(.*)</summary>", 1))
    scratch = ~inner.rlike(r"\A[#*\->\s]*\d") & inner.contains("</analysis>")  # unless it begins with a number, all up to the last end of scratch goes
    inner = F.regexp_replace(F.when(scratch, F.regexp_replace(inner, r"(?s)\A.*</analysis>\s*", "")).otherwise(inner), r"\A<summary>\s*", "")
    after = F.regexp_extract(text, r"(?s).*</summary>(.*)\z", 1)
    tagged = text.rlike(r"(?s)<summary>.*</summary>")
    whole = F.when(tagged, F.concat(before, F.lit("Summary:\n"), inner, after)).otherwise(F.regexp_replace(text, r"(?s)\A(?:\s*<analysis>.*?</analysis>)+", ""))
    safe = F.regexp_replace(whole, "<(/?(?:summary|analysis|summary_request))>", "<\u200b$1>")
    return strip(F.regexp_replace(safe, r"\n{3,}", "\n\n"))


def assembled(rows: DataFrame, before: list[tuple[str, Column]], tail: DataFrame | None = None, after: list[tuple[str, Column]] = (), summaries: DataFrame | None = None) -> DataFrame:
    """conv_id, idx, role and content: system messages, then messages made from ``summaries`` (conv_id and columns) before and after a tail of rows; made messages that are null are left out."""
    made = lambda part, some: None if not some else (
        summaries.select("conv_id", F.lit(part).alias("part"), F.posexplode(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in some])).alias("at", "m")).select("conv_id", "part", "at", "m.*").filter("content is not null")
    )
    own = rows.filter("role = 'system'").select("conv_id", F.lit(0).alias("part"), F.col("pos").alias("at"), "role", "content")
    parts = [own, made(1, before), None if tail is None else tail.select("conv_id", F.lit(2).alias("part"), F.col("pos").alias("at"), "role", "content"), made(3, list(after))]
    out = None
    for p in parts:
        out = p if out is None else out if p is None else out.unionByName(p)
    return out.select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("part", "at")) - 1).alias("idx"), "role", "content")


#: From rows to rows with conv_id, idx and message_json; open to more.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"prune": lambda rows: prune_parts(rows, 6), "last": lambda rows: keep_last(rows, 10), "closed": without_open_calls}
