"""Messages to frames: format, role, kind, text, paths, code, tool calls, hash, tokens.

A message is raw JSON text; it is parsed once, into a fixed struct, and everything
after is columns (content that is an array is parsed as blocks). The format is that
of a whole history: the greatest of its rows' marks, a window over the conversation
whose exchange serves all that follows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Names of roles in the shapes that are read.
LANGCHAIN_TYPES = {"human": "user", "ai": "assistant", "system": "system", "tool": "tool", "function": "tool"}
ROLE_ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "tool": "tool", "function": "tool"}

_BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>"
_CALL = "struct<id:string,name:string,args:string,function:struct<name:string,arguments:string>>"
_SHAPE = f"role string, type string, name string, tool_call_id string, content string, function_call struct<name:string,arguments:string>, tool_calls array<{_CALL}>, pin boolean"


def _lookup(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*names.items())])[key]


def _blocks() -> Column:
    return F.when(F.col("is_list"), F.from_json(F.col("m.content"), f"array<{_BLOCK}>"))


def parsed(messages: DataFrame) -> DataFrame:
    """Adds ``m`` (the message's fields), ``is_list`` (whether its content is an array) and ``blocks`` (that array)."""
    j = F.col("message_json")
    df = messages.withColumn("m", F.from_json(j, _SHAPE))
    a_list = j.rlike(r'"content"\s*:\s*\[') & F.coalesce(F.col("m.content").startswith("["), F.lit(False))
    return df.withColumn("is_list", a_list).withColumn("blocks", _blocks())


def format_markers() -> dict[str, Column]:
    """Whether a row shows one of the formats."""
    m, j = F.col("m"), F.col("message_json")
    lang = m["type"].isin(*LANGCHAIN_TYPES) | (j.contains('"lc_kwargs"') & F.get_json_object(j, "$.lc_kwargs").isNotNull())
    lang = F.coalesce(lang, F.lit(False))
    # presence counts, even of null: keys are looked for in the object, not values; most rows don't have the words at all
    keys = F.when(j.rlike('"(?:tool_calls|tool_call_id|function_call)"'), F.json_object_keys(j))
    called = F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, ("tool_calls", "tool_call_id", "function_call")))), F.lit(False))
    open_ai = called | F.coalesce(m["role"].isin("tool", "function"), F.lit(False))
    return {
        "anthropic": F.coalesce(F.exists("blocks", lambda b: b["type"].isin("tool_use", "tool_result")), F.lit(False)),
        "openai": open_ai & ~lang,
        "langchain": lang,
    }


#: Formats from the weakest to the strongest mark.
FORMATS = ("plain", "langchain", "openai", "anthropic")


def format_mark() -> Column:
    """The strongest mark of a row, as a place in FORMATS."""
    marks = format_markers()
    return F.when(marks["anthropic"], 3).when(marks["openai"], 2).when(marks["langchain"], 1).otherwise(0)


def detect_format(df: DataFrame) -> DataFrame:
    """conv_id and format of each history; needs ``m`` and ``blocks``."""
    return df.groupBy("conv_id").agg(F.max(format_mark()).alias("mark")).select("conv_id", _format(F.col("mark")).alias("format"))


def _format(mark: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FORMATS)), mark + 1)


def with_format(df: DataFrame) -> DataFrame:
    """Adds the format of the row's history; needs ``m`` and ``blocks``."""
    return df.withColumn("_mark", format_mark()).withColumn("format", _format(F.max("_mark").over(W.partitionBy("conv_id")))).drop("_mark")


def role_of(fmt: Column | str = "format") -> Column:
    m = F.col("m")
    by_type = _lookup(LANGCHAIN_TYPES, m["type"])
    return F.coalesce(F.when((F.col(fmt) if isinstance(fmt, str) else fmt) == "langchain", by_type), _lookup(ROLE_ALIASES, m["role"]), by_type, F.lit("user"))


def _line(label: str, name: Column, id_: Column, rest: Column) -> Column:
    empty = F.lit("")
    return F.concat(F.lit(f"[{label} "), F.coalesce(name, empty), F.lit(" "), F.coalesce(id_, empty), F.lit("] "), F.coalesce(rest, empty))


def content_text() -> Column:
    """Text of the content: a string as it is, blocks line by line, an object's text."""
    inner = lambda c: F.coalesce(F.array_join(F.transform(F.from_json(c, "array<struct<type:string,text:string>>"), lambda b: F.coalesce(b["text"], F.concat(F.lit("["), F.coalesce(b["type"], F.lit("unknown")), F.lit("]")))), "\n"), c, F.lit(""))
    block = lambda b: (
        F.when((F.coalesce(b["type"], F.lit("text")) == "text") & b["text"].isNotNull(), b["text"])
        .when(b["type"] == "tool_use", _line("tool_use", b["name"], b["id"], b["input"]))
        .when(b["type"] == "tool_result", F.concat(F.lit("[tool_result "), F.coalesce(b["tool_use_id"], F.lit("")), F.lit("] "), F.when(b["content"].startswith("["), inner(b["content"])).otherwise(F.coalesce(b["content"], F.lit("")))))
        .otherwise(F.concat(F.lit("["), F.coalesce(b["type"], F.lit("unknown")), F.lit("]")))
    )
    plain = F.col("m.content")
    return F.when(F.col("blocks").isNotNull(), F.array_join(F.transform("blocks", block), "\n")).otherwise(F.coalesce("object_text", plain, F.lit("")))


def call_infos() -> Column:
    """Tool calls as an array of (id, name, line), a legacy call first."""
    m = F.col("m")
    legacy = m["function_call"]
    info = "array<struct<id:string,name:string,line:string>>"
    legacy_id = F.concat(F.lit("function:"), legacy["name"])
    first = F.when(F.coalesce(legacy["name"], F.lit("")) != "", F.array(F.struct(legacy_id.alias("id"), legacy["name"].alias("name"), F.concat(F.lit("[tool_call "), legacy["name"], F.lit(" "), legacy_id, F.lit("] "), F.coalesce(legacy["arguments"], F.lit(""))).alias("line"))))
    one = lambda c: F.struct(c["id"].alias("id"), F.coalesce(c["function"]["name"], c["name"]).alias("name"), _line("tool_call", F.coalesce(c["function"]["name"], c["name"]), c["id"], F.when(c["function"].isNotNull(), c["function"]["arguments"]).otherwise(c["args"])).alias("line"))
    none = F.array().cast(info)
    return F.concat(F.coalesce(first.cast(info), none), F.coalesce(F.transform(m["tool_calls"], one).cast(info), none))


def normalize(messages: DataFrame, fmt: str = "auto", pin: Column | None = None, count_tokens: Callable[[Column], Column] = T.est_tokens) -> DataFrame:
    """Frames of messages(conv_id, idx, message_json). ``pin`` is a predicate Column over the messages' columns, ``count_tokens`` a function of a message's JSON."""
    df = parsed(messages)
    own = F.coalesce(F.col("m.pin"), F.lit(False)) | (F.coalesce(pin, F.lit(False)) if pin is not None else F.lit(False))
    # before the exchange: what needs the raw message; blocks are made again after it
    df = df.withColumn("object_text", F.when(~F.col("is_list") & F.col("m.content").startswith("{"), F.get_json_object("message_json", "$.content.text")))
    df = df.withColumns({"pinned": own, "tokens": count_tokens(F.col("message_json")), "_mark": format_mark() if fmt == "auto" else F.lit(0)}).select("conv_id", "idx", "m", "is_list", "object_text", "pinned", "tokens", "_mark")
    fmt_ = _format(F.max("_mark").over(W.partitionBy("conv_id"))) if fmt == "auto" else F.lit(fmt)
    df = df.withColumn("format", fmt_).withColumn("blocks", _blocks())
    df = df.withColumn("role", role_of()).withColumn("calls", call_infos())
    m, blocks = F.col("m"), F.coalesce("blocks", F.array().cast(f"array<{_BLOCK}>"))
    some = lambda a: F.filter(a, lambda x: F.coalesce(x, F.lit("")) != "")
    uses, results = F.filter(blocks, lambda b: b["type"] == "tool_use"), F.filter(blocks, lambda b: b["type"] == "tool_result")
    in_order = F.transform(F.filter(blocks, lambda b: b["type"].isin("tool_use", "tool_result")), lambda b: F.when(b["type"] == "tool_use", b["id"]).otherwise(b["tool_use_id"]))
    is_named = (F.col("role") == "tool") & (F.coalesce(m["name"], F.lit("")) != "")
    ids = F.array_distinct(some(F.concat(
        F.transform("calls", lambda c: c["id"]), in_order, F.array(m["tool_call_id"]),
        F.array(F.when(is_named & (m["role"] == "function") & m["tool_call_id"].isNull(), F.concat(F.lit("function:"), m["name"]))),
    )))
    names = some(F.concat(F.transform("calls", lambda c: c["name"]), F.transform(uses, lambda b: b["name"]), F.array(F.when(is_named, m["name"]))))
    issues = (F.size("calls") > 0) | (F.size(uses) > 0)
    kind = (
        F.when(F.col("role") == "system", "system").when(F.col("role") == "tool", "tool_result").when((F.col("role") == "assistant") & issues, "tool_call")
        .when((F.col("role") == "user") & (F.size(results) > 0), "tool_result").otherwise(F.col("role"))
    )
    body = content_text()
    text = F.when(F.size("calls") == 0, body).otherwise(F.array_join(F.concat(F.when(body == "", F.array().cast("array<string>")).otherwise(F.array(body)), F.transform("calls", lambda c: c["line"])), "\n"))
    df = df.withColumn("kind", kind).withColumn("text", text).withColumn("tool_call_ids", ids).withColumn("tool_names", names)
    return df.select(
        "conv_id", "idx", "format", "role", "kind", "text", T.u16len("text").alias("chars"), "tokens", T.paths("text").alias("paths"),
        T.has_code("text").alias("has_code"), "tool_call_ids", "tool_names", T.content_hash("role", "text").alias("hash"), "pinned",
    )


GOAL_CHARS = 500


def default_goals(frames: DataFrame) -> DataFrame:
    """conv_id and the text of the last user frame, at most 500 characters; '' without one."""
    last = F.max_by(F.when(F.col("kind") == "user", F.col("text")), F.when(F.col("kind") == "user", F.col("idx")))
    return frames.groupBy("conv_id").agg(F.coalesce(F.substring(last, 1, GOAL_CHARS), F.lit("")).alias("goal"))


def resolve_goals(frames: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Goals given (conv_id, goal), else the default ones."""
    own = default_goals(frames)
    if goals is None:
        return own
    given = goals.select("conv_id", F.col("goal").alias("given"))
    return own.join(given, "conv_id", "left").select("conv_id", F.coalesce("given", "goal").alias("goal"))


def history_tokens(frames: DataFrame) -> DataFrame:
    return frames.groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("messages"))


def transcripts(frames: DataFrame) -> DataFrame:
    """conv_id and the whole history as text: [role] text, a blank line between messages."""
    lines = F.array_sort(F.collect_list(F.struct("idx", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))))
    return frames.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("transcript"))


def conversation_keys(messages: DataFrame) -> DataFrame:
    """conv_id and sha1 of the first user message's JSON, else of the first message's."""
    df = parsed(messages)
    user = (F.col("m.role") == "user") | (F.col("m.type") == "human")
    first = F.coalesce(F.min_by(F.when(user, F.col("message_json")), F.when(user, F.col("idx"))), F.min_by("message_json", "idx"))
    return df.groupBy("conv_id").agg(F.sha1(first).alias("conversation_key"))
