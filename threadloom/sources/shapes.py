"""Histories of one shape as another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.normalize import parsed, role_of, with_format


def quote(c: Column) -> Column:
    """A string as JSON; null as null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", ""), F.lit("null"))


def to_openai(messages: DataFrame) -> DataFrame:
    """Messages with tool_calls and tool messages: each result block is a tool message of its own, and comes before the text beside it. Messages are numbered anew."""
    df = with_format(parsed(messages)).withColumn("role", role_of())
    m, b = F.col("m"), F.col("blocks")
    of = lambda *kinds: F.filter(b, lambda x: F.coalesce(x["type"], F.lit("text")).isin(*kinds))
    text = F.when(b.isNotNull(), F.array_join(F.transform(of("text"), lambda x: x["text"]), "\n")).otherwise(F.coalesce(F.when(m["content"].startswith("{"), F.get_json_object("message_json", "$.content.text")), m["content"], F.lit("")))
    legacy = F.when(F.coalesce(m["function_call"]["name"], F.lit("")) != "", F.array(F.struct(F.concat(F.lit("function:"), m["function_call"]["name"]).alias("id"), m["function_call"]["name"].alias("name"), m["function_call"]["arguments"].alias("args"))))
    from_blocks = F.transform(of("tool_use"), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["input"].alias("args")))
    from_calls = F.transform(m["tool_calls"], lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["function"]["name"], x["name"]).alias("name"), F.coalesce(x["function"]["arguments"], x["args"]).alias("args")))
    calls = F.coalesce(F.when(F.size(of("tool_use")) > 0, from_blocks), from_calls, legacy, F.array().cast("array<struct<id:string,name:string,args:string>>"))
    call = lambda x: F.concat(F.lit('{"id":'), quote(x["id"]), F.lit(',"type":"function","function":{"name":'), quote(x["name"]), F.lit(',"arguments":'), quote(F.coalesce(x["args"], F.lit("{}"))), F.lit("}}"))
    with_calls = F.concat(F.lit('{"role":"assistant","content":'), F.when(text == "", F.lit("null")).otherwise(quote(text)), F.lit(',"tool_calls":['), F.array_join(F.transform(calls, call), ","), F.lit("]}"))
    tool = lambda id_, content: F.concat(F.lit('{"role":"tool","tool_call_id":'), quote(id_), F.lit(',"content":'), quote(F.coalesce(content, F.lit(""))), F.lit("}"))
    plain = F.concat(F.lit('{"role":'), quote(F.col("role")), F.lit(',"content":'), quote(text), F.lit("}"))
    results = F.transform(of("tool_result"), lambda x: tool(x["tool_use_id"], x["content"]))
    out = (
        F.when(F.coalesce(F.size(of("tool_result")), F.lit(0)) > 0, F.concat(results, F.when(text != "", F.array(plain)).otherwise(F.array().cast("array<string>"))))
        .when(F.col("role") == "tool", F.array(tool(F.coalesce(m["tool_call_id"], F.concat(F.lit("function:"), m["name"])), text)))
        .when((F.col("role") == "assistant") & (F.size(calls) > 0), F.array(with_calls)).otherwise(F.array(plain))
    )
    rows = df.select("conv_id", "idx", F.posexplode(out).alias("part", "message_json"))
    return rows.select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("idx", "part")) - 1).alias("idx"), "message_json")


def append_system(system: Column, addendum: Column) -> Column:
    """A system prompt (a JSON string, a JSON array of blocks, or null) with an addendum."""
    block = F.concat(F.lit('{"type":"text","text":'), quote(addendum), F.lit("}"))
    as_array = F.concat(F.regexp_replace(system, r"\]\s*\z", ""), F.when(F.regexp_replace(system, r"\s", "") == "[]", "").otherwise(","), block, F.lit("]"))
    inside = F.get_json_object(F.concat(F.lit('{"s":'), system, F.lit("}")), "$.s")
    return F.when(addendum.isNull(), system).when(system.isNull() | (system == "null"), quote(addendum)).when(system.startswith("["), as_array).otherwise(quote(F.concat(inside, F.lit("\n\n"), addendum)))
