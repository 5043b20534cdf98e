"""Readers of histories from JSON and JSONL files, and writers of results."""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import CompactionError


def read_json(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """messages of files that hold an array of messages, or an object with ``messages``; conv_id is the file's URI.

    With ``strict`` a file of another shape, or an element that isn't an object, is an error when the rows are read.
    """
    return history_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conv_id"), F.col("value").alias("json")), strict)


def history_rows(histories: DataFrame, strict: bool = True) -> DataFrame:
    """messages of rows (conv_id, json)."""
    v = F.try_parse_json("json")
    raw = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.col("json")).otherwise(F.get_json_object("json", "$.messages"))
    items = F.from_json(raw, "array<string>")
    bad = items.isNull() | F.exists(items, lambda x: x.isNull() | ~x.startswith("{"))
    if strict:
        items = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("not a list of messages: "), "conv_id")).cast("array<string>")).otherwise(items)
    else:
        items = F.filter(items, lambda x: x.startswith("{"))
    return histories.select("conv_id", F.posexplode(items).alias("idx", "message_json"))


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """messages of session logs, one object to a line: user and assistant entries whose message has the same role.

    Lines are numbered by their place in the whole file, so a log is read as one row; blank and broken lines are left out.
    """
    return session_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conv_id"), F.col("value").alias("log")))


def session_rows(logs: DataFrame) -> DataFrame:
    """messages of rows (conv_id, log)."""
    lines = logs.select("conv_id", F.posexplode(F.split("log", r"\r?\n")).alias("line", "json")).filter(F.trim("json") != "")
    lines = lines.filter(F.try_parse_json("json").isNotNull())
    field = lambda p: F.get_json_object("json", p)
    lines = lines.filter(field("$.type").isin("user", "assistant") & (field("$.message.role") == field("$.type")))
    raw = F.coalesce(F.get_json_object("json", "$.message"))
    message = F.when(field("$.message.content").isNull(), F.to_json(F.struct(field("$.message.role").alias("role"), F.lit("").alias("content")))).otherwise(raw)
    w = W.partitionBy("conv_id").orderBy("line")
    return lines.select("conv_id", (F.row_number().over(w) - 1).alias("idx"), message.alias("message_json"))


def read_stdin(spark: SparkSession, stream=None) -> DataFrame:
    """messages of one history on standard input, as JSON."""
    text = (stream or sys.stdin).read()
    return shaped_rows(spark.createDataFrame([("stdin", text)], "conv_id string, json string"))


def shaped_rows(histories: DataFrame, strict: bool = True) -> DataFrame:
    """messages of rows (conv_id, json); histories whose messages have toolUses or toolResults are brought to blocks."""
    rows = history_rows(histories, strict)
    other = F.col("message_json").rlike('"(?:toolUses|toolResults)"') & F.arrays_overlap(F.json_object_keys("message_json"), F.array(F.lit("toolUses"), F.lit("toolResults")))
    marked = rows.withColumn("_other", F.max(F.coalesce(other, F.lit(False))).over(W.partitionBy("conv_id")))
    return marked.filter("not _other").drop("_other").unionByName(tool_uses_shape(marked.filter("_other").drop("_other")))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A reader by the file's extension (``-``: standard input) and by the shape of its messages."""
    if path == "-":
        return read_stdin(spark)
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path)
    if path.endswith(".json"):
        return shaped_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("conv_id"), F.col("value").alias("json")))
    raise CompactionError(f"neither .json nor .jsonl: {path}")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All .json and .jsonl files below a folder, by Spark's own listing."""
    texts = lambda glob: spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("conv_id"), "value")
    return history_rows(texts("*.json").withColumnRenamed("value", "json")).unionByName(session_rows(texts("*.jsonl").withColumnRenamed("value", "log")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; a larger one ends with a line that says how many rows are left out."""
    rows = df.limit(most + 1).collect()
    left = df.count() - most if len(rows) > most else 0
    rows = rows[:most]
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows), *[f"\n{left} more rows"] * (left > 0)])


def load_env(start: str = ".", most: int = 6) -> dict[str, str]:
    """Settings of the nearest folder, of at most ``most`` upwards, with .env.local or .env; the first file wins, the environment over both."""
    at = os.path.abspath(start)
    for _ in range(most):
        out: dict[str, str] = {}
        for name in (".env.local", ".env"):
            file = os.path.join(at, name)
            if os.path.isfile(file):
                with open(file, encoding="utf-8") as lines:
                    out = parse_env(lines.read()) | out
        if out:
            return {k: os.environ.get(k, v) for k, v in out.items()}
        at, before = os.path.dirname(at), at
        if at == before:
            break
    return {}


def parse_env(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        if not sep or key.strip().startswith("#") or not key.strip():
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        elif " #" in value:
            value = value.split(" #")[0].rstrip()
        out[key.strip()] = value
    return out


def tool_uses_shape(messages: DataFrame) -> DataFrame:
    """Messages of the shape {role, text, toolUses, toolResults} as messages with blocks: results, then text, then uses; text alone stays a string."""
    shape = "role string, text string, toolUses array<struct<tool_use_id:string,tool:string,input:string>>, toolResults array<struct<tool_use_id:string,text:string>>"
    m = F.from_json("message_json", shape)
    quote = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]\z", "")
    none = F.array().cast("array<string>")
    results = F.transform(F.coalesce(m["toolResults"], F.array().cast("array<struct<tool_use_id:string,text:string>>")), lambda r: F.concat(F.lit('{"type":"tool_result","tool_use_id":'), quote(r["tool_use_id"]), F.lit(',"content":'), quote(F.coalesce(r["text"], F.lit(""))), F.lit("}")))
    uses = F.transform(F.coalesce(m["toolUses"], F.array().cast("array<struct<tool_use_id:string,tool:string,input:string>>")), lambda u: F.concat(F.lit('{"type":"tool_use","id":'), quote(u["tool_use_id"]), F.lit(',"name":'), quote(u["tool"]), F.lit(',"input":'), F.coalesce(u["input"], F.lit("{}")), F.lit("}")))
    text = F.coalesce(m["text"], F.lit(""))
    own = F.when(text == "", none).otherwise(F.array(F.concat(F.lit('{"type":"text","text":'), quote(text), F.lit("}"))))
    blocks = F.concat(results, own, uses)
    alone = (F.size(results) == 0) & (F.size(uses) == 0)
    content: Column = F.when(alone, quote(text)).otherwise(F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]")))
    return messages.select("conv_id", "idx", F.concat(F.lit('{"role":'), quote(m["role"]), F.lit(',"content":'), content, F.lit("}")).alias("message_json"))
