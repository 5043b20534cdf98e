"""Strategies over frames, and their helpers: turns, pairs of calls and results, merged turns, places and costs of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

_BY = lambda: W.partitionBy("conv_id")
_NEWER = lambda: W.partitionBy("conv_id").orderBy(F.desc("idx"))
_OLDER = lambda: W.partitionBy("conv_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)


def truncate_oldest(frames: DataFrame, max_tokens: int = 15000) -> DataFrame:
    """The first message, and the newest of the rest that fit with it."""
    rest = F.col("idx") > F.min("idx").over(_BY())
    head = F.first("tokens").over(_BY().orderBy("idx"))
    after = F.sum(F.when(rest, F.col("tokens")).otherwise(0)).over(_NEWER().rowsBetween(W.unboundedPreceding, 0))
    return frames.withColumn("_k", ~rest | (head + after <= max_tokens)).filter("_k").drop("_k")


def turns(frames: DataFrame) -> DataFrame:
    """Adds turn: how many user messages there are up to the frame."""
    return frames.withColumn("turn", F.count_if(F.col("kind") == "user").over(_BY().orderBy("idx").rowsBetween(W.unboundedPreceding, 0)))


def turn_tail(frames: DataFrame, least: int = 2000, most: int = 15000, share: float = 0.25, usable: int = 60000) -> DataFrame:
    """The newest whole user turns within a budget between ``least`` and ``most``, and of the turn that crosses it the newest messages that still fit; no system messages, and no rows where all would be kept."""
    budget = max(least, min(most, int(usable * share)))
    turn = W.partitionBy("conv_id", "turn")
    df = turns(frames.filter("kind <> 'system'")).withColumn("_first", F.min("idx").over(_BY()))
    df = df.withColumn("_t", T.tokens_by_chars("text")).withColumn("_after", F.sum("_t").over(_NEWER().rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("_sum", F.max("_after").over(turn)).withColumn("_newer", F.col("_sum") - F.sum("_t").over(turn))
    part = (F.col("_after") <= budget) & (F.col("_newer") < budget)
    df = df.filter((F.col("turn") > 0) & ((F.col("_sum") <= budget) | part))
    df = df.withColumn("_kept", F.min("idx").over(_BY())).filter("_kept > _first")
    return df.select("conv_id", "turn", *[c for c in frames.columns if c not in ("conv_id", "turn")])


def old_tool_outputs(frames: DataFrame, protect: int = 40000, least: int = 20000, turns_kept: int = 2) -> DataFrame:
    """conv_id, idx and tokens of tool results to blank: past the newest ``protect`` tokens of results, outside the newest turns, if that frees more than ``least``."""
    df = turns(frames).withColumn("_last", F.max("turn").over(_BY()))
    df = df.filter((F.col("kind") == "tool_result") & (F.col("turn") <= F.col("_last") - turns_kept)).withColumn("t", T.tokens_by_chars("text"))
    df = df.withColumn("_sum", F.sum("t").over(_NEWER().rowsBetween(W.unboundedPreceding, 0))).filter(F.col("_sum") > protect)
    return df.withColumn("_freed", F.sum("t").over(_BY())).filter(F.col("_freed") > least).select("conv_id", "idx", "t")


def sanitize_pairs(frames: DataFrame) -> DataFrame:
    """conv_id, idx, action: results without a call are dropped, calls without a result get a stub."""
    calls = frames.filter("kind = 'tool_call'").select("conv_id", "idx", F.explode("tool_call_ids").alias("id"))
    results = frames.filter("kind = 'tool_result'").select("conv_id", "idx", F.explode("tool_call_ids").alias("id"))
    orphan = results.join(calls.select("conv_id", "id"), ["conv_id", "id"], "left_anti").select("conv_id", "idx", F.lit("drop_result").alias("action"), "id")
    open_ = calls.join(results.select("conv_id", "id"), ["conv_id", "id"], "left_anti").select("conv_id", "idx", F.lit("stub_result").alias("action"), "id")
    return orphan.unionByName(open_)


def result_lookup(frames: DataFrame) -> DataFrame:
    """Calls with the text of the first result of each id (null: none yet)."""
    calls = frames.filter("kind = 'tool_call'").select("conv_id", "idx", F.explode("tool_call_ids").alias("id"))
    results = frames.filter("kind = 'tool_result'").select("conv_id", F.col("idx").alias("r"), "text", F.explode("tool_call_ids").alias("id"))
    results = results.groupBy("conv_id", "id").agg(F.min_by("text", "r").alias("result"))
    return calls.join(results, ["conv_id", "id"], "left")


def merge_same_role(frames: DataFrame) -> DataFrame:
    """conv_id, turn_no, role and text of turns: systems aside, neighbours of one role are one, their texts a blank line apart."""
    role = F.when(F.col("role").isin("user", "tool"), "user").otherwise("assistant")
    df = frames.filter("role <> 'system'").withColumn("_role", role)
    new = F.coalesce(F.lag("_role").over(_BY().orderBy("idx")) != F.col("_role"), F.lit(True))
    df = df.withColumn("_new", new.cast("int")).withColumn("turn_no", F.sum("_new").over(_BY().orderBy("idx")))
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return df.groupBy("conv_id", "turn_no").agg(F.first("_role").alias("role"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("messages"))


def system_text(frames: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return frames.filter("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n\n").alias("system"))


def tool_stubs(frames: DataFrame) -> DataFrame:
    """conv_id and the distinct names of the tools used."""
    return frames.select("conv_id", F.explode("tool_names").alias("tool")).distinct()


def last_user_query(frames: DataFrame) -> DataFrame:
    return frames.filter("kind = 'user'").groupBy("conv_id").agg(F.max_by("text", "idx").alias("query"))


def structured_summary(text):
    """The last fenced JSON after an analysis, as text; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), 1)
    return F.get(found, F.size(found) - 1)


def drop_reasoning(messages: DataFrame, before_last: bool = True) -> DataFrame:
    """Messages (conv_id, idx, message_json) without their reasoning blocks, all or all but the last message's; a message of nothing else goes."""
    blocks = F.from_json(F.get_json_object("message_json", "$.content"), "array<string>")
    keep = F.filter(blocks, lambda b: ~F.coalesce(F.get_json_object(b, "$.type"), F.lit("")).isin("reasoning", "thinking", "redacted_thinking"))
    last = F.col("idx") == F.max("idx").over(_BY())
    touched = F.coalesce(F.size(keep) < F.size(blocks), F.lit(False)) & (~last if before_last else F.lit(True))
    role = F.to_json(F.struct(F.get_json_object("message_json", "$.role").alias("role")))
    made = F.concat(F.regexp_replace(role, r"\}\z", ""), F.lit(',"content":['), F.array_join(keep, ","), F.lit("]}"))
    return messages.withColumn("_t", touched).filter(~F.col("_t") | (F.size(keep) > 0)).withColumn("message_json", F.when(F.col("_t"), made).otherwise(F.col("message_json"))).drop("_t")


def summary_place(head: DataFrame, tail: DataFrame) -> DataFrame:
    """conv_id, role of a summary between head and tail, and whether it must go into the tail's first message (both neighbours would clash)."""
    h = head.groupBy("conv_id").agg(F.max_by("role", "idx").alias("before"))
    t = tail.groupBy("conv_id").agg(F.min_by("role", "idx").alias("after"))
    df = h.join(t, "conv_id", "full")
    role = F.when(F.coalesce("before", F.lit("system")).isin("assistant", "tool"), "user").otherwise("assistant")
    flip = F.when(role == "user", "assistant").otherwise("user")
    clash = F.coalesce(role == F.col("after"), F.lit(False))
    return df.select("conv_id", F.when(clash & (flip != F.col("before")), flip).otherwise(role).alias("role"), (clash & F.coalesce(flip == F.col("before"), F.lit(False))).alias("merge_into_tail"))


def cost(usage: DataFrame, per_input: float, per_output: float) -> DataFrame:
    """conv_id and dollars, summed over the iterations of usage(conv_id, input_tokens, output_tokens)."""
    return usage.groupBy("conv_id").agg((F.sum("input_tokens") * per_input + F.sum("output_tokens") * per_output).alias("usd"))
