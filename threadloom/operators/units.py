"""Frames to units: a tool call with the results that answer it, or a single frame.

Which call a result belongs to is a window, not a join: the last frame before it
that isn't a result. It is absorbed if that is a tool call whose ids meet its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit_heads(frames: DataFrame) -> DataFrame:
    """Adds ``unit_head``, the index of the first frame of the frame's unit."""
    w = W.partitionBy("conv_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    head = F.last(F.when(F.col("kind") != "tool_result", F.struct("idx", "kind", "tool_call_ids")), ignorenulls=True).over(w)
    df = frames.withColumn("head", head)
    absorbed = (F.col("kind") == "tool_result") & (F.col("head.kind") == "tool_call") & F.arrays_overlap("tool_call_ids", "head.tool_call_ids")
    return df.withColumn("unit_head", F.when(F.coalesce(absorbed, F.lit(False)), F.col("head.idx")).otherwise(F.col("idx"))).drop("head")


def group_units(frames: DataFrame) -> DataFrame:
    """One row per unit, with its frames in order."""
    own = F.struct("idx", "role", "kind", "text", "tokens", "paths", "has_code", "tool_call_ids", "tool_names", "hash", "pinned")
    df = unit_heads(frames).groupBy("conv_id", "unit_head").agg(
        F.first("format").alias("format"), F.sort_array(F.collect_list(own)).alias("frames"), F.sum("tokens").cast("int").alias("tokens"),
        F.bool_or(F.col("kind").isin("tool_call", "tool_result")).alias("is_tool"),
    )
    f = F.col("frames")
    df = df.withColumn("unit_pos", F.row_number().over(W.partitionBy("conv_id").orderBy("unit_head")) - 1)
    return df.select(
        "conv_id", "unit_pos", F.concat(F.lit("u"), F.col("unit_pos").cast("string")).alias("unit_id"), "unit_head", "format", "frames", f["idx"].alias("indices"), "tokens", "is_tool",
        F.array_join(f["text"], "\n").alias("text"), f[0]["role"].alias("first_role"), f[0]["kind"].alias("first_kind"), F.array_join(f["hash"], ",").alias("unit_hash"),
    )


def pending_units(units: DataFrame) -> DataFrame:
    """conv_id, pending_unit, pending_indices and action_indices of histories whose newest unit, system ones aside, is the agent's."""
    newest = F.max_by(F.struct("unit_id", "first_role", "indices", "frames"), "unit_pos")
    df = units.filter(F.col("first_kind") != "system").groupBy("conv_id").agg(newest.alias("n")).filter("n.first_role = 'assistant'")
    actions = F.transform(F.filter("n.frames", lambda f: f["role"] == "assistant"), lambda f: f["idx"])
    return df.select("conv_id", F.col("n.unit_id").alias("pending_unit"), F.col("n.indices").alias("pending_indices"), actions.alias("action_indices"))


def kind_label(units_is_tool: Column | str = "is_tool") -> Column:
    """``tool:<names>`` for tool units, else the first frame's kind."""
    names = F.array_distinct(F.flatten(F.col("frames")["tool_names"]))
    is_tool = F.col(units_is_tool) if isinstance(units_is_tool, str) else units_is_tool
    return F.when(is_tool, F.when(F.size(names) > 0, F.concat(F.lit("tool:"), F.array_join(names, ","))).otherwise("tool")).otherwise(F.col("first_kind"))
