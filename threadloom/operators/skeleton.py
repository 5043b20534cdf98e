"""The abridged view of a history, in six stages, the lowest that fits a token limit.

All stages are columns of the same row, so choosing one is six sums and a CASE;
the last stage's omissions are a running sum over the old candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options

# Limits of the stages.
STAGE1_INPUT, STAGE2, ONE_LINE, ONE_LINE_INPUT, RECENT_EXTRA, LAST = 1000, 400, 120, 60, 4, 5
CALL_PREFIX, RESULT_PREFIX = r"(?m)^\[(?:tool_call|tool_use) [^\]\n]*\] ?", r"(?m)^\[tool_result [^\]\n]*\] ?"
NOTE = "Older entries may be shortened."


def views(units: DataFrame, opts: Options) -> DataFrame:
    """Adds old, tool, input and result (null: none) of units with is_candidate."""
    f = F.col("frames")
    calls, results = F.filter(f, lambda x: x["kind"] == "tool_call"), F.filter(f, lambda x: x["kind"] == "tool_result")
    strip = lambda a, p: F.when(F.size(a) > 0, F.array_join(F.transform(a, lambda x: F.regexp_replace(x["text"], p, "")), "\n"))
    n = F.count(F.lit(1)).over(W.partitionBy("conv_id"))
    named = F.when(F.size(calls) > 0, F.flatten(calls["tool_names"])).otherwise(F.flatten(results["tool_names"]))
    df = units.withColumn("old", F.col("unit_pos") < n - (opts.keep_recent + RECENT_EXTRA))
    return df.withColumns({"tool": F.when(F.col("is_tool"), F.array_join(named, ",")), "input": F.when(F.col("is_tool"), strip(calls, CALL_PREFIX)), "result": F.when(F.col("is_tool"), strip(results, RESULT_PREFIX))})


def entry(stage: int, opts: Options) -> Column:
    """JSON of a unit's entry at a stage."""
    collapsed = F.col("old") & F.when(F.col("is_candidate"), F.lit(stage >= 3)).otherwise(F.lit(stage >= 4))
    content_n = min(opts.excerpt_chars, STAGE2) if stage >= 2 else opts.excerpt_chars
    input_n = min(opts.excerpt_chars, STAGE2) if stage >= 2 else min(opts.excerpt_chars, STAGE1_INPUT) if stage >= 1 else opts.excerpt_chars
    content = F.when(collapsed, T.one_line("text", ONE_LINE)).otherwise(T.excerpt("text", content_n))
    inputs = F.when(collapsed, T.one_line("input", ONE_LINE_INPUT)).otherwise(T.excerpt("input", input_n))
    result = T.result_omitted("result") if stage >= 1 else T.result_head("result", opts.truncate_head_chars)
    plain = F.to_json(F.struct(F.col("unit_id").alias("u"), F.col("first_role").alias("role"), content.alias("content")))
    tool = F.to_json(F.struct(F.col("unit_id").alias("u"), F.lit("assistant").alias("role"), "tool", inputs.alias("input"), F.when(F.col("result").isNotNull(), result).alias("result")))
    return F.when(F.col("is_tool"), tool).otherwise(plain)


def most_size(goal_chars: Column, over: WindowSpec | None = None) -> Column:
    """Characters of a history's view at most, as an aggregate over its units: six of JSON for each of text, and some for each entry."""
    names = F.length(F.array_join(F.flatten(F.col("frames")["tool_names"]), ","))
    one = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return one(F.sum(6 * (F.length("text") + names) + 200)) + 6 * (one(goal_chars) if over is not None else F.first(goal_chars)) + 200


def skeleton(units: DataFrame, opts: Options, min_stage: int | Column = 0, limit: Column | None = None, where: Column | None = None) -> DataFrame:
    """Units with fit_stage, state_tokens, omitted, entry (its JSON at the chosen stage) and position (null: omitted). Needs goal.

    limit: tokens of a history's view, where these differ. where: histories to abridge; of the others nothing is omitted, and entry is null.
    """
    most = F.lit(opts.state_tokens) if limit is None else limit
    start = F.least(F.lit(LAST), F.greatest(F.lit(0), min_stage if isinstance(min_stage, Column) else F.lit(int(min_stage))))
    df = views(units, opts)
    entries = F.array(*[entry(s, opts) for s in range(LAST + 1)])
    df = df.withColumn("entries", entries if where is None else F.when(where, entries))
    w = W.partitionBy("conv_id")
    sizes = F.transform("entries", lambda e: T.u16len(e))
    df = df.withColumn("sizes", sizes).withColumn("frame_size", T.u16len(F.to_json(F.struct("goal", F.lit(NOTE).alias("note"), F.array().cast("array<string>").alias("messages")))))
    df = df.withColumn("n", F.count(F.lit(1)).over(w))
    for s in range(LAST + 1):
        df = df.withColumn(f"total_{s}", F.col("frame_size") + F.sum(F.col("sizes")[s]).over(w) + F.col("n") - 1)
    fits = lambda size: F.ceil(size / T.CHARS_PER_TOKEN) <= most
    stage = F.lit(LAST)
    for s in range(LAST, -1, -1):
        stage = F.when((F.lit(s) >= start) & fits(F.col(f"total_{s}")), s).otherwise(stage)
    df = df.withColumn("fit_stage", stage.cast("int"))
    gone = F.when(F.col("old") & F.col("is_candidate"), F.col("sizes")[LAST] + 1)
    before = F.coalesce(F.sum(gone).over(w.orderBy("unit_pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("omitted", F.coalesce((F.col("fit_stage") == LAST) & gone.isNotNull() & ~fits(F.col(f"total_{LAST}") - before), F.lit(False)))
    size = F.element_at(F.array(*[F.col(f"total_{s}") for s in range(LAST + 1)]), F.col("fit_stage") + 1) - F.sum(F.when(F.col("omitted"), F.col("sizes")[LAST] + 1).otherwise(0)).over(w)
    df = df.withColumn("state_tokens", F.ceil(size / T.CHARS_PER_TOKEN).cast("int"))
    kept_before = F.sum(F.when(F.col("omitted"), 0).otherwise(1)).over(w.orderBy("unit_pos").rowsBetween(W.unboundedPreceding, 0)) - 1
    df = df.withColumn("position", F.when(~F.col("omitted"), kept_before.cast("int"))).withColumn("entry", F.element_at("entries", F.col("fit_stage") + 1))
    return df.drop("entries", "sizes", "n", "frame_size", *[f"total_{s}" for s in range(LAST + 1)])
