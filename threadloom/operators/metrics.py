"""Measures of a compaction: references kept or made up, evidence kept, tokens saved, spread between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def references(frames: DataFrame) -> DataFrame:
    """conv_id and the distinct references (URLs, paths, file names) of its frames."""
    tokens = frames.select("conv_id", F.explode("paths").alias("path")).select("conv_id", F.explode(T.split_joined("path")).alias("ref"))
    return tokens.filter(T.is_reference("ref")).distinct()


def path_fidelity(original: DataFrame, candidate: DataFrame) -> DataFrame:
    """Share of a candidate's references that its original has (1 without any), by conversation. Both sides go through one exchange and one aggregation."""
    side = lambda df, is_candidate: df.select("conv_id", F.lit(is_candidate).alias("asked"), F.explode_outer("paths").alias("path"))
    both = side(original, False).unionAll(side(candidate, True))
    both = both.select("conv_id", "asked", F.explode_outer(T.split_joined("path")).alias("ref")).withColumn("ref", F.when(T.is_reference("ref"), F.col("ref")))
    per = both.groupBy("conv_id", "ref").agg(F.bool_or("asked").alias("asked"), F.bool_or(~F.col("asked")).alias("known"))
    there = F.col("asked") & F.col("ref").isNotNull()
    df = per.groupBy("conv_id").agg(F.bool_or("asked").alias("asked"), F.count_if(there).alias("total"), F.count_if(there & F.col("known")).alias("present")).filter("asked")
    return df.select("conv_id", "total", "present", F.when(F.col("total") == 0, 1.0).otherwise(F.col("present") / F.col("total")).alias("ratio"))


def hallucinated(original: DataFrame, candidate: DataFrame) -> DataFrame:
    return references(candidate).join(references(original), ["conv_id", "ref"], "left_anti")


def retention(texts: DataFrame, snippets: DataFrame) -> DataFrame:
    """Share of a conversation's snippets (conv_id, snippet) that its text holds; 1 without snippets."""
    hit = texts.join(snippets, "conv_id", "left").groupBy("conv_id").agg(F.count("snippet").alias("n"), F.count_if(F.col("text").contains(F.col("snippet"))).alias("found"))
    return hit.select("conv_id", "n", "found", F.when(F.col("n") == 0, 1.0).otherwise(F.col("found") / F.col("n")).alias("retention"))


def saved(df: DataFrame, before: str = "tokens_before", after: str = "tokens_after") -> DataFrame:
    return df.withColumn("saved", F.when(F.col(before) == 0, 0.0).otherwise(1 - F.col(after) / F.col(before)))


def compare_arms(rows: DataFrame) -> DataFrame:
    """Means by arm over rows (arm, tokens_before, tokens_after, stray)."""
    return saved(rows).groupBy("arm").agg(F.count(F.lit(1)).alias("histories"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.round(F.avg("saved"), 6).alias("mean_saved"), F.sum("stray").alias("stray"))


def stability(runs: DataFrame) -> DataFrame:
    """Units whose decision differs between runs (conv_id, unit_id, run, decision, p_keep), and the spread of p_keep."""
    return runs.groupBy("conv_id", "unit_id").agg(F.count_distinct("decision").alias("decisions"), (F.max("p_keep") - F.min("p_keep")).alias("spread"), F.count(F.lit(1)).alias("runs"))


def same_selection(a: DataFrame, b: DataFrame) -> DataFrame:
    """conv_id and whether two runs kept the same messages (conv_id, idx)."""
    both = a.select("conv_id", "idx", F.lit(1).alias("x")).unionAll(b.select("conv_id", "idx", F.lit(-1).alias("x")))
    per = both.groupBy("conv_id", "idx").agg(F.sum("x").alias("x"))
    return per.groupBy("conv_id").agg(F.bool_and(F.col("x") == 0).alias("same"))


def wrapper_status(calls: DataFrame) -> DataFrame:
    """Counters of calls (key, call_no, skipped, blocked)."""
    skips = [F.count_if(F.col("skipped") == k).alias(f"skipped_{k}") for k in ("below_threshold", "cooldown", "nothing_to_judge", "judge_unavailable")]
    return calls.groupBy("key").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("skipped").isNull()).alias("compactions"), *skips, F.count_if("blocked").alias("blocked"))
