"""Pins, exact duplicates and candidates, as columns of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options
from .normalize import GOAL_CHARS


def with_goals(units: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Adds goal: the one given, else the last user message's text. User frames are units of their own, so it is a window over units."""
    user = F.col("first_kind") == "user"
    own = F.max_by(F.when(user, F.substring("text", 1, GOAL_CHARS)), F.when(user, F.col("unit_pos"))).over(W.partitionBy("conv_id"))
    df = units.withColumn("goal", F.coalesce(own, F.lit("")))
    if goals is None:
        return df
    given = goals.select("conv_id", F.col("goal").alias("_given"))
    return df.join(given, "conv_id", "left").withColumn("goal", F.coalesce("_given", "goal")).drop("_given")


def pins(units: DataFrame, goals: DataFrame | None, opts: Options) -> DataFrame:
    """Adds goal and pin_reason (null: not pinned): system, caller, recent, goal path, code, in this order."""
    df = with_goals(units, goals)
    df = df.withColumn("n_units", F.count(F.lit(1)).over(W.partitionBy("conv_id")))
    goal = F.lower(F.coalesce("goal", F.lit("")))
    unit_paths = F.array_distinct(F.flatten(F.col("frames")["paths"]))
    own = F.get(F.filter(unit_paths, lambda p: F.contains(goal, F.lower(p))), F.lit(0))
    text = F.lower("text")
    of_goal = F.get(F.filter(T.paths(F.coalesce("goal", F.lit(""))), lambda p: F.contains(text, F.lower(p))), F.lit(0))
    path = F.when(goal != "", F.coalesce(own, of_goal))
    reason = F.coalesce(
        F.when(F.exists("frames", lambda f: f["kind"] == "system"), F.lit("pinned:system")),
        F.when(F.exists("frames", lambda f: f["pinned"]), F.lit("pinned:caller")),
        F.when(F.col("unit_pos") >= F.col("n_units") - opts.keep_recent, F.lit("pinned:recent")),
        F.concat(F.lit("pinned:goal-path "), path),
        F.when(F.exists("frames", lambda f: f["has_code"]) & (F.col("unit_pos") >= F.col("n_units") - opts.pin_code_within), F.lit("pinned:code")),
    )
    return df.withColumn("pin_reason", reason)


def duplicates(units: DataFrame) -> DataFrame:
    """Adds dup_reason: of unpinned units with the same frames, all but the last."""
    free = F.col("pin_reason").isNull()
    last = F.max(F.when(free, F.col("unit_pos"))).over(W.partitionBy("conv_id", "unit_hash"))
    return units.withColumn("dup_reason", F.when(free & (last != F.col("unit_pos")), F.concat(F.lit("duplicate of u"), last.cast("string"))))


def prepass(units: DataFrame, goals: DataFrame | None, opts: Options) -> DataFrame:
    """Adds pin_reason, dup_reason and is_candidate."""
    df = duplicates(pins(units, goals, opts))
    return df.withColumn("is_candidate", F.col("pin_reason").isNull() & F.col("dup_reason").isNull())
