"""Decisions for units: thresholds, least number kept, token budget, flags.

Both corrections are prefix conditions over an ordering, so they are windows:
nothing is decided row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..options import EPSILON, Options, finite

SURVIVES = ("kept", "pinned", "flagged")


def drop_at(p_keep: Column, threshold: float) -> Column:
    return (1 - p_keep) >= threshold - EPSILON


def _p(p: Column) -> Column:
    return F.format_string("%.2f", p)


def initial(units: DataFrame, judgements: DataFrame | None, answered: DataFrame | bool | None = None) -> DataFrame:
    """Adds p_keep, confidence and ``answered`` (whether the history has any answer). judgements: one row per unit.

    Answers count for candidates only, and for units that were asked about where there is a column ``asked``; one that isn't finite is none.
    answered: conv_id of the histories that were answered, if not those with any row of judgements; True: all were.
    """
    if judgements is None:
        return units.withColumns({"p_keep": F.lit(None).cast("double"), "confidence": F.lit(None).cast("double"), "answered": F.lit(False)})
    j = judgements.select("conv_id", "unit_id", "p_keep", "confidence")
    df = units.join(j, ["conv_id", "unit_id"], "left")
    if answered is True:
        df = df.withColumn("answered", F.lit(True))
    else:
        any_ = (j if answered is None else answered).select("conv_id").distinct().withColumn("answered", F.lit(True))
        df = df.join(any_, "conv_id", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    fine = F.col("is_candidate") & finite(F.col("p_keep"))
    if "asked" in units.columns:
        fine = fine & F.col("asked")
    return df.withColumns({"confidence": F.when(fine, F.col("confidence")), "p_keep": F.when(fine, F.col("p_keep"))})


def by_threshold(df: DataFrame, opts: Options) -> DataFrame:
    """Adds decision and reason."""
    judged, drop = F.col("p_keep").isNotNull(), drop_at(F.col("p_keep"), opts.drop_threshold)
    decision = F.when(F.col("pin_reason").isNotNull(), "pinned").when(F.col("dup_reason").isNotNull(), "duplicate").when(judged & drop, "dropped").otherwise("kept")
    reason = F.coalesce(
        "pin_reason", "dup_reason", F.when(~F.col("answered"), F.lit("judge:unavailable")), F.when(~judged, F.lit("unjudged")),
        F.when(drop, F.concat(F.lit("judge:drop p="), _p(1 - F.col("p_keep")))), F.concat(F.lit("judge:keep p="), _p(F.col("p_keep"))),
    )
    return df.withColumn("decision", decision).withColumn("reason", reason)


def keep_least(df: DataFrame, opts: Options) -> DataFrame:
    """Keeps the newest dropped candidates of histories that would keep fewer than min_keep."""
    w = W.partitionBy("conv_id")
    kept = F.count_if(F.col("is_candidate") & (F.col("decision") == "kept")).over(w)
    rank = F.row_number().over(W.partitionBy("conv_id", "decision").orderBy(F.desc("unit_pos")))
    df = df.withColumn("_back", (F.col("decision") == "dropped") & F.col("answered") & (rank <= F.lit(opts.min_keep) - kept))
    return df.withColumn("reason", F.when(F.col("_back"), F.concat(F.lit("minKeep (was "), "reason", F.lit(")"))).otherwise(F.col("reason"))).withColumn("decision", F.when(F.col("_back"), "kept").otherwise(F.col("decision"))).drop("_back")


def within_budget(df: DataFrame, opts: Options) -> DataFrame:
    """Drops judged units, least p_keep and then oldest first, while the history is over max_tokens and keeps more than min_keep candidates."""
    w = W.partitionBy("conv_id")
    df = df.withColumn("_total", F.sum(F.when(F.col("decision").isin(*SURVIVES), F.col("tokens")).otherwise(0)).over(w))
    df = df.withColumn("_kept", F.count_if(F.col("is_candidate") & (F.col("decision") == "kept")).over(w))
    df = df.withColumn("_free", (F.col("decision") == "kept") & F.col("p_keep").isNotNull() & F.col("answered"))
    order = W.partitionBy("conv_id", "_free").orderBy("p_keep", "unit_pos")
    freed = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = F.col("_free") & (F.col("_total") - freed > opts.max_tokens) & (F.col("_kept") - (F.row_number().over(order) - 1) > opts.min_keep)
    df = df.withColumn("_out", out)
    second = drop_at(F.col("p_keep"), opts.drop_threshold_second_pass)
    df = df.withColumn("decision", F.when(F.col("_out"), F.when(second, "dropped").otherwise("budget")).otherwise(F.col("decision")))
    return df.withColumn("reason", F.when(F.col("_out"), F.when(second, "judge:drop-2nd-pass").otherwise("budget")).otherwise(F.col("reason"))).drop("_total", "_kept", "_free", "_out")


def flag(df: DataFrame, implicated: DataFrame) -> DataFrame:
    """Flags surviving units that an action-level finding names, by the first of their messages that it names."""
    hit = df.select("conv_id", "unit_id", F.explode("indices").alias("idx")).join(implicated, ["conv_id", "idx"])
    hit = hit.groupBy("conv_id", "unit_id").agg(F.min_by("finding", "idx").alias("finding"))
    df = df.join(hit, ["conv_id", "unit_id"], "left")
    on = F.col("finding").isNotNull() & F.col("decision").isin(*SURVIVES)
    why = F.concat(F.lit("flagged:"), F.col("finding.kind"), F.coalesce(F.concat(F.lit(" "), F.col("finding.evidence")), F.lit("")), F.lit(" (was "), "reason", F.lit(")"))
    return df.withColumn("reason", F.when(on, why).otherwise(F.col("reason"))).withColumn("decision", F.when(on, "flagged").otherwise(F.col("decision"))).drop("finding")


def keep_everything(df: DataFrame, where: Column) -> DataFrame:
    """Fail-open: the duplicates of these histories are kept, with the reason they had; flags come after."""
    back = where & (F.col("decision") == "duplicate")
    return df.withColumn("reason", F.when(back, F.concat(F.lit("judge:unavailable (was "), "reason", F.lit(")"))).otherwise(F.col("reason"))).withColumn("decision", F.when(back, "kept").otherwise(F.col("decision")))


def decide(units: DataFrame, judgements: DataFrame | None, implicated: DataFrame | None, opts: Options, unavailable: Column | None = None, answered: DataFrame | bool | None = None) -> DataFrame:
    """unavailable: the histories that were asked about in vain (a predicate that may use ``answered``)."""
    df = within_budget(keep_least(by_threshold(initial(units, judgements, answered), opts), opts), opts)
    if unavailable is not None:
        df = keep_everything(df, unavailable)
    return flag(df, implicated) if implicated is not None else df
