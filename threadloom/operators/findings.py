"""The safety floor: findings by pattern and by signal, their levels, what they flag and block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import EVIDENCE_CHARS, PATTERNS, Pattern
from ..options import EPSILON, Options, finite
from ..schema import GATED, SIGNAL_KINDS


def scan_patterns(units: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """One row per unit and pattern that matches: conv_id, unit_pos, kind, source, probability, level, indices, evidence, ord.

    First every pattern is held against the unit's text once (and against its frames, where there are several:
    one may match alone), as literals of one projection. Frames are told apart for the hits only.
    """
    frames = F.when(F.size("frames") > 1, F.col("frames")["text"])
    hit = lambda p: F.col("text").rlike(p.regex) | F.coalesce(F.exists(frames, lambda t: t.rlike(p.regex)), F.lit(False))
    which = F.filter(F.array(*[F.when(hit(p), F.lit(k)) for k, p in enumerate(patterns)]), lambda k: k.isNotNull())
    df = units.select("conv_id", "unit_pos", "indices", "text", "frames", F.explode(which).alias("k"))

    def found(k: int, p: Pattern) -> Column:
        own = F.filter("frames", lambda f: f["text"].rlike(p.regex))
        text = F.when(F.size(own) > 0, F.get(own, F.lit(0))["text"]).otherwise(F.col("text"))
        match = F.substring(F.regexp_extract(text, p.regex, 0), 1, EVIDENCE_CHARS)
        where = F.when(F.size(own) > 0, own["idx"]).otherwise(F.col("indices"))
        return F.when(F.col("k") == k, F.struct(F.lit(k).alias("ord"), F.lit(p.kind).alias("kind"), where.alias("indices"), F.concat(F.lit(f"{p.name}: "), match).alias("evidence")))

    df = df.withColumn("h", F.coalesce(*[found(k, p) for k, p in enumerate(patterns)]))
    return df.select("conv_id", "unit_pos", "h.kind", F.lit("pattern").alias("source"), F.lit(1.0).alias("probability"), F.lit("action").alias("level"), "h.indices", "h.evidence", (F.col("unit_pos") * len(patterns) + F.col("h.ord")).alias("ord"))


def signal_findings(signals: DataFrame, pending: DataFrame, opts: Options) -> DataFrame:
    """Findings of the history-level signals (conv_id and a probability for each kind)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("probability"), F.lit(i).alias("o")) for i, k in enumerate(SIGNAL_KINDS)])
    df = signals.select("conv_id", F.explode(kinds).alias("s")).select("conv_id", "s.*")
    df = df.filter(finite(F.col("probability")) & (F.col("probability") >= opts.review_threshold - EPSILON))
    level = F.when(F.col("probability") >= opts.action_threshold - EPSILON, "action").otherwise("review")
    df = df.join(pending.select("conv_id", "pending_indices"), "conv_id", "left")
    none = F.array().cast("array<int>")
    where = F.when(F.col("kind").isin(*GATED), F.coalesce("pending_indices", none)).otherwise(none)
    return df.select("conv_id", F.lit(None).cast("int").alias("unit_pos"), "kind", F.lit("judge").alias("source"), "probability", level.alias("level"), where.alias("indices"), F.lit(None).cast("string").alias("evidence"), (F.lit(2**30) + F.col("o")).alias("ord"))


def leveled(patterns: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """All findings with ``rank`` in their history: action first, then by falling probability, patterns leading ties."""
    df = patterns if signals is None else patterns.unionByName(signals)
    order = W.partitionBy("conv_id").orderBy(F.when(F.col("level") == "action", 0).otherwise(1), F.desc("probability"), "ord")
    return df.withColumn("rank", F.row_number().over(order))


def implicated(findings: DataFrame) -> DataFrame:
    """conv_id, idx and the first action-level finding that names the message."""
    hit = findings.filter("level = 'action'").select("conv_id", F.explode("indices").alias("idx"), "rank", "kind", "evidence")
    return hit.groupBy("conv_id", "idx").agg(F.min_by(F.struct("kind", "evidence"), "rank").alias("finding"))


def blocking(findings: DataFrame, pending: DataFrame) -> DataFrame:
    """conv_id, kind, evidence and rank of the finding that blocks the pending action."""
    df = findings.filter((F.col("level") == "action") & F.col("kind").isin(*GATED)).join(pending.select("conv_id", "action_indices"), "conv_id")
    df = df.filter(F.arrays_overlap("indices", "action_indices"))
    return df.groupBy("conv_id").agg(F.min_by(F.struct("kind", "evidence", "rank"), "rank").alias("b")).select("conv_id", "b.*")


def blocked_by(findings: DataFrame, pending: DataFrame) -> DataFrame:
    """The blocking finding, else the first action-level one."""
    first = findings.filter("level = 'action'").groupBy("conv_id").agg(F.min_by(F.struct("kind", "evidence", "rank"), "rank").alias("a"))
    both = first.join(blocking(findings, pending).select("conv_id", F.struct("kind", "evidence", "rank").alias("b")), "conv_id", "left")
    return both.select("conv_id", F.coalesce("b", "a").alias("f")).select("conv_id", "f.*")


#: Texts of our own; {goal} stands for the goal.
CORRECTIVE = {
    "thrashing": "Notice: the last attempts repeat one failed step. Say what was tried and why it failed, then take another way.",
    "goal_drift": 'Notice: the last turns left the goal "{goal}". Come back to it, or say why the detour is needed.',
}


def per_history(findings: DataFrame) -> DataFrame:
    """conv_id and found, the findings of a history in order."""
    return findings.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "kind", "source", "level", "probability", "indices", "evidence"))).alias("found"))


def blocks(finding: Column, actions: Column) -> Column:
    """Whether a finding blocks an action that consists of these messages."""
    return (finding["level"] == "action") & finding["kind"].isin(*GATED) & F.coalesce(F.arrays_overlap(finding["indices"], actions), F.lit(False))


def corrective_text(found: Column, goal: Column, opts: Options) -> Column:
    """The corrective text for action-level signals of thrashing and drift among the findings, once each; null for none."""
    templates = CORRECTIVE | {k: v for k, v in (opts.corrective or {}).items() if isinstance(v, str)} if opts.corrective is not False else {}
    ask = F.filter(found, lambda f: (f["source"] == "judge") & (f["level"] == "action") & f["kind"].isin(*templates or ["-"]))

    def text(f: Column) -> Column:
        part = F.lit(None).cast("string")
        for k, t in templates.items():
            part = F.when(f["kind"] == k, F.replace(F.lit(t), F.lit("{goal}"), goal)).otherwise(part)
        return part

    return F.when(F.size(ask) > 0, F.array_join(F.transform(ask, text), "\n\n"))


def corrective_prompts(findings: DataFrame, goals: DataFrame, opts: Options) -> DataFrame:
    """conv_id and the corrective text of the histories that need one."""
    df = per_history(findings).join(goals, "conv_id")
    return df.select("conv_id", corrective_text(F.col("found"), F.col("goal"), opts).alias("addendum")).filter("addendum is not null")
