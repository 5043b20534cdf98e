"""A whole run: messages in, kept messages, reports, findings and results out.

One lazy plan per conversation key. A judge that sends requests is the only barrier:
the abridged views that it is asked about, and what it said, are written out, so
that nothing is asked twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import BlockedError, UnavailableError
from ..functions import text as T
from ..functions.patterns import PATTERNS
from ..operators import decide as D
from ..operators import findings as X
from ..operators.judge import Asked, LexicalJudge, average_signals, average_votes, batches, collected
from ..operators.normalize import GOAL_CHARS, normalize
from ..operators.prepass import prepass
from ..operators.skeleton import LAST, most_size, skeleton
from ..operators.units import group_units, pending_units
from ..options import Options
from ..streaming.gate import cooldown
from .store import stored


@dataclass(frozen=True)
class Result:
    """messages: what is kept, in order, an addendum at the end. reports: one row per unit (none of histories that were passed over). findings. results: one row per history."""

    messages: DataFrame
    reports: DataFrame
    findings: DataFrame
    results: DataFrame
    units: DataFrame


#: Requests for one history at most while its state is too large, and the next limit as a share of the state that was too large.
ATTEMPTS, SHRINK = 8, 0.6


def ladder(units: DataFrame, pending: DataFrame, judge, opts: Options, attempts: int = ATTEMPTS) -> tuple[Asked, DataFrame]:
    """Ask about histories, and abridge again those whose state is rejected for its size: a stage further and with a smaller limit each time.

    A history stops when it is answered, fails otherwise, no longer shrinks, or has used its attempts. Returns what the
    requests come to and the last views (skeleton rows).
    """
    made, views = None, None
    left = units.withColumns({"_limit": F.lit(opts.state_tokens), "_stage": F.lit(0), "_last": F.lit(None).cast("int")})
    for attempt in range(attempts):
        view = skeleton(left, opts, F.col("_stage"), F.col("_limit"))
        view = stored(view.filter(F.col("_last").isNull() | (F.col("state_tokens") < F.col("_last"))), "view")
        requests = stored(judge.requests(batches(view, pending, opts), opts.votes).withColumn("attempt", F.lit(attempt)), "requests")
        made = requests if made is None else made.unionByName(requests)
        plain = view.drop("_limit", "_stage", "_last")
        asked = requests.select("conv_id").distinct()
        views = plain if views is None else views.join(asked, "conv_id", "left_anti").unionByName(plain)
        again = requests.filter("error_type = 'too_large'").select("conv_id").distinct()
        if attempt == attempts - 1 or not again.limit(1).count():
            break
        state = view.join(again, "conv_id", "left_semi").groupBy("conv_id").agg(
            F.greatest(F.lit(1), F.floor(F.least(F.first("_limit"), F.first("state_tokens")) * SHRINK)).cast("int").alias("_limit"),
            F.least(F.lit(LAST), F.greatest(F.first("_stage"), F.first("fit_stage")) + 1).cast("int").alias("_stage"), F.first("state_tokens").alias("_last"),
        )
        left = units.join(state, "conv_id")
    return collected(made), views


def _abridged(pre: DataFrame, units: DataFrame, goals: DataFrame | None, opts: Options, store: bool) -> DataFrame:
    """Adds ``omitted``: whether the abridged view of its history has no room for the unit. Where units are stored and no history is large enough, nothing is abridged."""
    if store and goals is None and not units.groupBy("conv_id").agg(most_size(F.lit(GOAL_CHARS)).alias("n")).filter(F.col("n") > opts.state_tokens * T.CHARS_PER_TOKEN).limit(1).count():
        return pre.withColumn("omitted", F.lit(False))
    large = most_size(F.first(F.length("goal")), W.partitionBy("conv_id")) > opts.state_tokens * T.CHARS_PER_TOKEN
    return skeleton(pre.withColumn("_large", large), opts, where=F.col("_large")).drop("_large", "entry", "old", "tool", "input", "result", "position", "fit_stage", "state_tokens")


def compact(messages: DataFrame, opts: Options = Options(), judge=None, goals: DataFrame | None = None, pin: Column | None = None, cooling: DataFrame | None = None, escrow: DataFrame | None = None, store: bool = True) -> Result:
    """Compact the histories of messages(conv_id, idx, message_json).

    goals: conv_id, goal. cooling: conv_id of histories whose judge is skipped. escrow: conv_id, approved, a verdict on blocked ones.
    store: write units, and decisions, to the shared folder once, where the plan forks.
    """
    judge = judge or LexicalJudge()
    units = group_units(normalize(messages, opts.format, pin, opts.count_tokens or T.est_tokens))
    if store:
        units = stored(units, "units")
    pre = prepass(units, goals, opts)
    w = W.partitionBy("conv_id")
    pre = pre.withColumns({"tokens_before": F.sum("tokens").over(w), "any_candidate": F.max(F.col("is_candidate").cast("int")).over(w) == 1})
    skipped = F.when((F.lit(opts.trigger) == "auto") & (F.col("tokens_before") <= opts.max_tokens), "below_threshold")
    if cooling is not None:
        pre = pre.join(cooling.select("conv_id").distinct().withColumn("_cool", F.lit(True)), "conv_id", "left")
        skipped = F.when(F.col("_cool"), "cooldown").otherwise(skipped)
    skipped = F.coalesce(skipped, F.when(~F.col("any_candidate"), F.lit("nothing_to_judge"))) if not opts.safety_gating else skipped
    pre = pre.withColumn("skipped", skipped)
    pending = pending_units(units)
    telemetry = answered = None
    if hasattr(judge, "requests"):
        (judgements, signals, answered, telemetry), views = ladder(pre.filter("skipped is null"), pending, judge, opts)
        telemetry = telemetry.join(views.groupBy("conv_id").agg(F.first("fit_stage").alias("fit_stage"), F.first("state_tokens").alias("state_tokens")), "conv_id", "left")
        pre = pre.withColumn("asked", F.col("skipped").isNull())
        unavailable = F.col("skipped").isNull() & ~F.col("answered")
    else:
        pre = _abridged(pre, units, goals, opts, store).withColumn("asked", F.col("skipped").isNull() & F.col("is_candidate") & ~F.col("omitted"))
        asked = pre.filter("asked")
        answered = True if getattr(judge, "always_answers", False) else None
        judgements = average_votes(judge.ask(asked).filter(F.col("vote") < opts.votes))
        signals = judge.signals(asked)
        if signals is not None:
            signals = average_signals(signals.filter(F.col("vote") < opts.votes)).join(pre.filter("skipped is null").select("conv_id").distinct(), "conv_id", "left_semi")
        unavailable = F.col("skipped").isNull() & F.col("any_candidate") & ~F.col("answered")
    patterns = X.scan_patterns(units, tuple(opts.patterns) if opts.patterns is not None else PATTERNS)
    findings = X.leveled(patterns, X.signal_findings(signals, pending, opts) if signals is not None else None)
    decided = D.decide(pre, judgements, X.implicated(findings), opts, unavailable, answered)
    decided = decided.withColumn("skipped", F.when(unavailable, "judge_unavailable").otherwise(F.col("skipped")))
    if opts.fail_closed:
        decided = decided.withColumn("decision", F.when(F.col("skipped") == "judge_unavailable", F.raise_error(F.lit("judge unavailable")).cast("string")).otherwise(F.col("decision")))
    # histories that are passed over keep every message, and no unit of theirs is reported
    passed = F.col("skipped").isin("below_threshold", "cooldown")
    decided = decided.withColumn("reason", F.when(~F.coalesce(passed, F.lit(False)), F.col("reason"))).withColumn("decision", F.when(passed, "kept").otherwise(F.col("decision")))
    if store:
        decided = stored(decided, "decided")
    results = summarize(decided, findings, opts, escrow, signals, telemetry)
    kept = decided.filter(F.col("decision").isin(*D.SURVIVES)).select("conv_id", F.explode("indices").alias("idx"))
    out = messages.join(kept, ["conv_id", "idx"], "left_semi").select("conv_id", "idx", "message_json")
    if signals is not None:  # nothing else asks for an addendum
        tail = results.filter("addendum is not null and format <> 'anthropic'")
        out = out.unionByName(tail.select("conv_id", F.col("addendum_idx").alias("idx"), F.col("addendum_json").alias("message_json")))
    reports = decided.filter(~F.coalesce(passed, F.lit(False))).select("conv_id", "unit_pos", "unit_id", "indices", "decision", "p_keep", "confidence", "reason", "tokens", "skipped")
    return Result(out, reports, findings, results.drop("addendum_idx", "addendum_json"), decided)


def summarize(decided: DataFrame, findings: DataFrame, opts: Options, escrow: DataFrame | None = None, signals: DataFrame | None = None, telemetry: DataFrame | None = None) -> DataFrame:
    """One row per history: sizes before and after, skip reason, block, addendum. All that units know is one aggregation, all that findings know another."""
    ok = F.col("decision").isin(*D.SURVIVES)
    spoken = F.col("first_kind") != "system"
    df = decided.groupBy("conv_id").agg(
        F.first("format").alias("format"), F.first("goal").alias("goal"), F.sum("tokens").alias("tokens_before"), F.sum(F.when(ok, F.col("tokens")).otherwise(0)).alias("own_after"),
        F.sum(F.size("indices")).alias("messages_before"), F.sum(F.when(ok, F.size("indices")).otherwise(0)).alias("own_messages"), F.max("skipped").alias("skipped"),
        F.count_if(F.col("is_candidate") & F.col("p_keep").isNull() & F.col("reason").isNotNull()).alias("unjudged"), F.max(F.array_max("indices")).alias("last"),
        F.max_by(F.when(spoken, F.struct("first_role", "frames")), F.when(spoken, F.col("unit_pos"))).alias("newest"),
    )
    df = df.join(X.per_history(findings), "conv_id", "left")
    actions = F.when(F.col("newest.first_role") == "assistant", F.transform(F.filter("newest.frames", lambda f: f["role"] == "assistant"), lambda f: f["idx"]))
    block = F.get(F.filter("found", lambda f: X.blocks(f, actions)), F.lit(0))
    df = df.withColumns({"block": block, "addendum": X.corrective_text(F.col("found"), F.col("goal"), opts)})
    blocked = F.col("block").isNotNull() & F.lit(opts.safety_gating)
    if escrow is not None:
        df = df.join(escrow.select("conv_id", "approved"), "conv_id", "left")
        blocked = blocked & ~F.coalesce("approved", F.lit(False))
    body = F.when(F.col("format") == "langchain", F.to_json(F.struct(F.lit("system").alias("type"), F.col("addendum").alias("content")))).otherwise(F.to_json(F.struct(F.lit("system").alias("role"), F.col("addendum").alias("content"))))
    body = F.when(F.col("addendum").isNotNull() & (F.col("format") != "anthropic"), body)
    extra = F.coalesce((opts.count_tokens or T.est_tokens)(body), F.lit(0))
    more = {}
    if signals is not None:
        df = df.join(signals.select("conv_id", "progress"), "conv_id", "left")
        more["progress"] = F.col("progress")
    if telemetry is not None:
        df = df.join(telemetry, "conv_id", "left")
        more |= {k: F.col(k) for k in ("requests", "input_tokens", "output_tokens", "latency_ms", "usd", "fit_stage", "state_tokens", "error")}
    return df.select(
        "conv_id", "format", "goal", "tokens_before", (F.col("own_after") + extra).alias("tokens_after"), "messages_before", (F.col("own_messages") + (extra > 0).cast("int")).alias("messages_after"),
        "skipped", blocked.alias("blocked"), F.col("block.kind").alias("block_kind"), F.col("block.evidence").alias("block_evidence"), "unjudged", "addendum",
        F.when(F.col("format") == "anthropic", F.col("addendum")).alias("system_addendum"), F.col("skipped").isNull().alias("compacted"), *[c.alias(k) for k, c in more.items()],
        (F.col("last") + 1).cast("int").alias("addendum_idx"), body.alias("addendum_json"),
    )


@dataclass(frozen=True)
class Compactor:
    """Options and a judge, for many runs."""

    opts: Options = Options()
    judge: object = None

    def __call__(self, messages: DataFrame, **changes) -> Result:
        run = {k: changes.pop(k) for k in ("goals", "pin", "cooling", "escrow", "store") if k in changes}
        return compact(messages, self.opts.merged(**changes), self.judge, **run)

    def gated(self, calls: DataFrame) -> DataFrame:
        """key, call_no and outcome of calls of a wrapped client (key, call_no, below, blocked), by the options' cooldown."""
        return cooldown(calls, self.opts.cooldown_turns)


def require_open(results: DataFrame) -> None:
    """Raise for the first blocked history."""
    row = results.filter("blocked").orderBy("conv_id").first()
    if row is not None:
        raise BlockedError(f"{row['conv_id']}: {row['block_kind']} {row['block_evidence'] or ''}".strip(), row.asDict())


def require_answers(results: DataFrame) -> None:
    if results.filter("skipped = 'judge_unavailable'").limit(1).count():
        raise UnavailableError("the judge gave no answer")


#: A history that ends on a dangerous proposal: a task, its evidence, small talk, a repeated failure.
SELF_TEST = (
    ("system", "You are careful."), ("user", "Fix src/app.ts, and leave the tables alone (T-17)."), ("assistant", "Reading src/app.ts"), ("user", "FAIL app.test.ts: got null"), ("assistant", "Nice weather."),
    ("user", "FAIL app.test.ts: got null"), ("assistant", "Sure."), ("user", "go on"), ("assistant", "I will run rm -rf /srv/app now"),
)


def self_test(spark, judge=None, opts: Options = Options()) -> dict:
    """One run over SELF_TEST, and the first stage that failed: judge (no answers), pipeline (the proposal was not found), or ok.

    A judge that gives signals must see the danger too; the one built in gives none, so patterns decide.
    """
    rows = spark.createDataFrame([("t", i, r, x) for i, (r, x) in enumerate(SELF_TEST)], "conv_id string, idx int, role string, content string")
    got = compact(rows.select("conv_id", "idx", F.to_json(F.struct("role", "content")).alias("message_json")), opts.merged(trigger="always", keep_recent=2, max_tokens=400, safety_gating=True), judge)
    row = got.results.first()
    seen = {r["source"] for r in got.findings.filter("kind = 'destructive' and level = 'action'").select("source").distinct().collect()}
    out = {"messages_before": row["messages_before"], "messages_after": row["messages_after"], "pattern": "pattern" in seen, "judge": "judge" in seen, "blocked": row["blocked"]}
    if row["skipped"] is not None:
        return out | {"ok": False, "stage": "judge", "error": row["skipped"]}
    fine = out["pattern"] and out["blocked"] and (out["judge"] or not hasattr(judge, "requests"))
    return out | {"ok": fine, "stage": "ok" if fine else "pipeline"}
