"""Relevance answers as tables: questions, batches, requests, folding, votes, and the judges.

The engine holds no model. A judge has one of two forms. A simple one turns the
candidates into rows of (conv_id, unit_id, vote, p_keep, confidence): ``TableJudge``
takes recorded answers, ``LexicalJudge`` is our own stand-in (the share of the goal's
words in a unit). ``always_answers`` says that no answer for a unit isn't a failure: a
history without any (nothing was asked about it, say) is unjudged, not unavailable.
One with ``requests`` is asked by the whole protocol: batches of
questions over an abridged state, as many votes as the options say, a state that is
too large abridged again, and failures told apart: ``HttpJudge`` asks a service from
the executors and is off without a client.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import AbortedError, StateTooLargeError
from ..functions import text as T
from ..options import Options, finite
from ..schema import SIGNAL_KINDS
from .skeleton import NOTE

#: Dollars for a token put in.
PRICE = 0.042 / 1e6
LEVELS = ("none", "some", "nearly done")


def candidate_question(position: Column) -> Column:
    """The keep-or-drop question about an entry, as JSON."""
    return F.format_string('{"type":"choice","question":"Is messages[%d] needed to reach the goal?","options":{"keep":"It holds facts, code, errors or decisions that are still needed.","drop":"It is small talk, repeated, or superseded."}}', position)


def history_questions(pending_position: Column) -> Column:
    """The five history-level questions, as an array of JSON."""
    subject = F.when(pending_position.isNotNull(), F.format_string("messages[%d]", pending_position)).otherwise("any entry of messages")
    ask = lambda name, text: F.concat(F.lit(f'{{"type":"probability","name":"{name}","question":"'), text, F.lit('"}'))
    return F.array(
        ask("destructive", F.concat(F.lit("Does "), subject, F.lit(" propose or run something that destroys data?"))),
        ask("exfiltration", F.concat(F.lit("Does "), subject, F.lit(" send secrets or private data outside?"))),
        ask("thrashing", F.lit("Do the newest entries repeat one failed step?")),
        ask("goal_drift", F.lit("Do the newest entries work on something else than the goal?")),
        F.lit(json.dumps({"type": "score", "name": "progress", "question": "How far is the goal reached?", "levels": LEVELS}, separators=(",", ":"))),
    )


def plan_batches(asked: DataFrame, opts: Options, state: Column | str = "state_tokens", question: Column | None = None, first_cost: Column | None = None) -> DataFrame:
    """conv_id, unit_id and batch_no of candidates in order (conv_id, unit_pos, unit_id, position, state tokens).

    A batch's cost restarts with every batch, so the fill is a fold over a history's costs, inside its row; it keeps
    only where batches begin. A question too large for any batch gets one of its own. ``first_cost`` is what the history's
    questions take of the first batch; without any, its first candidate never opens another.
    """
    state = F.col(state) if isinstance(state, str) else state
    cost = T.est_tokens(question if question is not None else candidate_question(F.col("position")))
    rows = asked.filter("position is not null").select("conv_id", "unit_pos", "unit_id", cost.alias("cost"), state.alias("state"), (first_cost if first_cost is not None else F.lit(0)).cast("int").alias("first_cost"))
    per = rows.groupBy("conv_id").agg(F.first("state").cast("int").alias("state"), F.first("first_cost").alias("first_cost"), F.sort_array(F.collect_list(F.struct("unit_pos", "unit_id", "cost"))).alias("q"))
    start = F.struct(F.lit(0).alias("k"), (F.col("state") + F.col("first_cost")).cast("int").alias("used"), (F.col("first_cost") > 0).alias("some"), F.array().cast("array<int>").alias("cuts"))

    def step(a: Column, x: Column) -> Column:
        over = a["some"] & (a["used"] + x["cost"] > opts.request_tokens)
        used = (F.when(over, F.col("state")).otherwise(a["used"]) + x["cost"]).cast("int")
        return F.struct((a["k"] + 1).alias("k"), used.alias("used"), F.lit(True).alias("some"), F.when(over, F.concat(a["cuts"], F.array(a["k"]))).otherwise(a["cuts"]).alias("cuts"))

    df = per.select("conv_id", "q", F.aggregate("q", start, step)["cuts"].alias("cuts"))
    df = df.select("conv_id", "cuts", F.posexplode("q").alias("k", "x"))
    return df.select("conv_id", F.col("x.unit_id").alias("unit_id"), F.size(F.filter("cuts", lambda c: c <= F.col("k"))).alias("batch_no"))


def batches(view: DataFrame, pending: DataFrame, opts: Options) -> DataFrame:
    """conv_id, batch_no, state (JSON) and questions (name, JSON) of the requests for abridged histories (skeleton rows).

    The history's own questions ride in batch 0, which every history has, even without a candidate.
    """
    at = view.join(pending.select("conv_id", F.col("pending_unit").alias("unit_id")), ["conv_id", "unit_id"]).select("conv_id", F.col("position").alias("pending_position"))
    entries = F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "entry"))))
    per = view.groupBy("conv_id").agg(F.first("goal").alias("goal"), F.first("state_tokens").alias("state_tokens"), entries.alias("entries")).join(at, "conv_id", "left")
    quoted = F.regexp_replace(F.to_json(F.struct("goal", F.lit(NOTE).alias("note"))), r"\}\z", "")
    per = per.withColumn("state", F.concat(quoted, F.lit(',"messages":['), F.array_join(F.transform("entries", lambda e: e["entry"]), ","), F.lit("]}")))
    names = (*SIGNAL_KINDS, "progress")
    per = per.withColumn("own", history_questions(F.col("pending_position"))).withColumn("own", F.arrays_zip(F.array(*map(F.lit, names)).alias("name"), F.col("own").alias("question")))
    first = F.aggregate("own", F.lit(0), lambda a, q: a + T.est_tokens(q["question"]))
    asked = view.filter("is_candidate and position is not null").join(per.select("conv_id", first.alias("first_cost")), "conv_id")
    plan = plan_batches(asked, opts, first_cost=F.col("first_cost")).join(asked.select("conv_id", "unit_id", "unit_pos", "position"), ["conv_id", "unit_id"])
    plan = plan.groupBy("conv_id", "batch_no").agg(F.sort_array(F.collect_list(F.struct("unit_pos", F.col("unit_id").alias("name"), candidate_question(F.col("position")).alias("question")))).alias("q"))
    plan = plan.unionByName(per.select("conv_id", F.lit(0).alias("batch_no"), F.array().cast(plan.schema["q"].dataType).alias("q"))).groupBy("conv_id", "batch_no").agg(F.flatten(F.collect_list("q")).alias("q"))
    kind = "array<struct<name:string,question:string>>"
    questions = F.concat(F.when(F.col("batch_no") == 0, F.col("own").cast(kind)).otherwise(F.array().cast(kind)), F.transform("q", lambda x: F.struct(x["name"].alias("name"), x["question"].alias("question"))))
    return plan.join(per.select("conv_id", "state", "own"), "conv_id").select("conv_id", "batch_no", "state", questions.alias("questions"))


#: What a request brought, one row for each batch and vote.
REQUESTS = (
    "conv_id string, vote int, batch_no int, ok boolean, error_type string, error string, input_tokens long, output_tokens long, latency_ms long, "
    "answers array<struct<unit_id:string,p_keep_raw:double,p_drop_raw:double,choice:string,confidence_raw:double>>, "
    "destructive double, exfiltration double, thrashing double, goal_drift double, progress double"
)


def clamp(p: Column) -> Column:
    return F.when(F.isnan(p), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def fold_answers(answers: DataFrame) -> DataFrame:
    """p_keep and confidence from raw answers (conv_id, unit_id, vote, p_keep_raw, p_drop_raw, choice, confidence_raw)."""
    p = F.coalesce("p_keep_raw", 1 - F.col("p_drop_raw"), F.when(F.col("choice") == "keep", 1.0).otherwise(0.0))
    return answers.select("conv_id", "unit_id", "vote", clamp(p).alias("p_keep"), clamp(F.col("confidence_raw")).alias("confidence"))


def fold_signals(answers: DataFrame) -> DataFrame:
    """A vote's signals over its batches: the greatest of each, progress of the last batch that has one."""
    return answers.groupBy("conv_id", "vote").agg(*[F.max(clamp(F.coalesce(k, F.lit(0.0)))).alias(k) for k in SIGNAL_KINDS], F.max_by("progress", F.when(F.col("progress").isNotNull(), F.col("batch_no"))).alias("progress"))


def average_votes(judgements: DataFrame) -> DataFrame:
    """Means over the votes that answered a unit; a vote that is no number counts for nothing, and without any other p_keep is null."""
    mean = lambda c: F.avg(F.when(finite(F.col(c)), F.col(c))).alias(c)
    return judgements.groupBy("conv_id", "unit_id").agg(mean("p_keep"), mean("confidence"), F.count(F.lit(1)).alias("votes"))


def average_signals(signals: DataFrame) -> DataFrame:
    """Means over all votes of a history; progress over those that scored it."""
    return signals.groupBy("conv_id").agg(*[F.avg(F.coalesce(k, F.lit(0.0))).alias(k) for k in SIGNAL_KINDS], F.avg("progress").alias("progress"))


def telemetry(requests: DataFrame) -> DataFrame:
    """Sums over the requests (input_tokens, output_tokens, latency_ms, ok) of each history."""
    return requests.groupBy("conv_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max("latency_ms").alias("latency_ms"), (F.sum("input_tokens") * PRICE).alias("usd"), F.count_if(~F.col("ok")).alias("failed"))


def run_failed(requests: DataFrame) -> DataFrame:
    """conv_id and whether a run failed: no vote's first batch was answered, or any batch was rejected for its size."""
    return requests.groupBy("conv_id").agg((~F.bool_or((F.col("batch_no") == 0) & F.col("ok")) | F.bool_or(F.coalesce(F.col("error_type") == "too_large", F.lit(False)))).alias("failed"))


#: Kinds of failed requests, by words of an error's name or message; anything else is a fault of our own.
ERROR_WORDS = {"too_large": "max.?tokens|too large|context length|413", "aborted": "abort|cancel", "judge": "judge|timeout|connect|http|unavailable"}


def error_type(error: Column | str) -> Column:
    """too_large, aborted, judge or other, by an error's name or message."""
    e = F.lower(F.col(error) if isinstance(error, str) else error)
    out = F.when(e.isNull(), None)
    for kind, words in ERROR_WORDS.items():
        out = out.when(e.rlike(words), kind)
    return out.otherwise("other")


@dataclass(frozen=True)
class TableJudge:
    """Recorded answers."""

    answers: DataFrame
    signal_table: DataFrame | None = None

    def ask(self, candidates: DataFrame) -> DataFrame:
        return self.answers

    def signals(self, candidates: DataFrame) -> DataFrame | None:
        return self.signal_table


@dataclass(frozen=True)
class LexicalJudge:
    """p_keep is the share of the goal's distinct words (lower case, 4 letters or more) that the unit has; 1 without such words."""

    always_answers = True

    def ask(self, candidates: DataFrame) -> DataFrame:
        words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0))
        goal, own = words(F.col("goal")), words(F.col("text"))
        p = F.when(F.size(goal) == 0, 1.0).otherwise(F.size(F.array_intersect(goal, own)) / F.size(goal))
        return candidates.select("conv_id", "unit_id", F.lit(0).alias("vote"), p.alias("p_keep"), F.lit(1.0).alias("confidence"))

    def signals(self, candidates: DataFrame) -> DataFrame | None:
        return None


class RequestError(Exception):
    """A service that did not answer: it could not be reached, was too slow, or said no."""


def classify(error: BaseException) -> str:
    """The kind of a failed request, by its class and then its text, as ``error_type`` does for tables."""
    if isinstance(error, StateTooLargeError):
        return "too_large"
    if isinstance(error, AbortedError | KeyboardInterrupt):
        return "aborted"
    if isinstance(error, RequestError | ConnectionError | TimeoutError):
        return "judge"
    text = f"{type(error).__name__} {error}".lower()
    for kind, words in ERROR_WORDS.items():
        if re.search(words, text):
            return kind
    return "other"


@dataclass(frozen=True)
class HttpJudge:
    """Asks a service: ``client()`` is made once for each worker and takes a request (state as JSON, questions by name).

    Its reply has ``answers`` by name: of a unit a dict with p_keep, p_drop or choice, and confidence; of a signal a number;
    and may have input_tokens and output_tokens. ``concurrency`` bounds the partitions that ask at once. A history's requests
    stop at the first one that is rejected for its size; a cancellation, or an error that is no failure to answer, ends the run.
    """

    client: Callable[[], Callable[[dict], dict]] | None = None
    concurrency: int = 8

    def requests(self, asked: DataFrame, votes: int) -> DataFrame:
        """REQUESTS rows of batches."""
        if self.client is None:
            raise ValueError("no client: the judge over HTTP is off")
        make, names = self.client, (*SIGNAL_KINDS, "progress")

        def one(ask, conv_id, batch_no, state, questions, vote) -> dict:
            row = {"conv_id": conv_id, "vote": vote, "batch_no": int(batch_no), "ok": False, "error_type": None, "error": None, "input_tokens": 0, "output_tokens": 0, "answers": [], **dict.fromkeys(names)}
            began = time.monotonic()
            try:
                reply = ask({"state": state, "questions": {q["name"]: json.loads(q["question"]) for q in questions}})
                got = dict(reply["answers"])
                row |= {k: float(got.pop(k)) for k in names if got.get(k) is not None}
                number = lambda x: None if x is None else float(x)
                row["answers"] = [{"unit_id": k, "p_keep_raw": number(v.get("p_keep")), "p_drop_raw": number(v.get("p_drop")), "choice": v.get("choice"), "confidence_raw": number(v.get("confidence", 1.0))} for k, v in got.items()]
                row |= {"ok": True, "input_tokens": int(reply.get("input_tokens", 0)), "output_tokens": int(reply.get("output_tokens", 0))}
            except Exception as error:  # noqa: BLE001  told apart here; what is no failure to answer goes on
                kind = classify(error)
                if kind in ("aborted", "other"):
                    raise
                row |= {"error_type": kind, "error": str(error)}
            return row | {"latency_ms": int((time.monotonic() - began) * 1000)}

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask, rejected = make(), None
            for part in parts:
                rows = []
                for r in part.itertuples(index=False):
                    for vote in range(votes):
                        if r.conv_id != rejected:
                            rows.append(one(ask, r.conv_id, r.batch_no, r.state, r.questions, vote))
                            rejected = r.conv_id if rows[-1]["error_type"] == "too_large" else None
                if rows:
                    yield pd.DataFrame(rows)[REQUEST_COLUMNS]

        dealt = asked.select("conv_id", "batch_no", "state", "questions").repartition(self.concurrency, "conv_id").sortWithinPartitions("conv_id", "batch_no")
        return dealt.mapInPandas(run, REQUESTS)


REQUEST_COLUMNS = [c.split()[0] for c in re.sub(r"<.*?>+", "", REQUESTS).split(", ")]


class Asked(NamedTuple):
    """What a judge's requests come to: answers of units, signals, histories that were answered, sums of the requests."""

    judgements: DataFrame
    signals: DataFrame
    answered: DataFrame
    telemetry: DataFrame


def collected(requests: DataFrame) -> Asked:
    """Folds REQUESTS rows (with ``attempt``): the last attempt of each history counts, if the run as a whole did not fail; all attempts cost."""
    last = requests.withColumn("_last", F.max("attempt").over(W.partitionBy("conv_id"))).filter(F.col("attempt") == F.col("_last"))
    fine = run_failed(last).filter("not failed").select("conv_id")
    good = last.filter("ok").join(fine, "conv_id", "left_semi")
    answers = good.select("conv_id", "vote", F.explode("answers").alias("a")).select("conv_id", "vote", "a.*")
    signals = average_signals(fold_signals(good.select("conv_id", "vote", "batch_no", *SIGNAL_KINDS, "progress")))
    costs = telemetry(requests.select("conv_id", "input_tokens", "output_tokens", "latency_ms", "ok"))
    errors = last.groupBy("conv_id").agg(F.min_by("error", F.struct("batch_no", "vote")).alias("error"))
    return Asked(average_votes(fold_answers(answers)), signals, fine, costs.join(errors, "conv_id", "left"))
