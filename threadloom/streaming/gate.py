"""Cooldown of calls by conversation: a pass over sorted rows for tables, state for streams.

A call of a conversation that is cooling down is skipped and counts down; any
other call runs, and cools its conversation down unless it was below the
threshold or blocked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CALLS = "key string, call_no long, below boolean, blocked boolean"
GATED = "key string, call_no long, outcome string"


def _outcome(left: int, below: bool, blocked: bool, turns: int) -> tuple[str, int]:
    if left > 0:
        return "cooldown", left - 1
    if below or blocked:
        return ("below_threshold" if below else "blocked"), 0
    return "compacted", turns


def cooldown(calls: DataFrame, turns: int = 1) -> DataFrame:
    """key, call_no and outcome (cooldown, below_threshold, blocked, compacted) of calls in order of call_no.

    One pass over the calls sorted by key: a key's calls may span batches, and nothing of them is held but what is left of its cooldown.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, left = None, 0
        for part in parts:
            out = []
            for own, below, blocked in zip(part["key"], part["below"], part["blocked"], strict=True):
                outcome, left = _outcome(left if own == key else 0, below, blocked, turns)
                key = own
                out.append(outcome)
            yield pd.DataFrame({"key": part["key"], "call_no": part["call_no"], "outcome": out})

    dealt = calls.select("key", F.col("call_no").cast("long").alias("call_no"), "below", "blocked").repartition("key").sortWithinPartitions("key", "call_no")
    return dealt.mapInPandas(run, GATED)


def cooldown_stream(calls: DataFrame, turns: int = 1, ttl_ms: int | None = None) -> DataFrame:
    """The same over a stream of calls.

    With ``ttl_ms`` a key's state is dropped after so long without a call. That needs a processing-time trigger:
    a time-out asks for another batch for ever, so an availableNow run with one would not end.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("call_no", kind="stable")
        out = []
        for call in rows.itertuples():
            outcome, left = _outcome(left, call.below, call.blocked, turns)
            out.append(outcome)
        state.update((left,))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": key[0], "call_no": rows["call_no"].values, "outcome": out})

    return calls.groupBy("key").applyInPandasWithState(run, GATED, "left int", "append", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def gate(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that go on, and blocked ones: rows of their own, never dropped in silence."""
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    return calls.filter(~blocked), calls.filter(blocked)
