"""Histories that a judge has no question about: all their candidates are left out of the abridged view, or it leaves them out."""

import json

from pyspark.sql import functions as F

from threadloom.operators import judge as J
from threadloom.options import Options
from threadloom.plans.compact import compact
from threadloom.plans.queries import _Recorded


def history(spark, *said):
    rows = [("c", i, json.dumps({"role": r, "content": t}, separators=(",", ":"))) for i, (r, t) in enumerate(said)]
    return spark.createDataFrame(rows, "conv_id string, idx int, message_json string")


SAID = [("user", "same words"), ("assistant", "other words"), ("user", "same words"), *[("assistant", f"step {k} " + "x" * 40) for k in range(6)], *[("system", "s")] * 4, ("user", "end")]


def test_all_omitted(spark):
    for judge in (_Recorded(), J.LexicalJudge()):
        got = compact(history(spark, *SAID), Options(keep_recent=1, state_tokens=1), judge)
        row = got.results.first()
        assert (row.skipped, row.compacted, row.messages_after, row.unjudged) == (None, True, 13, 8)
        assert {(r.decision, r.reason) for r in got.reports.collect()} == {("duplicate", "duplicate of u2"), ("kept", "unjudged"), ("pinned", "pinned:system"), ("pinned", "pinned:recent")}


def test_only_candidate_left_out(spark):
    """The sixth unit is the only candidate, and the recorded answers have none for it."""
    said = [("system", "s")] * 5 + [("user", "left out")] + [("user", "end")]
    row = compact(history(spark, *said), Options(keep_recent=1), _Recorded()).results.first()
    assert (row.skipped, row.compacted, row.unjudged) == (None, True, 1)


def test_table_without_answers_fails_open(spark):
    none = spark.createDataFrame([], "conv_id string, unit_id string, vote int, p_keep double, confidence double")
    got = compact(history(spark, *SAID), Options(keep_recent=1, state_tokens=1), J.TableJudge(none))
    assert got.results.first().skipped == "judge_unavailable" and got.messages.count() == len(SAID) and got.reports.filter(F.col("decision") == "duplicate").count() == 0
