"""The judge's protocol end to end, with clients that answer, reject by size, fail, cancel, and break; and the safety paths."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from threadloom.errors import AbortedError, StateTooLargeError
from threadloom.operators import judge as J
from threadloom.operators.normalize import normalize
from threadloom.operators.prepass import prepass
from threadloom.operators.skeleton import skeleton
from threadloom.operators.units import group_units, pending_units
from threadloom.options import Options
from threadloom.plans import render
from threadloom.plans.compact import Compactor, compact, self_test
from threadloom.sources.transcripts import generated

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module

OPTS = Options(keep_recent=2, max_tokens=10**6, min_keep=0)


def messages(spark, histories):
    rows = [(c, i, json.dumps(m, separators=(",", ":"))) for c, h in histories.items() for i, m in enumerate(h)]
    return spark.createDataFrame(rows, "conv_id string, idx int, message_json string")


def http(reply):
    """A judge whose client is ``reply(request)``, made anew in each worker."""
    return J.HttpJudge(lambda: reply, 2)


def say(p):
    def reply(request):
        asked = [q for q in request["questions"] if q.startswith("u")]
        return {"answers": {**{q: {"p_keep": p, "confidence": 1.0} for q in asked}, "destructive": 0.1, "progress": 1.0}, "input_tokens": len(request["state"]), "output_tokens": 5}

    return reply


@pytest.fixture(scope="module")
def sessions(spark):
    return generated(spark, 3, 40)


def test_answers_and_votes(spark, sessions):
    got = compact(sessions, OPTS.merged(votes=3, request_tokens=2500), http(say(0.1)))
    r = got.results.collect()
    assert all(x.skipped is None and x.unjudged == 0 and x.progress == 1.0 and x.requests % 3 == 0 and x.requests > 3 and x.fit_stage == 0 for x in r)
    assert got.reports.filter("decision = 'dropped'").count() > 20 and got.reports.filter("reason like 'judge:drop p=0.90'").count() > 20
    assert " ms · $0.0" in render.summary_line(got.results).first().line
    few = compact(sessions, OPTS.merged(request_tokens=10**6), http(say(0.1))).results
    assert {x.requests for x in few.collect()} == {1}
    first = {x.conv_id: x.input_tokens for x in few.collect()}
    small = {x.conv_id: x.input_tokens for x in compact(sessions, OPTS.merged(request_tokens=10**6, excerpt_chars=10, truncate_head_chars=2), http(say(0.1))).results.collect()}
    assert all(small[c] < first[c] for c in first)


def test_stage_five_leaves_units_unjudged(spark, sessions):
    opts = OPTS.merged(state_tokens=700)
    got = compact(sessions, opts, http(say(0.1)))
    units = prepass(group_units(normalize(sessions)), None, opts)
    left = skeleton(units, opts).filter("omitted").groupBy("conv_id").count().collect()
    assert left and {r.conv_id: r["count"] for r in left} == {r.conv_id: r.unjudged for r in got.results.collect()}
    assert {r.fit_stage for r in got.results.collect()} == {5}


def test_size_ladder(spark, sessions):
    def reply(request):
        if len(request["state"]) > 2000:
            raise StateTooLargeError("413")
        return say(0.2)(request)

    got = compact(sessions, OPTS, http(reply)).results.collect()
    assert all(r.skipped is None and r.requests > 1 and r.state_tokens * 2.5 <= 2003 for r in got)

    def never(request):
        raise StateTooLargeError("max_tokens exceeded")

    got = compact(sessions, OPTS, http(never))
    assert {r.skipped for r in got.results.collect()} == {"judge_unavailable"} and got.messages.count() == sessions.count()
    assert all(1 < r.requests <= 8 for r in got.results.collect())


def test_failures(spark, sessions):
    def dead(request):
        raise ConnectionError("no route")

    got = compact(sessions, OPTS, http(dead))
    assert {(r.skipped, r.error) for r in got.results.collect()} == {("judge_unavailable", "no route")} and got.messages.count() == sessions.count()
    with pytest.raises(Exception, match="judge unavailable"):
        compact(sessions, OPTS.merged(fail_closed=True), http(dead)).results.collect()

    def later(request):  # only the first batch, which has the history's questions, is answered
        if "destructive" not in request["questions"]:
            raise TimeoutError("slow")
        return say(0.1)(request)

    r = compact(sessions, OPTS.merged(request_tokens=2500), http(later)).results.collect()
    assert all(x.skipped is None and x.unjudged > 0 for x in r)

    def first(request):  # all but the first batch
        if "destructive" in request["questions"]:
            raise TimeoutError("slow")
        return say(0.1)(request)

    assert {x.skipped for x in compact(sessions, OPTS.merged(request_tokens=2500), http(first)).results.collect()} == {"judge_unavailable"}
    for error in (AbortedError("stop"), KeyError("a fault of our own")):

        def broken(request, error=error):
            raise error

        with pytest.raises(Exception, match="stop|fault of our own"):
            compact(sessions, OPTS, http(broken)).results.collect()


def test_batches_are_the_loop(spark, sessions):
    opts = OPTS.merged(request_tokens=2600)
    units = group_units(normalize(sessions))
    view = skeleton(prepass(units, None, opts), opts)
    rows = {}
    for b in J.batches(view, pending_units(units), opts).collect():
        rows.setdefault(b.conv_id, {})[b.batch_no] = (b.state, [(q.name, q.question) for q in b.questions])
    est = lambda t: -(-len(t) * 2 // 5)
    for c, found in rows.items():
        own = [q for q in found[0][1] if not q[0].startswith("u")]
        assert [n for n, _ in own] == ["destructive", "exfiltration", "thrashing", "goal_drift", "progress"] and all(json.loads(q) for _, q in own)
        own_view = sorted(view.filter(F.col("conv_id") == c).collect(), key=lambda r: r.unit_pos)
        state = json.loads(found[0][0])
        assert [json.dumps(m, separators=(",", ":"), ensure_ascii=False) for m in state["messages"]] == [r.entry for r in own_view if r.position is not None]
        used, batch, want = own_view[0].state_tokens + sum(est(q) for _, q in own), 0, {}
        for r in own_view:
            if r.is_candidate and r.position is not None:
                q = f'{{"type":"choice","question":"Is messages[{r.position}] needed to reach the goal?","options":{{"keep":"It holds facts, code, errors or decisions that are still needed.","drop":"It is small talk, repeated, or superseded."}}}}'
                if used + est(q) > opts.request_tokens:
                    batch, used = batch + 1, own_view[0].state_tokens
                used += est(q)
                want.setdefault(batch, []).append(r.unit_id)
        assert {k: [n for n, _ in qs if n.startswith("u")] for k, (_, qs) in found.items()} == {k: want.get(k, []) for k in range(max(want) + 1)}


def test_classify():
    assert [J.classify(e) for e in (StateTooLargeError(), AbortedError(), ConnectionError(), TimeoutError(), ValueError("HTTP 413"), ValueError("x"), ValueError("http 503"))] == ["too_large", "aborted", "judge", "judge", "too_large", "other", "judge"]


def test_passed_histories_read_no_judge(spark):
    h = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "rm -rf /srv/x"}, {"role": "user", "content": "b"}, {"role": "user", "content": "b"}]
    m = messages(spark, {"cool": h, "warm": h})
    units = group_units(normalize(m))
    answers = units.select("conv_id", "unit_id", F.lit(0).alias("vote"), F.lit(0.05).alias("p_keep"), F.lit(1.0).alias("confidence"))
    signals = spark.createDataFrame([(c, 0, 1.0, 0.0, 0.9, 0.0, 1.0) for c in ("cool", "warm")], "conv_id string, vote int, destructive double, exfiltration double, thrashing double, goal_drift double, progress double")
    cooling = spark.createDataFrame([("cool",)], "conv_id string")
    got = compact(m, Options(keep_recent=1, min_keep=0), J.TableJudge(answers, signals), cooling=cooling)
    assert {r.conv_id for r in got.reports.collect()} == {"warm"} and got.messages.filter("conv_id = 'cool'").count() == 4
    assert {(r.conv_id, r.source) for r in got.findings.collect()} == {("cool", "pattern"), ("warm", "pattern"), ("warm", "judge")}
    assert {r.conv_id: (r.skipped, r.addendum is None, r.unjudged) for r in got.results.collect()} == {"cool": ("cooldown", True, 0), "warm": (None, False, 0)}


def test_fail_open_keeps_flags(spark):
    h = [{"role": "user", "content": "go"}, {"role": "assistant", "content": "rm -rf /srv/x"}, {"role": "user", "content": "same"}, {"role": "assistant", "content": "rm -rf /srv/x"}, {"role": "user", "content": "same"}, {"role": "user", "content": "end"}]
    m = messages(spark, {"c": h})
    none = spark.createDataFrame([], "conv_id string, unit_id string, vote int, p_keep double, confidence double")
    got = compact(m, Options(keep_recent=1), J.TableJudge(none))
    assert {r.unit_pos: (r.decision, r.reason) for r in got.reports.collect()} == {
        0: ("kept", "judge:unavailable"), 1: ("flagged", "flagged:destructive rm-recursive: rm -rf /srv/x (was judge:unavailable (was duplicate of u3))"), 2: ("kept", "judge:unavailable (was duplicate of u4)"),
        3: ("flagged", "flagged:destructive rm-recursive: rm -rf /srv/x (was judge:unavailable)"), 4: ("kept", "judge:unavailable"), 5: ("pinned", "pinned:recent"),
    }
    assert got.messages.count() == 6


def test_options_reach_the_run(spark):
    h = [{"role": "system", "content": "s"}, {"role": "user", "content": "word goal"}, {"role": "assistant", "content": "danger zone"}, {"role": "user", "content": "x"}, {"role": "user", "content": "y"}]
    m = messages(spark, {"c": h})
    from threadloom.functions.patterns import Pattern
    from threadloom.functions.text import tokens_by_bytes

    got = compact(m, Options(keep_recent=1, patterns=(Pattern("own", "destructive", "danger"),), count_tokens=tokens_by_bytes), pin=F.col("idx") == 1, goals=spark.createDataFrame([("c", "given")], "conv_id string, goal string"))
    by = {r.unit_pos: r for r in got.reports.collect()}
    assert by[1].reason == "pinned:caller" and by[2].decision == "flagged" and by[0].tokens == -(-len(json.dumps(h[0], separators=(",", ":"))) // 4) and got.results.first().goal == "given"
    calls = spark.createDataFrame([("k", i, False, False) for i in range(6)], "key string, call_no long, below boolean, blocked boolean")
    for turns, n in ((0, 6), (1, 3), (2, 2)):
        assert Compactor(Options(cooldown_turns=turns)).gated(calls).filter("outcome = 'compacted'").count() == n


def test_inspect_and_self_test(spark):
    h = [{"role": "system", "content": "s"}, {"role": "user", "content": "fix secret-key-1"}, {"role": "assistant", "content": "rm -rf /srv/x secret-key-1"}]
    m = messages(spark, {"c": h})
    signals = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.9, 0.4, 1.0)], "conv_id string, vote int, destructive double, exfiltration double, thrashing double, goal_drift double, progress double")
    answers = spark.createDataFrame([("c", "u1", 0, 0.9, 1.0)], "conv_id string, unit_id string, vote int, p_keep double, confidence double")
    got = compact(m, Options(keep_recent=1, safety_gating=True), J.TableJudge(answers, signals))
    lines = [r.line for r in render.inspect(got, 100, "secret-key-1").orderBy("line_no").collect()]
    assert lines[0] == "goal     fix [redacted]" and lines[1] == "format   plain · 3 messages · 3 units" and lines[3] == "blocked  yes (safety gating)" and lines[4] == ""
    assert lines[5].startswith("PIN    u0  #0  system") and re.match(r"FLAG   u2  #2  assistant +\d+ tok  flagged:destructive", lines[7]) and not any("secret-key-1" in x for x in lines)
    assert lines[9] == "findings" and lines[10].startswith("  action  destructive   pattern  p=1.00  #2  rm-recursive") and "  review  goal_drift    judge    p=0.40" in lines and "corrective" in lines
    assert self_test(spark)["stage"] == "ok"

    def dead(request):
        raise ConnectionError("no")

    assert self_test(spark, http(dead))["stage"] == "judge" and self_test(spark, http(say(0.5)))["stage"] == "pipeline"
