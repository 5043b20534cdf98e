"""Single operators on small histories, and window forms against plain loops."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.patterns import PATTERNS, RE2_SAFE
from threadloom.operators import baselines as B
from threadloom.operators import decide as D
from threadloom.operators import findings as X
from threadloom.operators import judge as J
from threadloom.operators import metrics as M
from threadloom.operators.normalize import default_goals, detect_format, normalize, parsed
from threadloom.operators.prepass import prepass
from threadloom.operators.skeleton import skeleton
from threadloom.operators.units import group_units, pending_units
from threadloom.options import Options
from threadloom.plans.compact import compact, self_test
from threadloom.sources import readers
from threadloom.sources.transcripts import generated
from threadloom.streaming.gate import cooldown


def messages(spark, histories: dict[str, list]):
    rows = [(c, i, json.dumps(m, separators=(",", ":"), ensure_ascii=False)) for c, h in histories.items() for i, m in enumerate(h)]
    return spark.createDataFrame(rows, "conv_id string, idx int, message_json string")


SHAPES = {
    "openai": [{"role": "system", "content": "s"}, {"role": "user", "content": "Fix src/a.ts"}, {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "read", "arguments": '{"p":1}'}}]}, {"role": "tool", "tool_call_id": "c1", "content": "ok"}],
    "anthropic": [{"role": "user", "content": "Fix it"}, {"role": "assistant", "content": [{"type": "text", "text": "look"}, {"type": "tool_use", "id": "t1", "name": "read", "input": {"p": 1}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "fine"}]}],
    "langchain": [{"type": "human", "content": "Fix it"}, {"type": "ai", "content": "", "tool_calls": [{"id": "l1", "name": "read", "args": {"p": 1}}]}, {"type": "tool", "tool_call_id": "l1", "content": "ok", "name": "read"}],
    "plain": [{"role": "user", "content": "Hello"}, {"role": "assistant", "content": "Hi"}],
    "legacy": [{"role": "assistant", "content": None, "function_call": {"name": "f", "arguments": "{}"}}, {"role": "function", "name": "f", "content": "r"}],
}


def test_shapes(spark):
    m = messages(spark, SHAPES)
    formats = {r[0]: r[1] for r in detect_format(parsed(m)).collect()}
    assert formats == {"openai": "openai", "anthropic": "anthropic", "langchain": "langchain", "plain": "plain", "legacy": "openai"}
    f = {(r.conv_id, r.idx): r for r in normalize(m).collect()}
    assert f["openai", 2].kind == "tool_call" and f["openai", 2].text == '[tool_call read c1] {"p":1}'
    assert f["anthropic", 1].text == 'look\n[tool_use read t1] {"p":1}' and f["anthropic", 2].kind == "tool_result" and f["anthropic", 2].text == "[tool_result t1] fine"
    assert f["langchain", 1].kind == "tool_call" and f["langchain", 0].role == "user" and f["langchain", 2].tool_names == ["read"]
    assert f["legacy", 0].tool_call_ids == f["legacy", 1].tool_call_ids == ["function:f"]
    units = {(r.conv_id, r.unit_pos): r.indices for r in group_units(normalize(m)).collect()}
    assert units["openai", 2] == [2, 3] and units["anthropic", 1] == [1, 2] and units["legacy", 0] == [0, 1]
    assert {r[0]: r[1] for r in default_goals(normalize(m)).collect()}["openai"] == "Fix src/a.ts"


def test_null_content_and_empty(spark):
    f = normalize(messages(spark, {"x": [{"role": "user", "content": None}, {"role": "nobody"}]})).collect()
    assert [r.text for r in f] == ["", ""] and [r.role for r in f] == ["user", "user"]
    empty = spark.createDataFrame([], "conv_id string, idx int, message_json string")
    assert compact(empty).results.count() == 0


def test_patterns(spark):
    """Every pattern finds and lets pass what the samples say."""
    from threadloom.sources.samples import COMMANDS

    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(COMMANDS)], "k int, t string").select("k", *[F.col("t").rlike(p.regex).alias(p.name) for p in PATTERNS])
    found = {r["k"]: {p.name for p in PATTERNS if r[p.name]} for r in df.collect()}
    assert {k: found[k] for k in found if found[k] != set(COMMANDS[k][1])} == {}
    assert len(PATTERNS) == 27 and {n for _, names in COMMANDS for n in names} == {p.name for p in PATTERNS} and RE2_SAFE


def test_patterns_by_frame(spark):
    """A frame that matches alone is found though the joined text doesn't match, and the other way round."""
    h = [{"role": "assistant", "content": "git", "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "git"}}]}, {"role": "tool", "tool_call_id": "a", "content": "rm -rf /srv/x"}, {"role": "assistant", "content": "git reset", "tool_calls": [{"id": "b", "function": {"name": "f", "arguments": "drop"}}]}, {"role": "tool", "tool_call_id": "b", "content": "table x"}]
    got = {(r.unit_pos, r.evidence): r.indices for r in X.scan_patterns(group_units(normalize(messages(spark, {"c": h})))).collect()}
    assert got == {(0, "rm-recursive: rm -rf /srv/x"): [1], (1, "sql-drop: drop\ntable"): [2, 3]}


def test_path_search(spark):
    """The pattern that is searched with finds what PATH_LIKE finds, and takes no square of a long run's length."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@./- \n") for _ in range(rng.randrange(40))) for _ in range(4000)] + ["a/b@c/@ @c/d", "a/b@c x@/y", "@/a/@b/"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    find = lambda p: F.regexp_extract_all("t", F.lit(p), 0)
    assert df.filter(find(T.PATH_LIKE) != find(T.PATH_SEARCH)).count() == 0 and df.filter(F.size(find(T.PATH_LIKE)) > 1).count() > 100
    began = time.time()
    assert spark.range(1).select(F.size(T.paths(F.repeat(F.lit("x"), 300_000)))).first()[0] == 0 and time.time() - began < 20


def test_text_functions(spark):
    df = spark.createDataFrame([("x" * 100, "a 😀")], "t string, u string")
    r = df.select(T.excerpt("t", 10).alias("e"), T.excerpt("t", 0).alias("z"), T.one_line(F.lit(" a \n b "), 9).alias("o"), T.one_line("t", 5).alias("p"), T.u16len("u").alias("n"), T.est_tokens(F.lit("")).alias("q")).first()
    assert r.e == "x" * 7 + " […90 chars omitted…] " + "x" * 3 and r.z == " […100 chars omitted…] " and r.o == "a b" and r.p == "xxxx…" and r.n == 4 and r.q == 0
    r = spark.range(1).select(T.paths(F.lit("see src/a.ts and b.py, http://x.y/z")).alias("p"), T.has_code(F.lit("+a\n-b\n+c")).alias("c"), T.split_joined(F.lit("package.json/lock.json")).alias("s"), T.between(F.lit("a<t>b</t>c"), "t").alias("b")).first()
    assert r.p == ["src/a.ts", "x.y/z", "a.ts", "b.py", "http://x.y/z"] or "src/a.ts" in r.p
    assert r.c and r.s == ["package.json", "lock.json"] and r.b == "b"


def _naive(units, opts):
    """Decisions of one history by plain loops: units are (candidate, tokens, p_keep)."""
    dec = ["pinned" if not c else "dropped" if p is not None and 1 - p >= opts.drop_threshold - 1e-9 else "kept" for c, _, p in units]
    kept = sum(c and d == "kept" for (c, _, _), d in zip(units, dec))
    for i in reversed(range(len(units))):
        if kept >= opts.min_keep:
            break
        if dec[i] == "dropped":
            dec[i], kept = "kept", kept + 1
    total = sum(t for (_, t, _), d in zip(units, dec) if d != "dropped")
    for i in sorted((i for i, (c, _, p) in enumerate(units) if c and dec[i] == "kept" and p is not None), key=lambda i: (units[i][2], i)):
        if total <= opts.max_tokens or kept <= opts.min_keep:
            break
        dec[i] = "dropped" if 1 - units[i][2] >= opts.drop_threshold_second_pass - 1e-9 else "budget"
        total, kept = total - units[i][1], kept - 1
    return dec


def test_decide_is_the_loop(spark):
    rng = random.Random(7)
    opts = Options(max_tokens=120, min_keep=2)
    cases = {f"c{k}": [(rng.random() < 0.7, rng.randint(1, 40), rng.choice([None, *[x / 20 for x in range(21)]])) for _ in range(rng.randint(1, 15))] for k in range(150)}
    rows = [(c, i, f"u{i}", t, None if k else "recent") for c, us in cases.items() for i, (k, t, _) in enumerate(us)]
    units = spark.createDataFrame(rows, "conv_id string, unit_pos int, unit_id string, tokens int, pin_reason string").withColumn("dup_reason", F.lit(None).cast("string")).withColumn("is_candidate", F.col("pin_reason").isNull())
    answers = [(c, f"u{i}", float(p), 1.0) for c, us in cases.items() for i, (_, _, p) in enumerate(us) if p is not None] + [(c, "none", 1.0, 1.0) for c in cases]
    got = D.decide(units, spark.createDataFrame(answers, "conv_id string, unit_id string, p_keep double, confidence double"), None, opts)
    found = {(r.conv_id, r.unit_pos): r.decision for r in got.collect()}
    for c, us in cases.items():
        assert [found[c, i] for i in range(len(us))] == _naive(us, opts), (c, us)


def test_grouping_is_the_loop(spark):
    rng = random.Random(3)
    cases = {}
    for k in range(60):
        h = []
        for _ in range(rng.randint(1, 14)):
            x = rng.random()
            ident = f"i{rng.randint(0, 3)}"
            h.append({"role": "assistant", "content": None, "tool_calls": [{"id": ident, "function": {"name": "f", "arguments": "{}"}}]} if x < 0.3 else {"role": "tool", "tool_call_id": ident, "content": "r"} if x < 0.75 else {"role": "user", "content": "u"})
        cases[f"c{k}"] = h
    got = {}
    for r in group_units(normalize(messages(spark, cases), "openai")).orderBy("conv_id", "unit_pos").collect():
        got.setdefault(r.conv_id, []).append(r.indices)
    for c, h in cases.items():
        used, want = set(), []
        for i, m in enumerate(h):
            if i in used:
                continue
            group = [i]
            if m.get("tool_calls"):
                for j in range(i + 1, len(h)):
                    if h[j]["role"] != "tool":
                        break
                    if h[j]["tool_call_id"] == m["tool_calls"][0]["id"]:
                        group.append(j)
                        used.add(j)
            want.append(group)
        assert got[c] == want


def test_pins_and_duplicates(spark):
    h = [{"role": "system", "content": "s"}, {"role": "user", "content": "same"}, {"role": "user", "content": "same"}, {"role": "assistant", "content": "see SRC/app.ts"}, {"role": "user", "content": "same"}, {"role": "user", "content": "fix src/app.ts"}]
    f = normalize(messages(spark, {"c": h}))
    got = {r.unit_pos: (r.pin_reason, r.dup_reason) for r in prepass(group_units(f), default_goals(f), Options(keep_recent=1)).collect()}
    assert got[0] == ("pinned:system", None) and got[1] == (None, "duplicate of u4") and got[2] == (None, "duplicate of u4") and got[4] == (None, None) and got[5] == ("pinned:recent", None)
    assert got[3][0].startswith("pinned:goal-path ")


def test_skeleton_fits_or_is_last(spark):
    f = normalize(generated(spark, 3, 60))
    for limit in (30000, 3000, 1200, 400):
        opts = Options(keep_recent=2, state_tokens=limit)
        rows = skeleton(prepass(group_units(f), default_goals(f), opts), opts).collect()
        assert all(r.state_tokens <= limit or r.fit_stage == 5 for r in rows)
        assert all(not r.omitted or (r.old and r.is_candidate) for r in rows)


def test_batches(spark):
    rows = [("c", i, f"u{i}", i, 100) for i in range(10)]
    df = spark.createDataFrame(rows, "conv_id string, unit_pos int, unit_id string, position int, state_tokens int")
    got = {r.unit_id: r.batch_no for r in J.plan_batches(df, Options(request_tokens=160), question=F.rpad(F.lit("q"), 50, "q"), first_cost=F.lit(30)).collect()}
    assert [got[f"u{i}"] for i in range(10)] == [0, 1, 1, 1, 2, 2, 2, 3, 3, 3] or got["u0"] == 0


def test_run_keeps_originals_and_pairs(spark):
    m = generated(spark, 4, 50)
    got = compact(m, Options(max_tokens=500, keep_recent=3))
    assert got.messages.join(m, ["conv_id", "idx", "message_json"], "left_anti").count() == 0
    assert B.sanitize_pairs(normalize(got.messages)).count() == B.sanitize_pairs(normalize(m)).count() == 0
    assert got.reports.filter("reason is null").count() == 0
    assert self_test(spark)["ok"]


def test_blocked_and_escrow(spark):
    m = messages(spark, {"c": [{"role": "user", "content": "clean up"}, {"role": "assistant", "content": "rm -rf /srv/x"}], "d": [{"role": "assistant", "content": "rm -rf /srv/x"}, {"role": "user", "content": "no"}]})
    opts = Options(safety_gating=True)
    assert {r.conv_id: r.blocked for r in compact(m, opts).results.collect()} == {"c": True, "d": False}
    yes = spark.createDataFrame([("c", True)], "conv_id string, approved boolean")
    assert {r.conv_id: r.blocked for r in compact(m, opts, escrow=yes).results.collect()} == {"c": False, "d": False}
    f = X.leveled(X.scan_patterns(group_units(normalize(m))))
    assert X.blocking(f, pending_units(group_units(normalize(m)))).count() == 1


def test_cooldown_is_the_loop(spark):
    rng = random.Random(5)
    calls = [(f"k{k}", i, rng.random() < 0.3, rng.random() < 0.2) for k in range(20) for i in range(rng.randint(1, 12))]
    got = {(r.key, r.call_no): r.outcome for r in cooldown(spark.createDataFrame(calls, "key string, call_no long, below boolean, blocked boolean"), 2).collect()}
    left: dict[str, int] = {}
    for key, i, below, blocked in calls:
        if left.get(key, 0) > 0:
            want, left[key] = "cooldown", left[key] - 1
        else:
            want = "below_threshold" if below else "blocked" if blocked else "compacted"
            left[key] = 2 if want == "compacted" else 0
        assert got[key, i] == want


def test_truncate_is_the_loop(spark):
    f = normalize(generated(spark, 3, 30))
    sizes: dict[str, list[int]] = {}
    for r in f.orderBy("conv_id", "idx").collect():
        sizes.setdefault(r.conv_id, []).append(r.tokens)
    got: dict[str, set[int]] = {}
    for r in B.truncate_oldest(f, 300).collect():
        got.setdefault(r.conv_id, set()).add(r.idx)
    for c, t in sizes.items():
        keep = list(range(len(t)))
        while sum(t[i] for i in keep) > 300 and len(keep) > 1:
            del keep[1]
        assert got[c] == set(keep)


def test_metrics(spark):
    f = normalize(messages(spark, {"c": [{"role": "user", "content": "see src/a.ts"}]}))
    g = normalize(messages(spark, {"c": [{"role": "user", "content": "see src/a.ts and made/up.ts"}]}))
    r = M.path_fidelity(f, g).first()
    assert 0 < r.ratio < 1 and M.hallucinated(f, g).count() >= 1


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.jsonl").write_text('{"type":"user","message":{"role":"user","content":"q"}}\n\nbroken\n{"type":"assistant","message":{"role":"assistant","content":null}}\n{"type":"summary"}\n')
    assert readers.read_any(spark, str(tmp_path / "a.json")).count() == 2
    with pytest.raises(Exception, match="not a list of messages"):
        readers.read_json(spark, str(tmp_path / "b.json")).collect()
    rows = readers.read_any(spark, str(tmp_path / "c.jsonl")).orderBy("idx").collect()
    assert [r.idx for r in rows] == [0, 1] and json.loads(rows[1].message_json)["content"] == ""
    assert readers.parse_env("# c\nexport A='1'\nB=2 # x\n") == {"A": "1", "B": "2"}
    m = spark.createDataFrame([("c", 0, '{"role":"assistant","text":"t","toolUses":[{"tool_use_id":"i","tool":"f","input":{"a":1}}]}')], "conv_id string, idx int, message_json string")
    assert json.loads(readers.tool_uses_shape(m).first().message_json)["content"][1] == {"type": "tool_use", "id": "i", "name": "f", "input": {"a": 1}}


def test_to_openai_and_back(spark):
    from threadloom.sources.shapes import append_system, to_openai

    out = to_openai(messages(spark, SHAPES))
    f = {(r.conv_id, r.idx): r for r in normalize(out, "openai").collect()}
    assert f["anthropic", 1].kind == "tool_call" and f["anthropic", 2].kind == "tool_result" and f["langchain", 1].tool_call_ids == ["l1"] and f["legacy", 1].kind == "tool_result"
    assert sum(len(h) for h in SHAPES.values()) == out.count()
    r = spark.range(1).select(append_system(F.lit('"a"'), F.lit("b")).alias("s"), append_system(F.lit('[{"type":"text","text":"a"}]'), F.lit("b")).alias("l"), append_system(F.lit(None).cast("string"), F.lit("b")).alias("n")).first()
    assert json.loads(r.s) == "a\n\nb" and len(json.loads(r.l)) == 2 and json.loads(r.n) == "b"


def test_custom_tokens_reasoning_and_cost(spark):
    m = messages(spark, {"c": [{"role": "assistant", "content": [{"type": "thinking", "text": "x"}, {"type": "text", "text": "y"}]}, {"role": "assistant", "content": [{"type": "thinking", "text": "z"}]}]})
    assert normalize(m, count_tokens=T.tokens_by_bytes).filter("tokens > 0").count() == 2
    assert [json.loads(r.message_json)["content"] for r in B.drop_reasoning(m).orderBy("idx").collect()] == [[{"type": "text", "text": "y"}], [{"type": "thinking", "text": "z"}]]
    assert B.drop_reasoning(m, False).count() == 1
    u = spark.createDataFrame([("c", 10, 1), ("c", 20, 2)], "conv_id string, input_tokens int, output_tokens int")
    assert B.cost(u, 0.5, 2.0).first().usd == 21.0
