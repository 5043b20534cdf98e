"""The newest turns within a budget, with part of the turn that crosses it, against the rule in plain Python."""

import random

from threadloom.operators import baselines as B


def select(rows, budget):
    """Whole turns from the end; of the first that doesn't fit, the longest end that does."""
    size = lambda a, b: sum(-(-len(t) // 4) for _, _, t in rows[a:b])
    starts = [k for k, (_, kind, _) in enumerate(rows) if kind == "user"]
    total, keep, end = 0, len(rows), len(rows)
    for at in reversed(starts):
        if total + size(at, end) <= budget:
            total, keep, end = total + size(at, end), at, at
            continue
        if budget > total:
            keep = next((k for k in range(at + 1, end) if size(k, end) <= budget - total), keep)
        break
    return {rows[k][0] for k in range(keep, len(rows))} if keep else set()


def test_partial_turn(spark):
    rng = random.Random(3)
    histories = [[(0, "user", "a" * 40), (1, "assistant", "b" * 4000), (2, "tool_result", "c" * 200), (3, "assistant", "d" * 40)], [(0, "user", "a" * 4000)]]
    for _ in range(20):
        kinds = ["user", *rng.choices(["user", "assistant", "tool_result"], k=rng.randint(1, 12))]
        histories.append([(k, kind, "x" * rng.choice([0, 4, 120, 200, 400, 900])) for k, kind in enumerate(kinds)])
    rows = [(f"c{n}", *r) for n, h in enumerate(histories) for r in h]
    frames = spark.createDataFrame(rows, "conv_id string, idx int, kind string, text string")
    got = {}
    for r in B.turn_tail(frames, 10, 100, 0.25, 800).collect():
        got.setdefault(r.conv_id, set()).add(r.idx)
    assert {f"c{n}": select(h, 100) for n, h in enumerate(histories)} == {f"c{n}": got.get(f"c{n}", set()) for n in range(len(histories))}
    assert got["c0"] == {2, 3} and "c1" not in got
