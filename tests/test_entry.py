"""The registry, and every query against its SQL on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
from threadloom.plans.oracles import ORACLES
from threadloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "events documents pages conversations".split()
#: Quick ones that between them touch every module; the driver compares all of them.
SOME = ("detect_format", "extract_paths", "group_units", "pin_units", "scan_patterns_full", "skeleton_stage", "decide_budget", "flag_units", "blocked_by", "corrective_prompt", "reassemble_kept", "fold_answers", "path_fidelity", "keep_last_20", "turn_tail", "cooldown_gate", "summary_line")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as from '{p}'" if os.path.isfile(p) else f"create view {t} as from '{p}/*.parquet'")
    return c


def test_registry():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    round_ = lambda v: round(v, 9) if isinstance(v, float) else v
    bag = lambda rs: collections.Counter(tuple(map(round_, r)) for r in rs)
    assert bag(rows.select(columns).collect()) == bag(want.select(*columns).fetchall())


def test_stream(spark):
    rows = QUERIES["stream_gate"](spark, SF)
    assert rows.exceptAll(QUERIES["cooldown_gate"](spark, SF).select(rows.columns)).count() == 0 and rows.count() > 0
