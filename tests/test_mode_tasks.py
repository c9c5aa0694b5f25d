"""Modes per key are counted where the key lies, in tasks of a bounded number of rows; busy keys in all tasks."""

import random

import pytest

from offerloom.operators import aggregate

COLUMNS = ["n", "s", "x"]


def table(frame, busy=0):
    draw = random.Random(4)
    keys = [None, *range(30)]
    rows = [(draw.choice(keys), draw.choice([None, 1, 2]), draw.choice([None, "a", "b"]), draw.choice([0.5, 1.5])) for _ in range(900)]
    rows += [(7, draw.choice([3, 4]), "c", None) for _ in range(busy)]
    return rows, frame(rows, "k int, n int, s string, x double")


def expected(rows):
    found = {}
    for k in {r[0] for r in rows} - {None}:
        of_key = []
        for i in range(1, 4):
            values = [r[i] for r in rows if r[0] == k and r[i] is not None]
            of_key.append(min(set(values), key=lambda v: (-values.count(v), v)) if values else None)
        found[k] = tuple(of_key)
    return found


def answers(df):
    return {r["k"]: (r["n"], r["s"], r["x"]) for r in df.collect()}


@pytest.mark.parametrize("busy", [0, 400])
def test_modes_in_small_tasks(frame, busy):
    rows, df = table(frame, busy)
    found = aggregate._modes_of_staged(df.where("k is not null").cache(), "k", COLUMNS, rows_per_task=100)
    assert answers(found) == expected(rows)


def test_rows_are_shuffled_once_however_many_columns(frame):
    _, df = table(frame)
    plan = aggregate.modes_by_key(df, "k", COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_long_table_is_dealt_to_more_tasks(frame):
    _, df = table(frame)
    found = aggregate._modes_of_staged(df.where("k is not null").cache(), "k", COLUMNS, rows_per_task=50)
    assert found.rdd.getNumPartitions() >= 870 // 50
