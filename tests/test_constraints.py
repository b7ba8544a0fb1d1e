"""Constraints: the report and the watched write, on planted violations."""

import os

import pytest

from talusgrid.operators import constraints as c

A, B = [(0.0, 0.0), (1.0, 2.0)], [(5.0, 5.0), (6.0, 6.5), (7.0, 7.0)]
ROWS = [
    (1, "k1", '["a"]', [A]), (2, "k1", "[]", [A[::-1]]), (3, "k2", "{}", [A]), (4, "k2", "[1", [B]), (5, None, None, None),
    (6, None, "[1]", []), (7, "k3", "[]", [A, [(0.0, 0.0)]]), (8, "k4", "[]", [[(0.0, float("nan")), (1.0, 1.0)]]), (9, "k5", "", [B, A]), (10, "k5", "[]", [A, B[::-1]]),
]
KIND = "id int, key string, events string, parts array<array<struct<x:double,y:double>>>"


def rules():
    return {"key": c.present("key"), "lines": c.lines("parts"), "events": c.json_list("events")}


def test_report(spark):
    df = spark.createDataFrame(ROWS, KIND).repartition(3)
    got = {r.rule: (r.n_rows, r.first_row) for r in c.violations(df, rules(), "id", ("key", "id"), {"key": "parts"}).collect()}
    assert got == {
        "key": (2, 5), "lines": (4, 5), "events": (4, 3), "unique key": (6, 1), "unique id": (0, None), "one shape key": (2, 3),
    }
    none = {r.rule: (r.n_rows, r.first_row) for r in c.violations(df.limit(0), {}, "id", ("key",), {"key": "parts"}).collect()}
    assert none == {"unique key": (0, None), "one shape key": (0, None)}
    with pytest.raises(ValueError):
        c.violations(df, {}, "id")


def test_watched_write(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND).repartition(3)
    with pytest.raises(ValueError) as e:
        c.write_checked(df, f"{tmp_path}/bad", rules(), "id")
    assert str(e.value) == "key: 2 rows, first 5; lines: 4 rows, first 5; events: 4 rows, first 3"
    assert not os.path.exists(f"{tmp_path}/bad")
    good = c.write_checked(df.where("id in (1, 2)"), f"{tmp_path}/good", rules(), "id")
    assert sorted(r.id for r in good.collect()) == [1, 2] and good.schema == df.schema
    assert c.write_checked(df.limit(0), f"{tmp_path}/none", rules(), "id").count() == 0
