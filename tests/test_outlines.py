import random

import pytest
from pyspark.sql import functions as F

from talusgrid.operators import outlines, polygons
from talusgrid.sources import tables

SCHEMA = "k int, g int, rings array<array<struct<x:double,y:double>>>"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def valid(spark, shapes):
    df = spark.createDataFrame([(k, 0, s) for k, s in shapes.items()], SCHEMA)
    found = outlines.make_valid(df, "k").select("k", "rings", outlines.area().alias("a"), outlines.polygon_uuid().alias("u")).collect()
    return {r["k"]: (None if r["rings"] is None else [[tuple(p) for p in ring] for ring in r["rings"]], r["a"], r["u"]) for r in found}


def test_the_same_area_has_one_form(spark):
    square = box(0.0, 0.0, 4.0, 4.0)
    hole = box(1.0, 1.0, 2.0, 2.0)
    got = valid(
        spark,
        {
            0: [square], 1: [square[::-1]], 2: [square[2:] + square[:2]], 3: [square + square[:1]],
            4: [[(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 1.0)]],  # points on straight lines
            5: [box(0.0, 0.0, 2.0, 4.0), box(2.0, 0.0, 2.0, 4.0)],  # two halves
            6: [square, hole], 7: [hole[::-1], square[1:] + square[:1]],
            8: [square, [(9.0, 9.0)]], 9: [square, [(4.0, 4.0), (7.0, 7.0)]],  # a point and a spike cover nothing
            10: None, 11: [], 12: [[(1.0, 1.0), (2.0, 2.0)]], 13: [square, square],
        },
    )
    assert got[0][0] == [square] and got[0][1] == 16
    assert len({got[k][2] for k in (0, 1, 2, 3, 4, 5, 8, 9)}) == 1
    assert got[6] == got[7] and got[6][1] == 12 and got[6][0] == [square, [hole[0], hole[3], hole[2], hole[1]]]
    assert got[6][2] != got[0][2]
    assert all(got[k] == (None, None, None) for k in (10, 11, 12, 13))


def test_rings_that_cross_themselves(spark):
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
    star = [(0.0, 3.0), (6.0, 3.0), (1.0, 0.0), (3.0, 5.0), (5.0, 0.0)]
    eight = box(0.0, 0.0, 2.0, 2.0)
    corner = box(2.0, 2.0, 2.0, 2.0)
    got = valid(spark, {0: [bow], 1: [star], 2: [eight, corner], 3: [eight + [(0.0, 0.0)] + box(0.0, 0.0, 1.0, 1.0)]})
    assert got[0][0] == [[(0.0, 0.0), (2.0, 2.0), (0.0, 4.0)], [(2.0, 2.0), (4.0, 0.0), (4.0, 4.0)]] and got[0][1] == 8
    assert len(got[1][0]) == 5 and all(len(r) == 3 for r in got[1][0])  # the middle is crossed twice: outside
    assert got[2][0] == [eight, corner]  # a shared corner doesn't join them
    assert got[3][1] == 3


def covered(rings, x, y):
    n = 0
    for ring in rings or []:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            n += (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) <= x
    return n % 2 == 1


@pytest.mark.parametrize("whole", [False, True])
def test_random_shapes_point_by_point(spark, whole):
    """Valid forms and unions hold the points that the shapes hold; whole numbers make many shared edges and corners."""
    rnd = random.Random(8)
    number = (lambda: float(rnd.randint(0, 8))) if whole else (lambda: rnd.uniform(0, 9))
    shapes = {k: [[(number(), number()) for _ in range(rnd.randint(3, 7))] for _ in range(rnd.randint(1, 2))] for k in range(12)}
    df = spark.createDataFrame([(k, k % 3, s) for k, s in shapes.items()], SCHEMA).repartition(3)
    one = {r["k"]: r["rings"] for r in outlines.make_valid(df, "k", cell=3.0).collect()}
    union = {r["g"]: r["rings"] for r in outlines.dissolve(df, "g", "k", cell=3.0).collect()}
    assert len(one) == 12 and len(union) == 3
    spots = [(rnd.uniform(-1, 10), rnd.uniform(-1, 10)) for _ in range(400)]
    for k, s in shapes.items():
        found = [[tuple(p) for p in ring] for ring in one[k] or []]
        assert all(covered(found, *p) == covered(s, *p) for p in spots), k
    for g, rings in union.items():
        found = [[tuple(p) for p in ring] for ring in rings or []]
        held = [s for k, s in shapes.items() if k % 3 == g]
        assert all(covered(found, *p) == any(covered(s, *p) for s in held) for p in spots), g


def test_dissolve_cancels_shared_edges(spark):
    rows = [(1, 7, [box(0.0, 0.0, 2.0, 2.0)]), (2, 7, [box(2.0, 0.0, 2.0, 2.0)]), (3, 7, [box(1.0, 1.0, 2.0, 3.0)]), (4, None, [box(0.0, 0.0, 1.0, 1.0)])]
    got = {r["g"]: (r["rings"], r["a"]) for r in outlines.dissolve(spark.createDataFrame(rows, SCHEMA), "g", "k").withColumn("a", outlines.area()).collect()}
    assert [tuple(p) for p in got[7][0][0]] == [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 4.0), (1.0, 2.0), (0.0, 2.0)]
    assert got[7][1] == 12 and got[None][1] == 1
    assert outlines.dissolve(spark.createDataFrame([], SCHEMA), "g", "k").collect() == []


def test_near_lines_and_bounds(spark):
    rows = [(1, 0, [[(2.0, 3.0), (90.0, 60.0)], [(5.0, 50.0), (5.0, 50.5)]]), (2, 0, []), (3, 0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["row"], r["col"]) for r in polygons.near(df, "k", 70, 100, 3.5, closed=False).collect()}

    def away(x, y, a, b):
        ux, uy = b[0] - a[0], b[1] - a[1]
        t = min(max(((x - a[0]) * ux + (y - a[1]) * uy) / (ux * ux + uy * uy), 0), 1)
        return (x - a[0] - t * ux) ** 2 + (y - a[1] - t * uy) ** 2

    lines = rows[0][2]
    assert got == {(r, c) for r in range(70) for c in range(100) if min(away(c + 0.5, r + 0.5, *line) for line in lines) <= 3.5**2}
    assert [tuple(r) for r in polygons.boxes(df, "k").collect()] == [(1, 2.0, 90.0, 3.0, 60.0)]
    assert polygons.edges(df, "k", closed=False).count() == 2 and df.select(F.col("k")).count() == 3


@pytest.fixture
def steps(monkeypatch):
    """Rows, plan and name of each table that a call writes on its way."""
    found, kept = [], outlines.kept

    def spied(df, name, *rest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        made = kept(df, name, *rest)
        found.append((name, made.count(), plan))
        return made

    monkeypatch.setattr(outlines, "kept", spied)
    return found


def test_shapes_drawn_alike_are_made_valid_once(spark, steps, tmp_path, monkeypatch):
    names = iter(range(1000))
    monkeypatch.setattr(tables, "shared_path", lambda _, name: f"file://{tmp_path}/{name}-{next(names)}")
    drawings = [[box(0.0, 0.0, 3.0, 2.0)], [box(0.0, 0.0, 3.0, 2.0)[::-1]], [box(0.0, 0.0, 3.0, 2.0), box(1.0, 1.0, 1.0, 0.5)]]
    rows = [(k, 0, drawings[k % 3]) for k in range(300)] + [(300, 0, None), (301, 0, drawings[0][:1]), (301, 0, [box(1.0, 1.0, 1.0, 0.5)])]
    got = {r["k"]: r["a"] for r in outlines.make_valid(spark.createDataFrame(rows, SCHEMA), "k").select("k", outlines.area().alias("a")).collect()}
    assert got == {k: 5.5 if k % 3 == 2 else 6.0 for k in range(300)} | {300: None, 301: 5.5}
    assert next(n for name, n, _ in steps if name == "sides") == 4 + 4 + 8 + 8
    # what the steps wrote is gone
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert not left & {"sides", "placed", "pieces", "borders", "traced"}


def test_deep_overlaps_are_not_split_against_each_other(spark, steps):
    rnd = random.Random(4)
    shapes = {k: [box(rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.uniform(4, 8), rnd.uniform(4, 8))] for k in range(400)}
    df = spark.createDataFrame([(k, 1, s) for k, s in shapes.items()], SCHEMA)
    rings = [[tuple(p) for p in ring] for ring in outlines.dissolve(df, "g", "k").first()["rings"]]
    assert all(
        covered(rings, x, y) == any(covered(s, x, y) for s in shapes.values()) for x, y in ((rnd.uniform(-1, 29), rnd.uniform(-1, 29)) for _ in range(1500))
    )
    # splitting all of them against each other makes some 40,000 pieces
    assert next(n for name, n, _ in steps if name == "pieces") < 4 * 1600
    # a broadcast sends a step's table to the driver
    made = {"placed", "filled", "open", "pieces", "borders", "traced", "united"}
    assert made <= {name for name, _, _ in steps} and not any("Broadcast" in plan for name, _, plan in steps if name in made)


def test_narrow_shapes_are_left_out_by_small_cells(spark, steps):
    """Cells of a part of the mean edge don't fit within any of them."""
    rnd = random.Random(5)
    shapes = []
    for k in range(500):
        x, y = rnd.uniform(0, 6), rnd.uniform(0, 6)
        shapes.append([box(x, y, 4.0, 0.5) if k % 2 else box(x, y, 0.5, 4.0)])
    rings = outlines.dissolve(spark.createDataFrame([(k, 1, s) for k, s in enumerate(shapes)], SCHEMA), "g", "k").first()["rings"]
    rings = [[tuple(p) for p in ring] for ring in rings]
    assert all(covered(rings, x, y) == any(covered(s, x, y) for s in shapes) for x, y in ((rnd.uniform(-1, 11), rnd.uniform(-1, 11)) for _ in range(300)))
    # splitting all of them against each other made 145,356 pieces
    assert next(n for name, n, _ in steps if name == "pieces") < 3000


def test_what_lies_deep_within_a_large_shape(spark, monkeypatch):
    monkeypatch.setattr(outlines, "TILES", 4)
    rows = [(0, 1, [box(0.0, 0.0, 40.0, 40.0), box(30.0, 30.0, 4.0, 4.0)]), (1, 1, [box(10.0, 10.0, 1.0, 1.0)]), (2, 1, [box(31.0, 31.0, 1.0, 1.0)])]
    got = outlines.dissolve(spark.createDataFrame(rows, SCHEMA), "g", "k", cell=2.0).select("rings", outlines.area().alias("a")).first()
    assert got["a"] == 40 * 40 - 4 * 4 + 1 and len(got["rings"]) == 3


def test_pixels_on_the_border_of_a_union(spark):
    """Corners of halves put many centres on edges; corners of the union are thirds, fifths and so on, rounded."""
    rnd = random.Random(3)
    shapes = {k: [[(rnd.randint(0, 40) / 2, rnd.randint(0, 24) / 2) for _ in range(3)]] for k in range(24)}
    group = lambda k: None if k % 4 == 3 else k % 4
    df = spark.createDataFrame([(k, group(k), s) for k, s in shapes.items()], SCHEMA)
    want = {(group(k), r, c) for k, s in shapes.items() for r in range(12) for c in range(20) if covered(s, c + 0.5, r + 0.5)}
    got = [tuple(r) for r in outlines.dissolved_cover(df, "g", "k", 12, 20).select("g", "row", "col").collect()]
    assert set(got) == want and len(got) == len(want)


def test_buffers_are_dealt_over_tasks(spark, monkeypatch):
    """Tasks grow in number with the edges, however few files the shapes are in."""
    monkeypatch.setattr(polygons, "SHARE", 10)
    df = spark.createDataFrame([(k, 0, [box(k % 7 + 0.2, k % 5 + 0.3, 3.0, 2.0)]) for k in range(60)], SCHEMA).coalesce(1)
    found = polygons.within(df, "k", 12, 14, 1.5)
    assert found.rdd.getNumPartitions() >= 24
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and {k for k, _, _ in got} == set(range(60))
