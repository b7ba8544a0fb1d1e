"""Named queries over the test tables and the SQL that must give the same rows.

Orders serve as a raster: keys are dense, so ``key div 100`` and ``key % 100``
make a complete grid of 100 columns whose height is the total price; urgent
orders with keys divisible by 97 count as missing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talusgrid.functions import geodesy, projection
from talusgrid.operators import constraints, events, features, grid, model, neighbourhood, polygons, ranking, raster, sampling, scoring
from talusgrid.operators import outlines as areas
from talusgrid.sources import cube, geopackage, geotiff, tables

WIDTH = 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 97 == 0)
    return read(spark, sf_dir, "orders").select(
        F.expr("int(o_orderkey div 100)").alias("row"),
        (F.col("o_orderkey") % WIDTH).cast("int").alias("col"),
        F.when(~missing, F.col("o_totalprice")).alias("z"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("fold"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 61 == 0)).alias("label"),
    )


def height(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "orders").count() // WIDTH


GRID = """g AS (SELECT (o_orderkey // 100)::INT AS "row", (o_orderkey % 100)::INT AS col,
  CASE WHEN NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0) THEN o_totalprice END AS z,
  (o_custkey % 5 + 1)::INT AS fold, o_orderstatus = 'F' AND o_orderkey % 61 = 0 AS label FROM orders),
h AS (SELECT max("row") + 1 AS height FROM g)"""


# events and lists -----------------------------------------------------------


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'P')")
def prefix_filter(spark, sf_dir):
    return events.with_prefix(read(spark, sf_dir, "part"), "p_type", "P").select("p_partkey", "p_type")


_CELL = (
    "CASE l_linenumber % 3 WHEN 0 THEN concat(' ', l_returnflag, ';', l_partkey % 7, ' ; ') "
    "WHEN 1 THEN 'nan' ELSE concat(l_partkey % 5, ';;', l_suppkey % 3) END"
)


@query(
    f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CELL} AS cell,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
w AS (SELECT l_orderkey, (k - 1) % 5 AS i, string_agg(cell, ';' ORDER BY k) AS cell FROM c GROUP BY 1, 2),
e AS (SELECT l_orderkey, i, unnest(string_split(cell, ';')) AS x, generate_subscripts(string_split(cell, ';'), 1) AS j
  FROM w WHERE cell NOT IN ('', 'nan', 'None')),
d AS (SELECT l_orderkey, trim(x) AS x, min(i * 1000000000 + j) AS p FROM e WHERE trim(x) <> '' GROUP BY 1, 2),
s AS (SELECT l_orderkey, string_agg(x, ',' ORDER BY p) AS events, count(*)::BIGINT AS n FROM d GROUP BY 1)
SELECT o.l_orderkey, coalesce(events, '') AS events, coalesce(n, 0)::BIGINT AS n
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN s USING (l_orderkey)"""
)
def combine_event_columns(spark, sf_dir):
    """An order's rows, in order, dealt over five cells."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*order, F.expr(_CELL).alias("cell")))).alias("c"))

    def cell(i: int):
        return F.array_join(F.transform(F.filter("c", lambda x, k: k % 5 == i), lambda x: x["cell"]), ";")

    wide = rows.select("l_orderkey", *[cell(i).alias(f"event_{i + 1}") for i in range(5)])
    found = F.array_distinct(events.combine_events(*[f"event_{i}" for i in range(1, 6)]))
    return wide.select("l_orderkey", F.array_join(found, ",").alias("events"), F.size(found).cast("long").alias("n"))


@query("""
WITH m AS (SELECT DISTINCT o_orderkey, unnest([o_custkey, o_custkey, o_orderkey % 50]) AS c_custkey FROM orders)
SELECT c.c_custkey, count(m.o_orderkey)::BIGINT AS n_geometries, min(m.o_orderkey) AS first_geometry
FROM customer c LEFT JOIN m USING (c_custkey) GROUP BY 1""")
def list_membership_join(spark, sf_dir):
    lists = F.array("o_custkey", "o_custkey", F.col("o_orderkey") % 50)
    geoms = read(spark, sf_dir, "orders").select("o_orderkey", lists.alias("events"))
    people = read(spark, sf_dir, "customer").select("c_custkey")
    return events.events_with_geometries(people, geoms, "c_custkey", "o_orderkey", "events")


_ROW = "l_orderkey * 1000000 + l_linenumber * 10000 + l_suppkey"


_EVENTS = "l_returnflag || (l_suppkey % 7), l_linestatus || (l_linenumber % 3), l_returnflag || (l_suppkey % 2)"


@query(f"""
WITH e AS (SELECT l_partkey, ev, row_number() OVER (PARTITION BY l_partkey ORDER BY {_ROW}, ev) AS k FROM (SELECT *, [{_EVENTS}] AS ev FROM lineitem)),
x AS (SELECT l_partkey, k, unnest(ev) AS e, generate_subscripts(ev, 1) AS j FROM e),
d AS (SELECT l_partkey, e, min(k * 10 + j) AS p FROM x GROUP BY 1, 2),
o AS (SELECT l_partkey, string_agg(e, ',' ORDER BY p) AS events FROM d GROUP BY 1),
s AS (SELECT l_partkey, count(DISTINCT list_sort(list_distinct(ev))) = 1 AS identical, count(*)::BIGINT AS n_rows FROM e GROUP BY 1)
SELECT l_partkey, n_rows, identical, events FROM s JOIN o USING (l_partkey)""")
def merge_duplicates(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.expr(_ROW).alias("r"), F.expr(f"array({_EVENTS})").alias("ev"))
    return events.merge_duplicates(rows, "l_partkey", "ev", "r").select(
        "l_partkey", "n_rows", "identical", F.array_join("ev", ",").alias("events")
    )


@query("""WITH e AS (SELECT o_custkey // 3 AS k, list_sort([o_orderstatus, substr(o_orderpriority, 1, 1)]) AS ev FROM orders)
SELECT k, count(*)::BIGINT AS n_rows, count(DISTINCT list_distinct(ev)) = 1 AS identical FROM e GROUP BY 1 HAVING count(*) > 1""")
def duplicate_report(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.expr("o_custkey div 3").alias("k"), F.expr("array(o_orderstatus, substr(o_orderpriority, 1, 1))").alias("ev"))
    return events.duplicate_report(rows, "k", "ev")


#: Lines of orders: the same ones again and again, drawn either way and in either order.
_P = "o_custkey % 40"
_LINES = (
    "[[{'x': P + 0.5, 'y': P % 7 + 0.25}, {'x': P % 5 + 20.5, 'y': P + 1.5}], [{'x': P % 3 + 0.5, 'y': 2.5}, {'x': P + 9.5, 'y': 0.5}, {'x': 1.5, 'y': P + 3.5}]]"
).replace("P", f"({_P})")
_GEOMS = f"""l AS (SELECT *, {_LINES} AS pair FROM orders),
t AS (SELECT *, CASE WHEN {_P} % 4 = 0 THEN pair[1:1] WHEN o_orderkey % 2 = 0 THEN [pair[2], list_reverse(pair[1])] ELSE pair END AS parts FROM l)"""


def lines(spark, sf_dir):
    point = lambda x, y: f"struct(double({x}) AS x, double({y}) AS y)"
    one = f"array({point(f'{_P} + 0.5', f'{_P} % 7 + 0.25')}, {point(f'{_P} % 5 + 20.5', f'{_P} + 1.5')})"
    two = f"array({point(f'{_P} % 3 + 0.5', 2.5)}, {point(f'{_P} + 9.5', 0.5)}, {point(1.5, f'{_P} + 3.5')})"
    parts = f"CASE WHEN {_P} % 4 = 0 THEN array({one}) WHEN o_orderkey % 2 = 0 THEN array({two}, reverse({one})) ELSE array({one}, {two}) END"
    return read(spark, sf_dir, "orders").withColumn("parts", F.expr(parts))


_CANON = "list_sort(list_transform(parts, lambda p: CASE WHEN p <= list_reverse(p) THEN p ELSE list_reverse(p) END))"


@query(f"""WITH {_GEOMS} SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY {_CANON}) AS first_alike FROM t""")
def geometry_uuid_lines(spark, sf_dir):
    rows = lines(spark, sf_dir).select("o_orderkey", events.geometry_uuid(F.col("parts")).alias("u"))
    heads = rows.groupBy("u").agg(F.min("o_orderkey").alias("first_alike"))
    return rows.join(heads, "u").select("o_orderkey", "first_alike")


@query(f"""WITH {_GEOMS},
e AS (SELECT o_orderkey, parts, {_CANON} AS g, list_filter([o_orderstatus, trim(substr(o_orderpriority, 3)), 'c' || (o_custkey % 3)], lambda x: x <> '') AS ev FROM t),
x AS (SELECT g, o_orderkey, unnest(ev) AS e, generate_subscripts(ev, 1) AS j FROM e),
d AS (SELECT g, e, min(o_orderkey * 10 + j) AS p FROM x GROUP BY 1, 2),
o AS (SELECT g, string_agg(e, ',' ORDER BY p) AS events FROM d GROUP BY 1),
s AS (SELECT g, count(*)::BIGINT AS n_rows, min_by(parts, o_orderkey) AS geometry FROM e GROUP BY 1)
SELECT events, n_rows, len(geometry)::INT AS n_lines, geometry[1][1].x AS x FROM s JOIN o USING (g)""")
def preprocess_geometries(spark, sf_dir):
    rows = lines(spark, sf_dir).select(
        "o_orderkey", "parts", F.concat("o_orderstatus", F.lit(" ;; "), F.substring("o_orderpriority", 3, 99)).alias("event_1"),
        F.lit("nan").alias("event_2"), F.concat(F.lit(" c"), F.col("o_custkey") % 3).alias("event_3"),
    )
    got = events.preprocess_geometries(rows, ["event_1", "event_2", "event_3"], "parts", "o_orderkey")
    return got.select(F.array_join("events", ",").alias("events"), "n_rows", F.size("geometry").alias("n_lines"), F.col("geometry")[0][0]["x"].alias("x"))


_LISTS = "o_custkey, o_custkey, o_orderkey % 50"
_APPENDED = f"""{_GEOMS}, m AS (SELECT DISTINCT o_orderkey, parts, unnest([{_LISTS}]) AS c_custkey FROM t),
n AS (SELECT c_custkey, count(*)::BIGINT AS n, sum(len(parts))::INT AS n_lines, sum(list_sum(list_transform(parts, lambda p: len(p))))::INT AS n_points,
  min_by(parts, o_orderkey)[1][1].x AS x FROM m GROUP BY 1),
a AS (SELECT c.c_custkey, coalesce(n, 0)::BIGINT AS n_geometries, CASE WHEN n_lines = 1 THEN 'LineString' WHEN n_lines > 1 THEN 'MultiLineString' END AS geometry_type, n_points, x
  FROM customer c LEFT JOIN n USING (c_custkey))"""


def _appended(spark, sf_dir):
    geoms = lines(spark, sf_dir).select("o_orderkey", "parts", F.expr(f"array({_LISTS})").alias("events"))
    return events.append_geometries(read(spark, sf_dir, "customer").select("c_custkey"), geoms, "c_custkey", "o_orderkey", "events", "parts")


@query(f"WITH {_APPENDED} SELECT * FROM a")
def append_geometries(spark, sf_dir):
    points = F.aggregate("geometry", F.lit(0), lambda n, line: n + F.size(line))
    return _appended(spark, sf_dir).select("c_custkey", "n_geometries", "geometry_type", points.alias("n_points"), F.col("geometry")[0][0]["x"].alias("x"))


@query(f"""WITH {_APPENDED} SELECT count(*)::BIGINT AS n_events, count(*) FILTER (n_geometries = 0)::BIGINT AS without, count(*) FILTER (n_geometries = 1)::BIGINT AS with_one,
count(*) FILTER (n_geometries >= 2)::BIGINT AS with_more, max(n_geometries)::BIGINT AS most FROM a""")
def geometry_statistics(spark, sf_dir):
    return events.geometry_statistics(_appended(spark, sf_dir))


@query("""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT c_custkey, sha1(c_name) AS h FROM customer)""")
def geometry_hash_uuid(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", events.hash_uuid(F.sha1("c_name")).alias("uuid"))


@query("SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def json_roundtrip(spark, sf_dir):
    text = F.to_json(F.array_sort(F.collect_list("l_returnflag")))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text.alias("j"))
    return rows.select("l_orderkey", F.array_join(F.from_json("j", "array<string>"), ",").alias("flags"))


@query("""SELECT o_orderstatus, count(*)::BIGINT AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1""")
def value_counts_pct(spark, sf_dir):
    got = events.value_counts(read(spark, sf_dir, "orders"), "o_orderstatus")
    return got.withColumn("pct", F.round("pct", 6))


@query("""SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey)::BIGINT AS n_distinct FROM orders
UNION ALL SELECT 'customer', count(DISTINCT CASE WHEN o_custkey % 7 > 0 THEN o_custkey END) FROM orders
UNION ALL SELECT 'nothing', 0
UNION ALL SELECT 'keys', count(DISTINCT k) FROM (SELECT o_custkey % 50 AS k FROM orders UNION ALL SELECT o_orderkey % 300 FROM orders WHERE o_orderkey % 3 = 0)""")
def distinct_counts(spark, sf_dir):
    customer, key = F.col("o_custkey"), F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(customer % 7 > 0, customer).alias("customer"), F.lit(None).cast("string").alias("nothing"),
        F.array(customer % 50, F.when(key % 3 == 0, key % 300)).alias("keys"),
    )
    return events.distinct_counts(rows, ["o_orderkey", "customer", "nothing"], ["keys"])


# rasters --------------------------------------------------------------------


@query(f"""WITH {GRID}, i AS (SELECT (l_orderkey // 100)::INT AS "row", (l_orderkey % 100)::INT AS col, sum(l_quantity) * 10.5 AS ice FROM lineitem GROUP BY 1, 2)
SELECT "row", col, CASE WHEN z IS NULL THEN 65535 ELSE greatest(least(round_even(z - coalesce(ice, 0), 0), 65534), 0) END::INT AS z FROM g LEFT JOIN i USING ("row", col)""")
def raster_subtract_quantise(spark, sf_dir):
    ice = read(spark, sf_dir, "lineitem").groupBy(
        F.expr("int(l_orderkey div 100)").alias("row"), (F.col("l_orderkey") % 100).cast("int").alias("col")
    ).agg((F.sum("l_quantity") * 10.5).alias("ice"))
    return raster.quantise(raster.subtract(lift(spark, sf_dir), ice))


@query(f"""WITH {GRID}, s AS (SELECT "row" // 3 AS "row", col // 3 AS col, CASE WHEN count(z) = count(*) THEN max(z) END AS v FROM g GROUP BY 1, 2)
SELECT g."row", g.col, round(s.v, 6) AS v FROM g LEFT JOIN s ON s."row" = g."row" // 3 AND s.col = g.col // 3""")
def resample_nearest(spark, sf_dir):
    g = lift(spark, sf_dir)
    coarse = g.groupBy(F.expr("int(row div 3)").alias("row"), F.expr("int(col div 3)").alias("col")).agg(
        F.when(F.count("z") == F.count("*"), F.max("z")).alias("v")  # missing where any of its pixels is
    )
    return raster.resample_nearest(g.select("row", "col"), coarse, 3.0, "v").withColumn("v", F.round("v", 6))


@query(f"""WITH {GRID} SELECT g."row", g.col, round(s.z, 6) AS v FROM g LEFT JOIN g s ON s."row" = g."row" // 3 AND s.col = g.col // 3""")
def resample_nearest_whole(spark, sf_dir):
    g = lift(spark, sf_dir)
    source = g.select("row", "col", F.col("z").alias("v"))
    return raster.resample_nearest(g.select("row", "col"), source, 3.0, "v").withColumn("v", F.round("v", 6))


def shapes(spark, sf_dir):
    key = F.col("s_suppkey")
    x, y = key * 37 % 97, key * 53 % 140
    return read(spark, sf_dir, "supplier").select(
        key.alias("k"), (x + 0.25).alias("x0"), (x + 2.5 + key % 9).alias("x1"), y.cast("double").alias("y0"),
        (y + 1.75 + key % 7).alias("y1"), F.when(key % 11 != 0, (key % 5 + 1).cast("int")).alias("fold"),
    )


SHAPES = """s AS (SELECT s_suppkey AS k, s_suppkey * 37 % 97 + 0.25::DOUBLE AS x0, s_suppkey * 37 % 97 + 2.5::DOUBLE + s_suppkey % 9 AS x1,
  (s_suppkey * 53 % 140)::DOUBLE AS y0, s_suppkey * 53 % 140 + 1.75::DOUBLE + s_suppkey % 7 AS y1,
  CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey % 5 + 1)::INT END AS fold FROM supplier)"""


@query(f"""WITH {GRID}, {SHAPES} SELECT "row", col, round(z, 6) AS z FROM g WHERE EXISTS (SELECT 1 FROM s
WHERE g.col + 0.5 BETWEEN x0 - 1.5 AND x1 + 1.5 AND g."row" + 0.5 BETWEEN y0 - 1.5 AND y1 + 1.5)""")
def clip_rectangles(spark, sf_dir):
    return raster.clip(lift(spark, sf_dir), shapes(spark, sf_dir), 1.5).select("row", "col", F.round("z", 6).alias("z"))


@query(f"""WITH {GRID}, {SHAPES} SELECT "row", col, coalesce((SELECT max_by(fold, k) FROM s WHERE fold IS NOT NULL
AND g.col + 1 >= x0 AND g.col <= x1 AND g."row" + 1 >= y0 AND g."row" <= y1), -1)::INT AS fold FROM g""")
def rasterize_fold(spark, sf_dir):
    return raster.rasterise(lift(spark, sf_dir), shapes(spark, sf_dir).where("fold is not null"), "fold", "k")


@query(f"""WITH {GRID}, {SHAPES}, t AS (SELECT g.*, EXISTS (SELECT 1 FROM s WHERE fold IS NOT NULL AND g.col + 1 >= x0 AND g.col <= x1 AND g."row" + 1 >= y0 AND g."row" <= y1) AS f,
EXISTS (SELECT 1 FROM s WHERE fold IS NULL AND g.col + 1 >= x0 AND g.col <= x1 AND g."row" + 1 >= y0 AND g."row" <= y1) AS r FROM g)
SELECT "row", col, (CASE WHEN NOT f THEN -1 WHEN r THEN 1 ELSE 0 END)::INT AS label FROM t""")
def rasterize_labels(spark, sf_dir):
    g, s = lift(spark, sf_dir), shapes(spark, sf_dir)
    folds = raster.rasterise(g, s.where("fold is not null"), "fold", "k")
    release = raster.rasterise(g, s.where("fold is null").withColumn("hit", F.lit(1)), "hit", "k", fill=0)
    label = F.when(F.col("fold") == -1, -1).otherwise(F.col("hit"))
    return folds.join(release, ["row", "col"]).select("row", "col", label.alias("label"))


@query(f"""WITH {GRID}, {SHAPES} SELECT "row", col, CASE
WHEN EXISTS (SELECT 1 FROM s WHERE fold IS NULL AND col + 0.5 BETWEEN x0 AND x1 AND "row" + 0.5 BETWEEN y0 AND y1) THEN 3
WHEN EXISTS (SELECT 1 FROM s WHERE fold IS NULL AND pow(greatest(x0 - col - 0.5, col + 0.5 - x1, 0), 2) + pow(greatest(y0 - "row" - 0.5, "row" + 0.5 - y1, 0), 2) <= 4) THEN 2
WHEN z IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE fold IS NOT NULL AND col + 0.5 BETWEEN x0 AND x1 AND "row" + 0.5 BETWEEN y0 AND y1) THEN 1
ELSE 0 END AS label FROM g""")
def priority_labels(spark, sf_dir):
    s = shapes(spark, sf_dir)
    return raster.priority_labels(lift(spark, sf_dir), s.where("fold is not null"), s.where("fold is null"), 2.0)


#: Outlines with a bay each and, for some, a hole; some overlap, and each edge is drawn once.
_AT = "s_suppkey * 37 % 97", "s_suppkey * 53 % 140", "s_suppkey % 9 + 3", "s_suppkey % 7 + 4"
_OUTER = ((0.3, 0.1, 0, 0), (0.7, 1.4, 1, 0), (0.2, 0.4, 0.5, 0.5), (1.9, 0.6, 1, 1), (-0.9, 0.2, 0, 0.75))
_HOLE = ((0.45, 0.2, 0.25, 0.55), (0.45, 1.3, 0.25, 0.55), (1.15, 0.9, 0.25, 0.55))


def _ring(points, struct: str) -> str:
    x, y, a, b = _AT
    return ", ".join(struct.format(f"{x} + {p} + ({a}) * {r}", f"{y} + {q} + ({b}) * {s}") for p, q, r, s in points)


def outlines(spark, sf_dir):
    point = "named_struct('x', double({}), 'y', double({}))"
    outer, hole = f"array({_ring(_OUTER, point)})", f"array({_ring(_HOLE, point)})"
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 11 != 0, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("fold"),
        F.expr(f"CASE WHEN s_suppkey % 3 = 0 THEN array({outer}, {hole}) ELSE array({outer}) END").alias("rings"),
    )


_POINT = "{{'x': ({})::DOUBLE, 'y': ({})::DOUBLE}}"
OUTLINES = f"""s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey % 5 + 1)::INT END AS fold,
  CASE WHEN s_suppkey % 3 = 0 THEN [[{_ring(_OUTER, _POINT)}], [{_ring(_HOLE, _POINT)}]] ELSE [[{_ring(_OUTER, _POINT)}]] END AS rings FROM supplier),
r AS (SELECT k, fold, unnest(rings) AS ring FROM s), p AS (SELECT k, fold, ring, unnest(range(1, len(ring) + 1)) AS i FROM r),
e AS (SELECT k, fold, ring[i].x AS x1, ring[i].y AS y1, ring[i % len(ring) + 1].x AS x2, ring[i % len(ring) + 1].y AS y2 FROM p),
inside AS (SELECT g."row", g.col, k, e.fold FROM g JOIN e ON (y1 <= g."row" + 0.5) <> (y2 <= g."row" + 0.5)
  AND x1 + (g."row" + 0.5 - y1) * (x2 - x1) / (y2 - y1) <= g.col + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1),
t AS (SELECT g."row", g.col, e.*, least(greatest(((g.col + 0.5 - x1) * (x2 - x1) + (g."row" + 0.5 - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS t
  FROM g JOIN e ON g.col BETWEEN least(x1, x2) - 4 AND greatest(x1, x2) + 4 AND g."row" BETWEEN least(y1, y2) - 4 AND greatest(y1, y2) + 4),
near AS (SELECT DISTINCT "row", col, k, fold FROM t WHERE pow(col + 0.5 - (x1 + t * (x2 - x1)), 2) + pow("row" + 0.5 - (y1 + t * (y2 - y1)), 2) <= 4)"""


@query(f"""WITH {GRID}, {OUTLINES}, b AS (SELECT k, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x1, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS y1 FROM e GROUP BY 1)
SELECT "row", col, round(z, 6) AS z FROM g WHERE EXISTS (SELECT 1 FROM b WHERE g.col + 0.5 BETWEEN x0 - 1.5 AND x1 + 1.5 AND g."row" + 0.5 BETWEEN y0 - 1.5 AND y1 + 1.5)""")
def clip_outlines(spark, sf_dir):
    return polygons.clip(lift(spark, sf_dir), outlines(spark, sf_dir), "k", 1.5).select("row", "col", F.round("z", 6).alias("z"))


@query(f"""WITH {GRID}, {OUTLINES} SELECT k, "row", col FROM inside""")
def cover_outlines(spark, sf_dir):
    return polygons.cover(outlines(spark, sf_dir), "k", height(spark, sf_dir), WIDTH)


@query(f"""WITH {GRID}, {OUTLINES} SELECT k, "row", col FROM inside UNION SELECT k, "row", col FROM near""")
def buffer_outlines(spark, sf_dir):
    return polygons.within(outlines(spark, sf_dir), "k", height(spark, sf_dir), WIDTH, 2.0)


@query(f"""WITH {GRID}, {OUTLINES}, last AS (SELECT "row", col, max_by(fold, k) AS fold FROM inside WHERE fold IS NOT NULL GROUP BY 1, 2)
SELECT g."row", g.col, coalesce(last.fold, -1)::INT AS fold FROM g LEFT JOIN last USING ("row", col)""")
def burn_outlines(spark, sf_dir):
    held = outlines(spark, sf_dir).where("fold is not null")
    return polygons.burn(lift(spark, sf_dir), held, "k", "fold", "k", height(spark, sf_dir), WIDTH, touched=False)


@query(f"""WITH {GRID}, {OUTLINES}, m AS (
  SELECT "row", col, 3 AS m FROM inside WHERE fold IS NULL UNION ALL SELECT "row", col, 2 FROM near WHERE fold IS NULL
  UNION ALL SELECT "row", col, 1 FROM inside JOIN g USING ("row", col) WHERE inside.fold IS NOT NULL AND z IS NOT NULL)
SELECT g."row", g.col, coalesce(max(m), 0)::INT AS label FROM g LEFT JOIN m USING ("row", col) GROUP BY 1, 2""")
def priority_labels_outlines(spark, sf_dir):
    s = outlines(spark, sf_dir)
    return polygons.priority_labels(
        lift(spark, sf_dir), s.where("fold is not null"), s.where("fold is null"), "k", 2.0, height(spark, sf_dir), WIDTH
    )


@query(f"""WITH {GRID}, {OUTLINES} SELECT k, "row", col FROM inside""")
def valid_outlines(spark, sf_dir):
    """The pixels of outlines made valid are those of the outlines as drawn."""
    valid = areas.make_valid(outlines(spark, sf_dir), "k")
    return polygons.cover(valid, "k", height(spark, sf_dir), WIDTH)


@query(f"""WITH {GRID}, {OUTLINES} SELECT DISTINCT fold, "row", col FROM inside""")
def dissolve_outlines(spark, sf_dir):
    """The pixels of each fold's union, the outlines without a fold among them."""
    return areas.dissolved_cover(outlines(spark, sf_dir), "fold", "k", height(spark, sf_dir), WIDTH)


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey % 40) AS first_alike, ((o_custkey % 40) + 3) * 4.0::DOUBLE - 1 AS area FROM orders")
def polygon_uuid_outlines(spark, sf_dir):
    """Forty rectangles with a hole, drawn in many ways: either way round, from any corner, with points between."""
    w = "(o_custkey % 40 + 3)"
    point = lambda x, y: f"named_struct('x', double({x}), 'y', double({y}))"
    outer = f"array({point(0, 0)}, {point(f'{w} / 2', 0)}, {point(w, 0)}, {point(w, 4)}, {point(0, 4)})"
    hole = f"array({point(1, 1)}, {point(2, 1)}, {point(2, 2)}, {point(1, 2)})"
    turned = lambda ring, n: f"concat(slice({ring}, o_orderkey % {n} + 1, {n}), slice({ring}, 1, o_orderkey % {n}))"
    rings = f"array({turned(outer, 5)}, IF(o_orderkey % 2 = 0, reverse({turned(hole, 4)}), {turned(hole, 4)}))"
    drawn = read(spark, sf_dir, "orders").selectExpr("o_orderkey", f"IF(o_orderkey % 3 = 0, reverse({rings}), {rings}) AS rings")
    found = areas.make_valid(drawn, "o_orderkey").select("o_orderkey", areas.polygon_uuid().alias("u"), areas.area().alias("area"))
    heads = found.groupBy("u").agg(F.min("o_orderkey").alias("first_alike"))
    return found.join(heads, "u").select("o_orderkey", "first_alike", "area")


#: Where two rasters lie: corner and pixel size.
_HERE = {"x0": 1000.0, "y0": 5000.0, "dx": 10.0, "dy": 10.0}
_THERE = {"x0": 985.0, "y0": 5020.0, "dx": 25.0, "dy": 20.0}
_SOURCE = """CAST(floor((5020 - (5000 - ("row" + 0.5) * 10)) / 20) AS INT) AS sr, CAST(floor((1000 + (col + 0.5) * 10 - 985) / 25) AS INT) AS sc"""
_ICE = """i AS (SELECT (o_orderkey // 100)::INT AS "row", (o_orderkey % 100)::INT AS col, o_custkey % 701 * 11.5::DOUBLE AS ice FROM orders WHERE o_orderkey % 13 <> 0)"""


def ice(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").select(
        F.expr("int(o_orderkey div 100)").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), (F.col("o_custkey") % 701 * 11.5).alias("ice")
    )


@query(f"""WITH {GRID}, {_ICE}, p AS (SELECT "row", col, {_SOURCE} FROM g)
SELECT p."row", p.col, i.ice FROM p LEFT JOIN i ON i."row" = sr AND i.col = sc""")
def align_coordinates(spark, sf_dir):
    return raster.align(lift(spark, sf_dir).select("row", "col"), ice(spark, sf_dir), "ice", _HERE, _THERE)


_CHAIN = """c AS (SELECT p."row", p.col, z - coalesce(i.ice, 0) AS z FROM p LEFT JOIN i ON i."row" = sr AND i.col = sc
  WHERE EXISTS (SELECT 1 FROM s WHERE p.col + 0.5 BETWEEN x0 - 1.5 AND x1 + 1.5 AND p."row" + 0.5 BETWEEN y0 - 1.5 AND y1 + 1.5))
SELECT ("row" - min("row") OVER ())::INT AS "row", (col - min(col) OVER ())::INT AS col,
  CASE WHEN z IS NULL THEN 65535 ELSE greatest(least(round_even(z, 0), 65534), 0) END::INT AS z FROM c"""


@query(f"""WITH {GRID}, {SHAPES}, {_ICE}, p AS (SELECT "row", col, z, {_SOURCE} FROM g), {_CHAIN}""")
def bedrock(spark, sf_dir):
    return raster.bedrock(lift(spark, sf_dir).select("row", "col", "z"), ice(spark, sf_dir), shapes(spark, sf_dir), 1.5, _HERE, _THERE)


# terrain --------------------------------------------------------------------


#: A surface of gentler slopes than prices make.
RELIEF = GRID.replace("o_totalprice END AS z", "o_totalprice / 100000 END AS z")


def relief(spark, sf_dir):
    return lift(spark, sf_dir).select("row", "col", (F.col("z") / 100000).alias("z"))


def _blur(sigma: float, source: str = "g") -> str:
    """CTE ``b``: the grid smoothed by joining each pixel with its mirrored neighbours."""
    w = grid.weights(sigma)
    r = len(w) // 2
    rows = ", ".join(f"({k - r}, {x!r}::DOUBLE)" for k, x in enumerate(w))
    step = lambda axis, size, src, dst: f"""{dst} AS (SELECT a."row", a.col, CASE WHEN count(n.z) = {2 * r + 1} THEN sum(n.z * w.w) END AS z
  FROM {src} a CROSS JOIN w CROSS JOIN h JOIN {src} n ON n.{"col" if axis == '"row"' else '"row"'} = a.{"col" if axis == '"row"' else '"row"'}
  AND n.{axis} = least((a.{axis} + w.d + 40 * {size}) % (2 * {size}), 2 * {size} - 1 - (a.{axis} + w.d + 40 * {size}) % (2 * {size}))
  GROUP BY 1, 2)"""  # noqa: E731
    return f"""w(d, w) AS (VALUES {rows}), {step('"row"', "h.height", source, "b0")}, {step("col", "100", "b0", "b")}"""


def _diff(value: str, axis: str, size: str) -> str:
    other = "col" if axis == '"row"' else '"row"'
    over = f"OVER (PARTITION BY {other} ORDER BY {axis})"
    after, before = f"lead({value}) {over}", f"lag({value}) {over}"
    return f"CASE WHEN {axis} = 0 THEN {after} - {value} WHEN {axis} = {size} - 1 THEN {value} - {before} ELSE ({after} - {before}) / 2 END"


_D = f"""d1 AS (SELECT *, {_diff("z", "col", "100")} AS p, {_diff("z", '"row"', "(SELECT height FROM h)")} AS q FROM b),
d2 AS (SELECT *, {_diff("p", "col", "100")} AS zxx, {_diff("q", '"row"', "(SELECT height FROM h)")} AS zyy,
  {_diff("p", '"row"', "(SELECT height FROM h)")} AS zxy, p * p + q * q AS gg FROM d1),
d3 AS (SELECT *, (zxx * (1 + q * q) - 2 * zxy * p * q + zyy * (1 + p * p)) / (2 * pow(1 + gg, 1.5)) AS hm, (zxx * zyy - zxy * zxy) / pow(1 + gg, 2) AS kk FROM d2)"""
_EXPR = {
    "slope": "degrees(atan(sqrt(gg)))",
    "profile_curvature": "(zxx * p * p + 2 * zxy * p * q + zyy * q * q) / nullif(pow(gg, 1.5), 0)",
    "planform_curvature": "(zxx * q * q - 2 * zxy * p * q + zyy * p * p) / nullif(sqrt(gg), 0)",
    "mean_curvature": "hm",
    "gaussian_curvature": "kk",
    "max_curvature": "hm + sqrt(CASE WHEN hm * hm - kk < 0 THEN 0 ELSE hm * hm - kk END)",
    "min_curvature": "hm - sqrt(CASE WHEN hm * hm - kk < 0 THEN 0 ELSE hm * hm - kk END)",
}


DIGITS = 6


def _terrain(attribute: str, sigma: float, sql: str) -> None:
    column = f"{attribute}_sigma{sigma:g}"

    def run(spark, sf_dir):
        got = grid.terrain(relief(spark, sf_dir), attribute, sigma, height(spark, sf_dir), WIDTH)
        return got.withColumn(column, F.round(column, DIGITS) + F.lit(0.0))  # no negative zero

    query(sql.format(column=column), f"{attribute}_s{sigma:g}")(run)


def _attribute_sql(attribute: str, sigma: float) -> str:
    if attribute == "elevation":
        return f'WITH {RELIEF}, {_blur(sigma)} SELECT "row", col, round(z, {DIGITS}) + 0.0::DOUBLE AS {{column}} FROM b'
    if attribute == "slope_break_index":
        return f"""WITH {RELIEF}, {_blur(sigma)}, {_D}, s AS (SELECT "row", col, {_EXPR["slope"]} AS s FROM d3),
e AS (SELECT "row", col, {_diff("s", "col", "100")} AS sx, {_diff("s", '"row"', "(SELECT height FROM h)")} AS sy FROM s)
SELECT "row", col, round(sqrt(sx * sx + sy * sy), {DIGITS}) + 0.0::DOUBLE AS {{column}} FROM e"""
    return f'WITH {RELIEF}, {_blur(sigma)}, {_D} SELECT "row", col, round({_EXPR[attribute]}, {DIGITS}) + 0.0::DOUBLE AS {{column}} FROM d3'


for _name in ("elevation", "slope_break_index", *_EXPR):
    _terrain(_name, 1, _attribute_sql(_name, 1))
for _name, _sigma in (("elevation", 3), ("elevation", 5), ("slope", 3), ("mean_curvature", 3), ("profile_curvature", 5)):
    _terrain(_name, _sigma, _attribute_sql(_name, _sigma))

_WANTED = {"slope": [1, 3], "slope_break_index": [1], "planform_curvature": [3]}
_WANTED_COLUMNS = [(a, s) for a, sigmas in _WANTED.items() for s in sigmas]


@query("SELECT * FROM " + " JOIN ".join(f"({_attribute_sql(a, s).format(column=f'{a}_sigma{s:g}')}) t{k}" + (' USING ("row", col)' if k else "") for k, (a, s) in enumerate(_WANTED_COLUMNS)))
def extract_features(spark, sf_dir):
    got = neighbourhood.attributes(relief(spark, sf_dir), _WANTED, height(spark, sf_dir), WIDTH)
    names = [f"{a}_sigma{s:g}" for a, s in _WANTED_COLUMNS]
    return got.select("row", "col", *[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) for c in names])


_FILLED = """gf AS (SELECT "row", col, coalesce(z, 0) AS z FROM g)"""


@query(f"""WITH {GRID}, {_FILLED}, {_blur(1, "gf")} SELECT b."row", b.col, round(CASE WHEN g.z IS NOT NULL THEN b.z END, 4) AS z FROM b JOIN g USING ("row", col)""")
def smooth_filled(spark, sf_dir):
    got = raster.smooth_filled(lift(spark, sf_dir).select("row", "col", "z"), 1, height(spark, sf_dir), WIDTH)
    return got.withColumn("z", F.round("z", 4))


@query(f"""WITH {GRID}, {SHAPES}, {_ICE}, {_FILLED}, {_blur(1, "gf")}, p AS (SELECT "row", col, CASE WHEN g.z IS NOT NULL THEN b.z END AS z, {_SOURCE} FROM b JOIN g USING ("row", col)), {_CHAIN}""")
def smoothed_bedrock(spark, sf_dir):
    surface = lift(spark, sf_dir).select("row", "col", "z")
    return raster.smoothed_bedrock(surface, ice(spark, sf_dir), shapes(spark, sf_dir), 1.5, _HERE, _THERE, height(spark, sf_dir), WIDTH, sigma=1)


_LOCAL = """(SELECT a."row", a.col, count(n.{v}) AS n, stddev_pop(n.{v}) AS d FROM {t} a JOIN {t} n
  ON n."row" BETWEEN a."row" - 2 AND a."row" + 2 AND n.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2)"""


@query(f"""WITH {GRID}, j AS (SELECT "row", col, z * 0.25 + fold * 9000 AS ice FROM g),
m AS (SELECT avg(x.d) AS a, avg(y.d) AS b, count(*) AS n FROM {_LOCAL.format(t="g", v="z")} x JOIN {_LOCAL.format(t="j", v="ice")} y USING ("row", col) WHERE x.n = 25 AND y.n = 25)
SELECT round(CASE WHEN n > 1000 AND a > 0 AND b > 0 THEN least(greatest(sqrt(a / b) - 1, 0.5), 5) ELSE 1 END, 6) AS sigma FROM m""")
def roughness_sigma(spark, sf_dir):
    g = lift(spark, sf_dir)
    other = g.select("row", "col", (F.col("z") * 0.25 + F.col("fold") * 9000).alias("ice"))
    return raster.roughness_sigma(g.select("row", "col", "z"), other).select(F.round("sigma", 6).alias("sigma"))


_FOCAL = """WITH {relief}, o(dy, dx) AS (VALUES {disc}), e AS (SELECT min(z) AS lo, max(z) AS hi FROM g),
q AS (SELECT "row", col, z, trunc((z - lo) / (hi - lo) * 255)::INT AS b, lo, hi FROM g CROSS JOIN e),
f AS (SELECT a."row", a.col, any_value(a.lo) AS lo, any_value(a.hi) AS hi, count(n.z) AS n, avg(n.z) AS m, var_pop(n.z) AS v,
  min(n.b) AS b0, max(n.b) AS b1, sum(n.b) AS bs, quantile_disc(n.b, 0.5) AS bm
  FROM q a CROSS JOIN o JOIN q n ON n."row" = a."row" + o.dy AND n.col = a.col + o.dx GROUP BY 1, 2)
SELECT g."row", g.col, round(CASE WHEN n = {size} THEN {expr} END, {digits}) AS {column} FROM g LEFT JOIN f USING ("row", col)"""
_STATS = {
    "std": "sqrt(v)", "var": "v", "min": "lo + b0 / 255.0::DOUBLE * (hi - lo)", "max": "lo + b1 / 255.0::DOUBLE * (hi - lo)",
    "range": "(b1 - b0) / 255.0::DOUBLE * (hi - lo)", "mean": "lo + floor(bs / {size}::DOUBLE) / 255 * (hi - lo)", "median": "lo + bm / 255.0::DOUBLE * (hi - lo)",
}


def _focal_sql(stat: str, radius: int) -> str:
    cells = [(d, e) for d, s in grid.spans(radius).items() for e in range(-s, s + 1)]
    disc = ", ".join(f"({d}, {e})" for d, e in cells)
    return _FOCAL.format(
        relief=RELIEF, disc=disc, size=len(cells), expr=_STATS[stat].format(size=len(cells)), digits=DIGITS, column=f"z_{stat}_w{radius}"
    )


for _stat, _radius in [(s, 3) for s in _STATS] + [("std", 5), ("range", 5), ("std", 7), ("range", 7), ("median", 5)]:

    def _focal(spark, sf_dir, stat=_stat, radius=_radius):
        column = f"z_{stat}_w{radius}"
        return grid.focal(relief(spark, sf_dir), stat, radius).withColumn(column, F.round(column, DIGITS))

    query(_focal_sql(_stat, _radius), f"focal_{_stat}_w{_radius}")(_focal)

_ZONES = [(s, r) for r in (3, 5) for s in ("std", "range")]


@query("SELECT * FROM " + " JOIN ".join(f"({_focal_sql(s, r)}) t{k}" + (' USING ("row", col)' if k else "") for k, (s, r) in enumerate(_ZONES)))
def zonal_features(spark, sf_dir):
    got = neighbourhood.zonal(relief(spark, sf_dir), ["z", "not there"], ["std", "range"], [3, 5])
    return got.select("row", "col", *[F.round(f"z_{s}_w{r}", DIGITS).alias(f"z_{s}_w{r}") for s, r in _ZONES])


def _base_sql() -> str:
    """CTEs of all base features; the last one is ``base``."""
    parts, columns = [], {}
    for sigma in (1, 3, 5):
        body = ", ".join(
            f"{_EXPR[a]} AS {a}_sigma{sigma}" for a in ("slope", "profile_curvature", "planform_curvature", "mean_curvature")
        )
        parts.append(
            f"""x{sigma} AS MATERIALIZED (WITH {_blur(sigma)}, {_D}, s AS (SELECT *, {_EXPR["slope"]} AS s FROM d3),
e AS (SELECT *, {_diff("s", "col", "100")} AS sx, {_diff("s", '"row"', "(SELECT height FROM h)")} AS sy FROM s)
SELECT "row", col, {body}, sqrt(sx * sx + sy * sy) AS slope_break_index_sigma{sigma} FROM e)"""
        )
        columns[sigma] = [f"{a}_sigma{sigma}" for a in features.TERRAIN]
    every = ", ".join(f"CASE WHEN g.z IS NOT NULL THEN {c} END AS {c}" for cs in columns.values() for c in cs)
    joined = " ".join(f'JOIN x{sigma} USING ("row", col)' for sigma in columns)
    parts.append(f'base AS MATERIALIZED (SELECT "row", col, g.z AS elevation_sigma0, {every} FROM g {joined})')
    return ", ".join(parts)


def _standard_sql() -> str:
    every = features.standard_features()
    zones = [f for f in every if f.zonal]
    sources = list(dict.fromkeys(features.Feature(f.name, f.sigma).column for f in zones))
    tall = " UNION ALL ".join(f"""SELECT "row", col, {k} AS k, '{c}' AS f, {c} AS v FROM base""" for k, c in enumerate(sources))
    discs, pivots = [], []
    for r in (3, 5, 7):
        cells = [(d, e) for d, s in grid.spans(r).items() for e in range(-s, s + 1)]
        discs.append(
            f"""disc{r} AS (SELECT a."row", a.col, a.f, CASE WHEN count(n.v) = {len(cells)} THEN sqrt(var_pop(n.v)) END AS std,
CASE WHEN count(n.v) = {len(cells)} THEN (max(n.b) - min(n.b)) / 255.0::DOUBLE * any_value(n.hi - n.lo) END AS "range"
FROM binned a CROSS JOIN (VALUES {", ".join(map(str, cells))}) o(dy, dx) JOIN binned n ON n.place = a.place + dy * 1000 + dx GROUP BY 1, 2, 3)"""
        )
        columns = ", ".join(f"""max("{s}") FILTER (f = '{c}') AS {c}_{s}_w{r}""" for c in sources for s in ("std", "range"))
        pivots.append(f'wide{r} AS (SELECT "row", col, {columns} FROM disc{r} GROUP BY 1, 2)')
    out = ", ".join(f"round({f.column}, {DIGITS}) + 0.0::DOUBLE AS {f.column}" for f in every[1:])
    return f"""WITH {RELIEF}, {_base_sql()}, tall AS MATERIALIZED ({tall}), ends AS (SELECT f, min(v) AS lo, max(v) AS hi FROM tall GROUP BY 1),
binned AS MATERIALIZED (SELECT tall.*, k::BIGINT * 1000000000 + "row" * 1000 + col AS place, lo, hi, trunc((v - lo) / (hi - lo) * 255)::INT AS b FROM tall JOIN ends USING (f)), {", ".join(discs)}, {", ".join(pivots)}
SELECT "row", col, elevation_sigma0, {out} FROM base LEFT JOIN wide3 USING ("row", col) LEFT JOIN wide5 USING ("row", col) LEFT JOIN wide7 USING ("row", col)"""


def _feature_table(spark, sf_dir):
    every, surface = features.standard_features(), relief(spark, sf_dir)
    made = neighbourhood.attributes(surface, neighbourhood.wanted_of(every), height(spark, sf_dir), WIDTH)
    return neighbourhood.feature_table(tables.kept(made, "base-features"), every)


@query(_standard_sql())
def standard_features(spark, sf_dir):
    """All 52 features of the standard run: base features written once, then their disc statistics."""
    every, got = features.standard_features(), _feature_table(spark, sf_dir)
    rounded = [(F.round(f.column, DIGITS) + F.lit(0.0)).alias(f.column) for f in every[1:]]
    return got.select("row", "col", "elevation_sigma0", *rounded)


@query(f"""WITH {GRID}, f AS (SELECT a."row", a.col, count(n.z) AS n, var_pop(n.z) AS v FROM g a JOIN g n
ON n."row" BETWEEN a."row" - 2 AND a."row" + 2 AND n.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2)
SELECT "row", col, round(CASE WHEN n = 25 THEN v END, -1) AS local_variance FROM f""")
def local_variance_5x5(spark, sf_dir):
    got = grid.box_variance(lift(spark, sf_dir).select("row", "col", "z"))
    return got.withColumn("local_variance", F.round("local_variance", -1))


@query(f"""WITH {GRID} SELECT g."row", g.col, EXISTS (SELECT 1 FROM g p WHERE p.label
AND abs(p."row" - g."row") <= 10 AND abs(p.col - g.col) <= 10) AS near FROM g""")
def dilate_exclude_b10(spark, sf_dir):
    return grid.dilate(lift(spark, sf_dir).select("row", "col", "label"), "label", 10).drop("label")


@query(f"""WITH {GRID}, p AS (SELECT g.*, EXISTS (SELECT 1 FROM g p WHERE p.label AND p.fold = g.fold
AND abs(p."row" - g."row") <= 3 AND abs(p.col - g.col) <= 3) AS near FROM g),
r AS (SELECT *, count(*) FILTER (label) OVER (PARTITION BY fold) AS np FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY md5(concat_ws(':', 42 + fold, "row", col)), "row", col) AS i FROM r WHERE label OR NOT near)
SELECT fold, "row", col, label::INT AS label FROM k WHERE np > 0 AND (label OR i <= floor(np * 2.0::DOUBLE * 1.2::DOUBLE))""")
def fold_sample(spark, sf_dir):
    return sampling.fold_sample(lift(spark, sf_dir), 2.0, 3, 42)


_SAMPLED = f"""{GRID}, p AS (SELECT g.*, EXISTS (SELECT 1 FROM g p WHERE p.label AND p.fold = g.fold
AND abs(p."row" - g."row") <= 3 AND abs(p.col - g.col) <= 3) AS near FROM g),
r AS (SELECT *, count(*) FILTER (label) OVER (PARTITION BY fold) AS np FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY md5(concat_ws(':', 42 + fold, "row", col)), "row", col) AS i FROM r WHERE label OR NOT near),
sampled AS (SELECT fold, "row", col, label::INT AS label, z, CASE WHEN z < 250000 THEN z / 2 ELSE 'inf'::DOUBLE END AS half FROM k
  WHERE np > 0 AND (label OR i <= floor(np * 2.0::DOUBLE * 1.2::DOUBLE)))"""


def _pixels(spark, sf_dir):
    half = F.when(F.col("z") < 250000, F.col("z") / 2).otherwise(F.lit(float("inf")))
    return lift(spark, sf_dir).select("row", "col", "z", half.alias("half"))


@query(f"""WITH {_SAMPLED} SELECT fold, "row", col, label, z, CASE WHEN isinf(half) THEN -1 ELSE half END AS half FROM sampled""")
def gather_samples(spark, sf_dir):
    got = sampling.gather(sampling.fold_sample(lift(spark, sf_dir), 2.0, 3, 42), _pixels(spark, sf_dir), ["z", "half"])
    return got.withColumn("half", F.when(F.col("half") == float("inf"), -1.0).otherwise(F.col("half")))


@query(f"""WITH {_SAMPLED}, v AS (SELECT *, count(*) FILTER (label = 1) OVER (PARTITION BY fold) AS nv,
  row_number() OVER (PARTITION BY fold, label ORDER BY md5(concat_ws(':', 42 + fold, "row", col)), "row", col) AS j FROM sampled WHERE z IS NOT NULL AND isfinite(half))
SELECT fold, "row", col, label, z, half FROM v WHERE nv > 0 AND (label = 1 OR j <= floor(nv * 1.5::DOUBLE))""")
def training_table(spark, sf_dir):
    return sampling.training_table(sampling.fold_sample(lift(spark, sf_dir), 2.0, 3, 42), _pixels(spark, sf_dir), ["z", "half"], 1.5, 42)


@query(f"""WITH {_SAMPLED} SELECT fold, count(*) FILTER (label = 1)::BIGINT AS positives, count(*) FILTER (label = 0)::BIGINT AS unlabeled,
round(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 6) AS ratio, count(*)::BIGINT AS n_samples FROM sampled GROUP BY ROLLUP (fold)""")
def fold_statistics(spark, sf_dir):
    got = sampling.fold_statistics(sampling.fold_sample(lift(spark, sf_dir), 2.0, 3, 42))
    return got.withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {GRID} SELECT "row", col FROM g WHERE z IS NOT NULL AND z < 400000""")
def valid_pixels(spark, sf_dir):
    g = lift(spark, sf_dir).withColumn("f", F.when(F.col("z") >= 400000, F.lit(float("inf"))).otherwise(F.lit(1.0)))
    return sampling.valid(g, ["z", "f"]).select("row", "col")


_F = """f AS (SELECT *, name || '_sigma' || sigma || coalesce('_' || stat || '_w' || w, '') AS feature FROM (
  SELECT 'elevation' AS name, 0 AS sigma, NULL AS stat, NULL AS w
  UNION ALL SELECT name, sigma, NULL, NULL FROM (SELECT unnest(['slope', 'slope_break_index', 'profile_curvature', 'planform_curvature', 'mean_curvature']) AS name), (SELECT unnest([1, 3, 5]) AS sigma)
  UNION ALL SELECT name, CASE name WHEN 'elevation' THEN 0 ELSE 1 END, stat, w FROM
    (SELECT unnest(['elevation', 'slope', 'slope_break_index', 'profile_curvature', 'planform_curvature', 'mean_curvature']) AS name),
    (SELECT unnest([3, 5, 7]) AS w), (SELECT unnest(['std', 'range']) AS stat)))"""


@query(f"""WITH {_F}, every AS ({_standard_sql()}), c AS (SELECT k::INT AS set_id, feature, name = 'elevation' AS height, name, sigma, stat, w, (k - 1) % 3 AS t FROM f, range(1, 31) r(k)),
m AS (SELECT set_id, feature FROM c WHERE CASE
  WHEN set_id <= 12 THEN (height OR sigma <= 1 + 2 * t) AND (stat IS NULL AND (NOT height OR set_id >= 7) OR stat IS NOT NULL AND (set_id BETWEEN 4 AND 6 OR set_id >= 10))
  WHEN set_id <= 18 THEN stat IS NULL AND sigma <= 1 AND list_contains(CASE set_id WHEN 13 THEN ['slope'] WHEN 14 THEN ['slope', 'slope_break_index']
    WHEN 15 THEN ['profile_curvature', 'planform_curvature', 'mean_curvature'] WHEN 16 THEN ['slope', 'profile_curvature', 'planform_curvature', 'mean_curvature']
    WHEN 17 THEN ['slope', 'slope_break_index', 'profile_curvature', 'planform_curvature', 'mean_curvature']
    ELSE ['elevation', 'slope', 'slope_break_index', 'profile_curvature', 'planform_curvature', 'mean_curvature'] END, name)
  WHEN set_id <= 24 THEN stat IS NULL AND NOT height AND list_contains(CASE set_id WHEN 19 THEN [1] WHEN 20 THEN [3] WHEN 21 THEN [5] WHEN 22 THEN [1, 3] WHEN 23 THEN [3, 5] ELSE [1, 3, 5] END, sigma)
  ELSE NOT height AND (stat IS NULL OR (w = 3 OR set_id >= 28) AND (set_id IN (27, 30) OR stat = CASE WHEN set_id IN (25, 28) THEN 'std' ELSE 'range' END)) END),
tall AS (UNPIVOT every ON COLUMNS(* EXCLUDE ("row", col)) INTO NAME feature VALUE v),
q AS (SELECT *, count(*) OVER (PARTITION BY set_id) AS size FROM m),
whole AS (SELECT set_id, "row", col FROM q JOIN tall USING (feature) GROUP BY set_id, "row", col HAVING count(*) = any_value(size)),
n AS (SELECT set_id, count(*)::BIGINT AS n_valid FROM whole GROUP BY 1)
SELECT set_id, feature, coalesce(n_valid, 0)::BIGINT AS n_valid FROM m LEFT JOIN n USING (set_id)""")
def feature_set_projection(spark, sf_dir):
    """Each set's features and the pixels at which all of them have values, in one pass over the feature table."""
    every = features.standard_features()
    wide = _feature_table(spark, sf_dir)
    sets = {k: features.select_set(wide, every, k).columns[2:] for k in range(1, 31)}
    rows = [F.struct(F.lit(k).alias("set_id"), F.array(*map(F.lit, c)).alias("fs"), F.count_if(_all_there(c)).alias("n_valid")) for k, c in sets.items()]
    counted = wide.agg(F.array(*rows).alias("s")).select(F.inline("s"))
    return counted.select("set_id", F.explode("fs").alias("feature"), "n_valid")


def _all_there(columns: list[str]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount FROM lineitem""")
def standard_scale(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    got = sampling.standard_scale(rows, ["l_quantity", "l_discount"])
    return got.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("l_quantity", "l_discount")])


# ranking --------------------------------------------------------------------


def scored(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("label"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("fold"),
    )


_ARGS = ("score", "label", "o_orderkey")
_CURVE = """k AS (SELECT (o_custkey % 5 + 1)::INT AS fold, (o_orderstatus = 'F')::INT AS y,
  row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_totalprice DESC, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey % 5) AS n FROM orders),
c AS (SELECT fold, y, i, n, i / n::DOUBLE * 100 AS x, sum(y) OVER (PARTITION BY fold ORDER BY i) / sum(y) OVER (PARTITION BY fold)::DOUBLE * 100 AS v FROM k)"""


@query(f"WITH {_CURVE} SELECT fold, i, n, round(x, 6) AS inspected_area_pct, round(v, 6) AS detected_positives_pct FROM c")
def success_rate_curve(spark, sf_dir):
    got = ranking.success_rate_curve(scored(spark, sf_dir), *_ARGS)
    return got.select("fold", F.col("i").cast("long").alias("i"), "n", *[F.round(c, 6).alias(c) for c in ("inspected_area_pct", "detected_positives_pct")])


_METRICS = f"""WITH {_CURVE}, a AS (SELECT *, (x - lag(x) OVER w) * (v + lag(v) OVER w) / 2 AS area FROM c WINDOW w AS (PARTITION BY fold ORDER BY i))
SELECT fold, {{columns}} FROM a GROUP BY fold"""
_TOPS = ", ".join(f"round(max(v) FILTER (i = ceil(n * {p / 100!r}::DOUBLE)), 6) AS top_{p}_pct" for p in ranking.TOP)


@query(_METRICS.format(columns="round(sum(area) / 10000, 6) AS auc"))
def src_auc(spark, sf_dir):
    got = ranking.curve_metrics(ranking.success_rate_curve(scored(spark, sf_dir), *_ARGS))
    return got.select("fold", F.round("auc", 6).alias("auc"))


@query(_METRICS.format(columns=_TOPS))
def top_pct_gain(spark, sf_dir):
    got = ranking.curve_metrics(ranking.success_rate_curve(scored(spark, sf_dir), *_ARGS))
    return got.select("fold", *[F.round(f"top_{p}_pct", 6).alias(f"top_{p}_pct") for p in ranking.TOP])


@query(f"WITH {_CURVE} SELECT fold, round(avg((i - 1) / nullif(n - 1, 0)::DOUBLE * 100), 6) AS mean_rank_percentile FROM c WHERE y = 1 GROUP BY 1")
def mean_rank_percentile(spark, sf_dir):
    got = ranking.mean_rank_percentile(scored(spark, sf_dir), *_ARGS)
    return got.select("fold", F.round("mean_rank_percentile", 6).alias("mean_rank_percentile"))


@query(f"""WITH {_CURVE} SELECT fold, least(floor((i - 1) / n::DOUBLE * 100 / 5), 19)::INT AS bin, (least(floor((i - 1) / n::DOUBLE * 100 / 5), 19) + 0.5) * 5 AS bin_center,
round(sum(y) / (SELECT sum(y) FROM k WHERE k.fold = c.fold)::DOUBLE * 100, 6) AS pct_positives FROM c GROUP BY 1, 2, 3""")
def gain_bins(spark, sf_dir):
    got = ranking.gain_bins(scored(spark, sf_dir), *_ARGS)
    return got.select("fold", "bin", F.col("bin_center").cast("double").alias("bin_center"), F.round("pct_positives", 6).alias("pct_positives"))


@query(f"""WITH {_CURVE}, e AS (SELECT *, lead(x) OVER w AS x2, lead(v) OVER w AS v2 FROM c WINDOW w AS (PARTITION BY fold ORDER BY i)),
p AS (SELECT k AS kk, k * (100.0::DOUBLE / 99) AS gx FROM range(100) t(k)),
m AS (SELECT kk, gx, fold, CASE WHEN i = 1 AND gx <= x OR x2 IS NULL THEN v ELSE v + (gx - x) * (v2 - v) / (x2 - x) END AS y
  FROM p JOIN e ON (gx >= x - 1e-9 OR i = 1) AND (x2 IS NULL OR gx < x2 - 1e-9))
SELECT round(gx, 6) AS inspected_area_pct, round(avg(y), 4) AS detected_positives_pct_mean, round(stddev_pop(y), 4) AS detected_positives_pct_std FROM m GROUP BY gx""")
def curve_mean_std(spark, sf_dir):
    got = ranking.curve_mean_std(ranking.success_rate_curve(scored(spark, sf_dir), *_ARGS))
    return got.select(
        F.round("inspected_area_pct", 6).alias("inspected_area_pct"),
        *[F.round(c, 4).alias(c) for c in ("detected_positives_pct_mean", "detected_positives_pct_std")],
    )


@query(f"""WITH {_CURVE}, f AS (SELECT count(DISTINCT fold) AS nf FROM c), b AS (SELECT fold, least(floor((i - 1) / n::DOUBLE * 100 / 5), 19)::INT AS bin,
  sum(y) / (SELECT sum(y) FROM k WHERE k.fold = c.fold)::DOUBLE * 100 AS p FROM c GROUP BY 1, 2)
SELECT (bin + 0.5) * 5 AS bin_center, round(sum(p) / any_value(nf), 6) AS pct_positives_mean, round(sqrt(greatest(sum(p * p) / any_value(nf) - pow(sum(p) / any_value(nf), 2), 0)), 6) AS pct_positives_std FROM b, f GROUP BY bin""")
def gain_bins_mean_std(spark, sf_dir):
    got = ranking.gain_bins_mean_std(ranking.gain_bins(scored(spark, sf_dir), *_ARGS), 5)
    return got.select(F.col("bin_center").cast("double").alias("bin_center"), *[F.round(c, 6).alias(c) for c in ("pct_positives_mean", "pct_positives_std")])


_CV = f"""{_CURVE}, a AS (SELECT *, (x - lag(x) OVER w) * (v + lag(v) OVER w) / 2 AS area FROM c WINDOW w AS (PARTITION BY fold ORDER BY i)),
m AS (SELECT fold, sum(area) / 10000 AS auc, {_TOPS}, avg((i - 1) / nullif(n - 1, 0)::DOUBLE * 100) FILTER (y = 1) AS mean_rank_percentile FROM a GROUP BY 1)"""


@query(f"WITH {_CV} SELECT * REPLACE (round(auc, 6) AS auc, round(mean_rank_percentile, 6) AS mean_rank_percentile) FROM m")
def cv_metrics(spark, sf_dir):
    got = model.cv_metrics(scored(spark, sf_dir), "o_orderkey")
    return got.select("fold", *[F.round(c, 6).alias(c) for c in got.columns if c != "fold"])


@query(f"""WITH {_CV} SELECT round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std,
round(avg(mean_rank_percentile), 6) AS mean_rank_percentile_mean, round(stddev_pop(mean_rank_percentile), 6) AS mean_rank_percentile_std FROM m""")
def cv_summary(spark, sf_dir):
    got = model.cv_summary(model.cv_metrics(scored(spark, sf_dir), "o_orderkey"))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


_WEIGHTS = "SELECT p_brand AS feature, p_retailprice / 1000 AS importance FROM part"


@query(f"SELECT feature, round(avg(importance), 6) AS importance_mean, round(stddev_pop(importance), 6) AS importance_std FROM ({_WEIGHTS}) GROUP BY 1")
def importance_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), (F.col("p_retailprice") / 1000).alias("importance"))
    got = model.importance_summary(rows)
    return got.select("feature", *[F.round(c, 6).alias(c) for c in ("importance_mean", "importance_std")])


@query(f"SELECT feature, round(avg(importance), 6) AS importance_mean FROM ({_WEIGHTS}) GROUP BY 1 ORDER BY avg(importance) DESC, feature LIMIT 10")
def top_importances(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), (F.col("p_retailprice") / 1000).alias("importance"))
    return model.importance_summary(rows).limit(10).select("feature", F.round("importance_mean", 6).alias("importance_mean"))


@query(f"""WITH {GRID}, r AS (SELECT CASE WHEN label THEN NULL ELSE z / 600000 END AS risk FROM g)
SELECT count(*)::BIGINT AS n_pixels, count(risk)::BIGINT AS n_scored, round(min(risk), 9) AS risk_min, round(max(risk), 9) AS risk_max, round(avg(risk), 9) AS risk_mean FROM r""")
def risk_summary(spark, sf_dir):
    got = model.risk_summary(lift(spark, sf_dir).select("row", "col", F.when(~F.col("label"), F.col("z") / 600000).alias("risk")))
    return got.select("n_pixels", "n_scored", *[F.round(c, 9).alias(c) for c in ("risk_min", "risk_max", "risk_mean")])


@query(f"""WITH {GRID}, {SHAPES} SELECT "row", col, coalesce(isfinite(z) AND z < 250000 AND EXISTS (SELECT 1 FROM s WHERE fold IS NOT NULL
AND g.col + 1 >= x0 AND g.col <= x1 AND g."row" + 1 >= y0 AND g."row" <= y1), false) AS scored FROM g""")
def risk_map(spark, sf_dir):
    """Which pixels a model scores; its scores are within 0 and 1."""
    pixels = _pixels(spark, sf_dir)
    train = pixels.join(lift(spark, sf_dir).select("row", "col", F.col("label").cast("int").alias("label")), ["row", "col"])
    fitted = model.fit(train, ["z", "half"], model.Config(method="plain", trees=5, depth=4))
    got = model.risk_map(pixels, shapes(spark, sf_dir).where("fold is not null"), fitted)
    return got.select("row", "col", F.coalesce(F.col("risk").between(0, 1), F.lit(False)).alias("scored"))


_PLACES = "SELECT s_suppkey, 2480000 + s_suppkey * 7919 % 350000 + 0.5::DOUBLE AS e, 1075000 + s_suppkey * 104729 % 220000 + 0.25::DOUBLE AS n FROM supplier"


@query(f"""WITH p AS ({_PLACES}), t AS (SELECT *, (e - 2600000) / 1000000 AS y, (n - 1200000) / 1000000 AS x FROM p)
SELECT s_suppkey, round((2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * pow(x, 2) - 0.0436 * pow(y, 3)) * 100 / 36, 7) AS lon,
round((16.9023892 + 3.238272 * x - 0.270978 * pow(y, 2) - 0.002528 * pow(x, 2) - 0.0447 * pow(y, 2) * x - 0.0140 * pow(x, 3)) * 100 / 36, 7) AS lat,
e - 2000000 AS e03, n - 1000000 AS n03 FROM t""")
def reproject(spark, sf_dir):
    places = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "2480000 + s_suppkey * 7919 % 350000 + double(0.5) AS e", "1075000 + s_suppkey * 104729 % 220000 + double(0.25) AS n"
    )
    lon, lat = projection.reproject(F.col("e"), F.col("n"), projection.LV95, projection.WGS84)
    e, n = projection.reproject(F.col("e"), F.col("n"), projection.LV95, projection.LV03)
    return places.select("s_suppkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"), e.alias("e03"), n.alias("n03"))


# sources and sinks -------------------------------------------------------------


def _written_tiles(spark, sf_dir):
    path = tables.shared_path(spark, "tiles")
    place = geotiff.Meta(height(spark, sf_dir), WIDTH, 2600000.0, 1200000.0, 10.0, 10.0, -9999.0, 2056)
    return path, geotiff.write_tiles(lift(spark, sf_dir).select("row", "col", "z"), path, place, "z", "f8", -9999.0, 64)


@query(f"""WITH {GRID} SELECT "row", col, z AS value FROM g""")
def geotiff_tiles(spark, sf_dir):
    """The raster written as georeferenced tiles and read back whole."""
    path, _ = _written_tiles(spark, sf_dir)
    return geotiff.read_tiles(spark, path, 64)


@query(f"""WITH {GRID} SELECT "row" // 64 AS tile_row, col // 64 AS tile_col, 'tile_' || ("row" // 64) || '_' || (col // 64) || '.tif' AS file,
count(z)::BIGINT AS n_valid FROM g GROUP BY 1, 2""")
def geotiff_manifest(spark, sf_dir):
    return _written_tiles(spark, sf_dir)[1]


#: Values, the type that holds them, its missing value, packing and side of tiles, for whole files.
_FILES = {
    "u2": ("bround(z / 10, 0)", "round_even(z / 10, 0)", 65535, "deflate", 64),
    "i2": ("CASE WHEN z IS NOT NULL THEN fold END", "CASE WHEN z IS NOT NULL THEN fold END", -1, "deflate", 32),
    "f4": ("CAST(z / 4 AS FLOAT)", "(z / 4)::FLOAT", -3.4028234663852886e38, "lzw", 64),
}


def _written_file(spark, sf_dir, kind):
    values, _, nodata, packing, side = _FILES[kind]
    path = tables.shared_path(spark, f"raster-{kind}")
    place = geotiff.Meta(height(spark, sf_dir), WIDTH, 2600000.0, 1200000.0, 10.0, 10.0, nodata, 2056)
    rows = lift(spark, sf_dir).select("row", "col", F.expr(values).cast("double").alias("v"))
    geotiff.write_raster(rows, path, place, "v", kind, nodata, side, packing, "a band")
    return path


for _kind, (_, _sql, *_) in _FILES.items():

    def _whole_file(spark, sf_dir, kind=_kind):
        path = _written_file(spark, sf_dir, kind)
        geotiff.register(spark)
        return spark.read.format("geotiff").load(path)

    query(f'WITH {GRID} SELECT "row", col, ({_sql})::DOUBLE AS value FROM g', f"geotiff_file_{_kind}")(_whole_file)


def _cube_paths(spark, sf_dir):
    return {f"band_{kind}": _written_file(spark, sf_dir, kind) for kind in _FILES}


_BANDS = ", ".join(f"({sql})::DOUBLE AS band_{kind}" for kind, (_, sql, *_) in _FILES.items())


@query(f"""WITH {GRID} SELECT "row", col, {_BANDS} FROM g""")
def feature_cube(spark, sf_dir):
    """Three rasters of their own types, tiles and packings, read together."""
    return cube.feature_cube(spark, _cube_paths(spark, sf_dir))


@query(f"""WITH {GRID} SELECT "row", col, z IS NOT NULL AS valid FROM g""")
def feature_cube_mask(spark, sf_dir):
    return cube.valid_mask(spark, _cube_paths(spark, sf_dir))


_PARTS = "SELECT '00' || p_partkey AS pk, p_name, CASE WHEN p_partkey % 7 <> 0 THEN p_brand || ', \"' || p_type || '\"' END AS kind, p_size, p_retailprice FROM part"


def _parts(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 7 != 0, F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("00"), "p_partkey").alias("pk"), "p_name", kind.alias("kind"), "p_size", "p_retailprice")


@query(_PARTS)
def csv_table(spark, sf_dir):
    """Keys keep their leading zeros, nulls and quotes survive."""
    path = tables.shared_path(spark, "csv")
    tables.write_csv(_parts(spark, sf_dir), path)
    return tables.read_csv(spark, path)


@query(_PARTS)
def json_table(spark, sf_dir):
    path, rows = tables.shared_path(spark, "json"), _parts(spark, sf_dir)
    tables.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query()
def pu_bagging_cv(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_custkey") % 100).cast("double").alias("c"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)).cast("int").alias("label"),
        (F.col("o_custkey") % 3).cast("int").alias("fold"),
    )
    got, _ = model.cross_validate(rows, ["o_totalprice", "c"])
    return got.select("o_orderkey", "fold", "label", "score")


@query("""SELECT k, part, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM (
SELECT k, CASE WHEN o_custkey % 5 = k THEN 'test' ELSE 'train' END AS part, o_orderkey
FROM orders, (SELECT DISTINCT o_custkey % 5 AS k FROM orders WHERE o_custkey % 11 > 0) WHERE o_custkey % 11 > 0) GROUP BY 1, 2""")
def fold_split(spark, sf_dir):
    custkey = F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(custkey % 11 > 0, custkey % 5).alias("fold"))
    parts = [
        part.select(F.lit(k).cast("long").alias("k"), F.lit(name).alias("part"), "o_orderkey")
        for k in model.folds_of(rows) for name, part in zip(("train", "test"), model.split(rows, k), strict=True)
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("k", "part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


# boosted trees, scored tiles and sample rasters -------------------------------

_BOOSTED = model.Config(
    method="plain", learner="regularised_boosting", trees=2, depth=2, rate=0.5, l1=0.5, l2=1.0, min_weight=2.0, bins=64
)
_TRAITS = ("a", "b", "c")


def _traits(spark, sf_dir):
    """Pixels with three whole-numbered features and a label that depends on two of them."""
    of = "o_custkey % 16 >= 8 AND o_orderkey % 12 < 5"
    return read(spark, sf_dir, "orders").selectExpr(
        "int(o_orderkey div 100) AS row", "int(o_orderkey % 100) AS col", "double(o_custkey % 16) AS a", "double(o_orderkey % 12) AS b",
        "CASE WHEN NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0) THEN double(bigint(floor(o_totalprice)) % 9) END AS c",
        f"int(o_orderkey * 7919 % 101 < CASE WHEN {of} THEN 80 ELSE 20 END) AS label",
    )


def _boosted_sql() -> str:
    """The trees of ``_BOOSTED`` as CTEs: ``s`` has every usable pixel's score, ``splits`` every split."""
    k = _BOOSTED

    def soft(g):
        return f"sign({g}) * greatest(abs({g}) - {k.l1}::DOUBLE, 0)"

    def worth(g, h):
        return f"pow({soft(g)}, 2) / ({h} + {k.l2}::DOUBLE)"

    made = [
        """px AS (SELECT (o_orderkey // 100)::INT AS "row", (o_orderkey % 100)::INT AS col, (o_custkey % 16)::DOUBLE AS a, (o_orderkey % 12)::DOUBLE AS b,
  CASE WHEN NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 97 = 0) THEN (floor(o_totalprice)::BIGINT % 9)::DOUBLE END AS c,
  (o_orderkey * 7919 % 101 < CASE WHEN o_custkey % 16 >= 8 AND o_orderkey % 12 < 5 THEN 80 ELSE 20 END)::INT AS y FROM orders),
r0 AS (SELECT "row", col, y, [a, b, c] AS x, ln(avg(y) OVER () / (1 - avg(y) OVER ())) AS m FROM px WHERE c IS NOT NULL)""",
    ]
    for t in range(k.trees):
        made.append(f"n{t}_0 AS (SELECT *, 1 AS node, 1 / (1 + exp(-m)) - y AS g, (1 / (1 + exp(-m))) * (1 - 1 / (1 + exp(-m))) AS h FROM r{t})")
        for d in range(k.depth):
            made.append(f"""c{t}_{d} AS (SELECT node, f, x[f] AS v, sum(g) AS g, sum(h) AS h FROM n{t}_{d}, range(1, 4) q(f) WHERE node >= {2**d} GROUP BY ALL),
w{t}_{d} AS (SELECT node, f, v, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER p AS g, sum(h) OVER p AS h, lead(v) OVER o AS cut FROM c{t}_{d}
  WINDOW p AS (PARTITION BY node, f), o AS (PARTITION BY node, f ORDER BY v)),
b{t}_{d} AS (SELECT * FROM (SELECT node, f, cut, round({worth('gl', 'hl')} + {worth('(g - gl)', '(h - hl)')} - {worth('g', 'h')}, 6) AS gain, v FROM w{t}_{d}
  WHERE cut IS NOT NULL AND hl >= {k.min_weight} AND h - hl >= {k.min_weight}) WHERE gain > 0.000001
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
n{t}_{d + 1} AS (SELECT n."row", n.col, n.y, n.x, n.m, CASE WHEN b.f IS NULL THEN n.node ELSE 2 * n.node + (n.x[b.f] >= b.cut)::INT END AS node, n.g, n.h
  FROM n{t}_{d} n LEFT JOIN b{t}_{d} b ON b.node = n.node AND n.node >= {2**d})""")
        made.append(f"""l{t} AS (SELECT node, -{k.rate}::DOUBLE * {soft('sum(g)')} / (sum(h) + {k.l2}::DOUBLE) AS step FROM n{t}_{k.depth} GROUP BY 1),
r{t + 1} AS (SELECT "row", col, y, x, m + step AS m FROM n{t}_{k.depth} JOIN l{t} USING (node))""")
    splits = " UNION ALL ".join(f"SELECT f, gain FROM b{t}_{d}" for t in range(k.trees) for d in range(k.depth))
    made.append(f"splits AS ({splits})")
    made.append(f"""s AS (SELECT px."row", px.col, 1 / (1 + exp(-m)) AS risk FROM px LEFT JOIN r{k.trees} USING ("row", col))""")
    return ",\n".join(made)


@query(f"""WITH {_boosted_sql()} SELECT "row", col, round(risk, 9) AS risk FROM s""")
def boosted_scores(spark, sf_dir):
    """The risk of every pixel by second-order trees that learned from all usable ones."""
    rows = _traits(spark, sf_dir)
    return model.fit(rows, list(_TRAITS), _BOOSTED).score(rows).select("row", "col", F.round("score", 9).alias("risk"))


@query(f"""WITH {_boosted_sql()}, i AS (SELECT f, avg(gain) AS gain FROM splits GROUP BY 1)
SELECT v AS feature, round(coalesce(gain, 0) / (SELECT sum(gain) FROM i), 6) AS importance
FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) n(k, v) LEFT JOIN i ON f = k""")
def boosted_importances(spark, sf_dir):
    found = model.fit(_traits(spark, sf_dir), list(_TRAITS), _BOOSTED).importances()
    return spark.createDataFrame(found, "feature string, importance double").withColumn("importance", F.round("importance", 6))


_RISK_SIDE = 32


@query(f"""WITH {_boosted_sql()} SELECT "row" // {_RISK_SIDE * 2} AS band, "row" // {_RISK_SIDE} AS tile_row, col // {_RISK_SIDE} AS tile_col, count(*)::BIGINT AS n_pixels,
count(risk)::BIGINT AS n_scored, round(min(risk), 9) AS risk_min, round(max(risk), 9) AS risk_max, round(sum(risk), 6) AS risk_sum FROM s GROUP BY ALL""")
def tile_scores(spark, sf_dir):
    """Counters of every tile, scored in two calls: the second goes on where the first stopped."""
    rows = _traits(spark, sf_dir)
    fitted = model.fit(rows, list(_TRAITS), _BOOSTED)
    path = tables.shared_path(spark, "risk")

    def score(part: DataFrame) -> DataFrame:
        return fitted.score(part).select("row", "col", F.col("score").alias("risk"))

    pixels = tables.kept(rows.select("row", "col", *_TRAITS), "pixels")
    scoring.score_tiles(pixels, score, path, _RISK_SIDE, 2, most=1)
    got = scoring.score_tiles(pixels, score, path, _RISK_SIDE, 2)
    return got.select(
        "band", "tile_row", "tile_col", "n_pixels", "n_scored", F.round("risk_min", 9).alias("risk_min"), F.round("risk_max", 9).alias("risk_max"),
        F.round("risk_sum", 6).alias("risk_sum"),
    )


@query(f"""WITH {_SAMPLED}, kk AS (SELECT DISTINCT fold FROM sampled)
SELECT kk.fold, g."row", g.col, s.label::DOUBLE AS value FROM kk CROSS JOIN g LEFT JOIN sampled s ON s.fold = kk.fold AND s."row" = g."row" AND s.col = g.col""")
def sample_rasters(spark, sf_dir):
    """Each fold's samples written as a raster and read back whole."""
    samples = tables.kept(sampling.fold_sample(lift(spark, sf_dir), 2.0, 3, 42), "samples")
    place = geotiff.Meta(height(spark, sf_dir), WIDTH, 2600000.0, 1200000.0, 10.0, 10.0, -9999.0, 2056)
    paths = scoring.write_samples(samples, tables.shared_path(spark, "samples"), place, side=64)
    geotiff.register(spark)
    parts = []
    for path in paths:
        k = int(path.rsplit("fold", 1)[1].removesuffix(".tif"))
        parts.append(spark.read.format("geotiff").load(path).select(F.lit(k).alias("fold"), "row", "col", "value"))
    return reduce(DataFrame.unionByName, parts)


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders)
SELECT o_custkey AS feature_id, 'customer ' || o_custkey AS name, count(*)::BIGINT AS n, min(o_orderkey)::DOUBLE AS x0, max(o_orderkey)::DOUBLE AS x1,
round(sum(o_totalprice), 4) AS y FROM p GROUP BY 1""")
def geopackage_lines(spark, sf_dir):
    """Each customer's orders as a line, written as GeoPackages and read back."""
    point = F.struct(F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    lines = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(point)).alias("line"))
    named = lines.select("o_custkey", F.format_string("customer %d", "o_custkey").alias("name"), F.array("line").alias("parts"))
    folder = tables.shared_path(spark, "packages")
    geopackage.write(named, folder, "customers", "o_custkey")
    geopackage.register(spark)
    got = spark.read.format("geopackage").option("layer", "customers").load(folder)
    line = F.col("parts")[0]
    return got.select(
        "feature_id", "name", F.size(line).cast("long").alias("n"), F.element_at(line, 1)["x"].alias("x0"), F.element_at(line, -1)["x"].alias("x1"),
        F.round(F.aggregate(line, F.lit(0.0), lambda total, p: total + p["y"]), 4).alias("y"),
    )


# rigorous coordinates -----------------------------------------------------------


def _to_swiss_sql(table: str) -> str:
    """``t``: the rows of ``table`` with ``e, n`` (LV95) of their ``lon, lat`` (WGS 84)."""
    (a, ee), (a2, ee2), k = geodesy.WORLD, geodesy.BESSEL, geodesy.SWISS
    b2 = a2 * (1 - ee2) ** 0.5
    dx, dy, dz = geodesy.SHIFT
    d = "::DOUBLE"
    return f"""t1 AS (SELECT *, radians(lon) AS l0, radians(lat) AS p0, {a}{d} / sqrt(1 - {ee}{d} * pow(sin(radians(lat)), 2)) AS nn FROM {table}),
t2 AS (SELECT *, nn * cos(p0) * cos(l0) - {dx}{d} AS u, nn * cos(p0) * sin(l0) - {dy}{d} AS v, nn * (1 - {ee}{d}) * sin(p0) - {dz}{d} AS w FROM t1),
t3 AS (SELECT *, sqrt(u * u + v * v) AS p, atan2(w * {a2}{d}, sqrt(u * u + v * v) * {b2}{d}) AS th FROM t2),
t4 AS (SELECT *, atan2(v, u) AS l1, atan2(w + {ee2 / (1 - ee2) * b2}{d} * pow(sin(th), 3), p - {ee2 * a2}{d} * pow(cos(th), 3)) AS p1 FROM t3),
t5 AS (SELECT *, {k['alpha']}{d} * (l1 - {geodesy.LAMBDA0}{d}) AS l, 2 * atan(exp({k['alpha']}{d} * (ln(tan(pi() / 4 + p1 / 2))
  - {k['e'] / 2}{d} * ln((1 + {k['e']}{d} * sin(p1)) / (1 - {k['e']}{d} * sin(p1)))) + {k['k']}{d})) - pi() / 2 AS b FROM t4),
t6 AS (SELECT *, atan2(sin(l), sin({k['b0']}{d}) * tan(b) + cos({k['b0']}{d}) * cos(l)) AS ll, cos({k['b0']}{d}) * sin(b) - sin({k['b0']}{d}) * cos(b) * cos(l) AS hh FROM t5),
t AS (SELECT *, {k['r']}{d} * ll + 2600000 AS e, {k['r'] / 2}{d} * ln((1 + hh) / (1 - hh)) + 1200000 AS n FROM t6)"""


@query(f"""WITH q AS (SELECT s_suppkey, 6 + s_suppkey * 7919 % 4200 / 1000::DOUBLE AS lon, 45.9::DOUBLE + s_suppkey * 104729 % 1800 / 1000::DOUBLE AS lat FROM supplier),
{_to_swiss_sql('q')} SELECT s_suppkey, round(e, 3) AS e, round(n, 3) AS n, round(e - 2000000, 3) AS e03, round(n - 1000000, 3) AS n03, true AS same FROM t""")
def reproject_exact(spark, sf_dir):
    """Degrees to both Swiss grids; ``same`` is whether the way over a UTM zone ends within a tenth of a millimetre."""
    places = read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "6 + s_suppkey * 7919 % 4200 / double(1000) AS e", "double(45.9) + s_suppkey * 104729 % 1800 / double(1000) AS n"
    )
    copies = {f"{c}{k}": F.col(c) for k in ("03", "_utm") for c in ("e", "n")}
    new = geodesy.transform(places.withColumns(copies), "e", "n", projection.WGS84, projection.LV95)
    old = geodesy.transform(new, "e03", "n03", projection.WGS84, projection.LV03)
    utm = geodesy.transform(old, "e_utm", "n_utm", projection.WGS84, "EPSG:32632")
    back = geodesy.transform(utm, "e_utm", "n_utm", "EPSG:32632", projection.LV95)
    same = F.greatest(F.abs(F.col("e") - F.col("e_utm")), F.abs(F.col("n") - F.col("n_utm"))) < 1e-4
    return back.select("s_suppkey", *[F.round(c, 3).alias(c) for c in ("e", "n", "e03", "n03")], same.alias("same"))


#: A raster in degrees, turned and wider than the source in LV95, whose rows and columns it looks up.
_DEGREES = {"x0": 7.438, "y0": 46.952, "dx": 0.00009, "dy": 0.0000625}
_METRES = {"x0": 2_600_000.0, "y0": 1_200_000.0, "dx": 10.0, "dy": 8.0}


@query(f"""WITH {GRID}, q AS (SELECT "row", col, {_DEGREES['x0']}::DOUBLE + (col + 0.5) * {_DEGREES['dx']}::DOUBLE AS lon,
{_DEGREES['y0']}::DOUBLE - ("row" + 0.5) * {_DEGREES['dy']}::DOUBLE AS lat FROM g), {_to_swiss_sql('q')},
c AS (SELECT "row", col, floor((1200000 - n) / 8)::INT AS sr, floor((e - 2600000) / 10)::INT AS sc FROM t)
SELECT c."row", c.col, g.z FROM c LEFT JOIN g ON g."row" = sr AND g.col = sc""")
def warp_nearest(spark, sf_dir):
    """The raster, in metres, resampled to a grid of degrees."""
    pixels = lift(spark, sf_dir).select("row", "col", "z")
    return raster.warp_nearest(pixels.select("row", "col"), pixels, "z", _DEGREES, _METRES, projection.WGS84, projection.LV95)


# constraints ----------------------------------------------------------------------


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey % 3 AS shape, CASE WHEN l_quantity < 3 THEN NULL ELSE l_suppkey END AS supplier,
  l_linenumber % 6 <> 5 AS list, l_partkey % 10 <> 7 AS line FROM lineitem),
u AS (SELECT l_partkey, count(*) AS n, min(id) AS o, min(shape) <> max(shape) AS more FROM r GROUP BY 1),
i AS (SELECT id, count(*) AS n FROM r GROUP BY 1)
SELECT 'supplier' AS rule, count(*) FILTER (supplier IS NULL)::BIGINT AS n_rows, min(id) FILTER (supplier IS NULL) AS first_row FROM r
UNION ALL SELECT 'list', count(*) FILTER (NOT list)::BIGINT, min(id) FILTER (NOT list) FROM r
UNION ALL SELECT 'line', count(*) FILTER (NOT line)::BIGINT, min(id) FILTER (NOT line) FROM r
UNION ALL SELECT 'unique id', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, min(id) FILTER (n > 1) FROM i
UNION ALL SELECT 'unique l_partkey', coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, min(o) FILTER (n > 1) FROM u
UNION ALL SELECT 'one shape l_partkey', coalesce(sum(n) FILTER (more), 0)::BIGINT, min(o) FILTER (more) FROM u""")
def constraint_report(spark, sf_dir):
    """Missing values, broken lists and lines, repeated keys and keys of several shapes."""
    line = "transform(sequence(0, IF(l_partkey % 10 = 7, 0, 2)), k -> struct(double(k) AS x, double(k * (l_suppkey % 3 + 1)) AS y))"
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "l_partkey", "CASE WHEN l_quantity >= 3 THEN l_suppkey END AS supplier",
        "CASE WHEN l_linenumber % 6 <> 5 THEN concat('[', l_suppkey, ']') ELSE concat('[', l_suppkey) END AS events", f"array({line}) AS parts",
        f"array(IF(l_partkey % 10 = 7, array(struct(0D AS x, double(l_suppkey % 3) AS y), struct(1D AS x, 1D AS y)), {line})) AS shape",
    )
    rules = {"supplier": constraints.present("supplier"), "list": constraints.json_list("events"), "line": constraints.lines("parts")}
    return constraints.violations(rows, rules, "id", ("id", "l_partkey"), {"l_partkey": "shape"})
