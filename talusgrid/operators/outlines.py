"""Valid and canonical polygons, and unions of them, with DataFrame functions only.

A shape is an id and its rings, as in ``polygons``; inside means an odd number of
crossings, so rings may cross themselves and each other. Shapes drawn alike are
worked on once. Edges are split where they meet, pieces that have the inside on
one side only are kept, turned so that it lies on their left, and traced into
rings. Edges meet by cells, pieces are held against the shapes with an edge in
their cell, by strips, and rings are traced by doubling: each round joins every
piece with the one twice as far on, so a ring of n edges takes log2 n rounds and
no task ever holds more than a vertex' or an edge's own rows. Only the finished
ring is gathered, as one value of its row. In unions, cells that lie within one
of the shapes are left out, and the others are quartered both ways while edges
are many in them: only cells along the border stay, so deep overlaps aren't split
against each other.

Tables of the steps are deleted once the next one is written. Joins are by
sorting, as a broadcast in each step would send what grows with the input to the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talusgrid.sources import tables
from talusgrid.sources.tables import kept

from .events import hash_uuid
from .polygons import centres, cover, edges, near, spans

#: Decimals of coordinates; what is closer than the last one is the same place.
DIGITS = 6
#: Side of the cells by which the edges of one shape meet, and width of strips, in the shapes' units.
CELL = 64.0
#: Cells of the bounds of a shape, at most, whose cells are listed; of larger ones only those with edges of others.
TILES = 4096
#: Edges of a group in one cell, in the mean over edges, above which cells are quartered both ways.
DEEP = 12
#: Pixels of a row that are held against shapes together.
BLOCK = 32
#: Shapes that one task cuts into edges.
SHARE = 2000

ENDS = ["x1", "y1", "x2", "y2"]
TILE = ["_g", "_cx", "_cy"]


def _steps(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long")))


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), on, how)


def _placed(sides: DataFrame, digits: int, cell: float) -> DataFrame:
    """``sides`` once for each cell that they may touch."""
    off = 10.0**-digits
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / cell), F.lit(1)).cast("int")
    parts = sides.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    at = lambda low, d, k: F.col(low) + d * (F.col("_k") + k) / F.col("_n")
    span = lambda low, d: _steps(
        (F.least(at(low, d, 0), at(low, d, 1)) - off) / cell, (F.greatest(at(low, d, 0), at(low, d, 1)) + off) / cell
    )
    placed = parts.select("*", span("x1", dx).alias("_cx")).select("*", span("y1", dy).alias("_cy"))
    return placed.select("_g", "_s", "_id", *ENDS, "_cx", "_cy").distinct()


def _filled(sides: DataFrame, placed: DataFrame, cell: float) -> DataFrame:
    """``_g, _cx, _cy``: cells that lie within one shape of their group, away from its edges: those with edges of others, at least."""
    ends = {f: [f(F.least(f"{a}1", f"{a}2") if f is F.min else F.greatest(f"{a}1", f"{a}2")) for a in "xy"] for f in (F.min, F.max)}
    w, h = ((ends[F.max][k] - ends[F.min][k]) / cell + 1 for k in (0, 1))
    sizes = sides.groupBy("_g", "_s").agg((w * h).alias("_tiles"))

    def scaled(chosen: str) -> DataFrame:
        some = _meet(sides, sizes.where(chosen).drop("_tiles"), ["_g", "_s"])
        return some.select(F.struct("_g", "_s").alias("_k"), *[(F.col(c) / cell).alias(c) for c in ENDS])

    inside = centres(scaled(f"_tiles <= {TILES}"), "_k").select("_k._g", "_k._s", F.col("col").alias("_cx"), F.col("row").alias("_cy"))
    across = spans(scaled(f"_tiles > {TILES}"), "_k").select("_k._g", "_k._s", F.col("row").alias("_cy"), "a", "b")
    middle = F.col("_cx") + 0.5
    over = _meet(placed.select(*TILE).distinct(), across, ["_g", "_cy"]).where((F.col("a") <= middle) & (middle < F.col("b")))
    inside = inside.unionByName(over.select(*inside.columns))
    return _meet(inside, placed.select("_g", "_s", "_cx", "_cy"), ["_g", "_s", "_cx", "_cy"], "left_anti").select(*TILE).distinct()


def _quartered(sides: DataFrame, placed: DataFrame, digits: int, cell: float, wide: float) -> DataFrame:
    """``placed`` in cells of a fourth of the side, without those that lie within one shape of their group.

    A cell's sixteen parts are bits: those that a shape's edges touch, and those
    whose middle it holds. The edges of a shape are found by strips of ``wide``.
    """
    off, part = 10.0**-digits, cell / 4
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    left, base = F.col("_cx") * 4, F.col("_cy") * 4 + F.col("_j")

    def rows(df: DataFrame) -> DataFrame:
        """Each edge once for each ``_j``, of four rows of parts, that it may touch; it does so from ``_first`` to ``_last``, if that isn't less."""
        each = df.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("_j"))
        each = each.where((low <= (base + 1) * part + off) & (high >= base * part - off))
        # an edge that hardly rises may be anywhere along it, as far as its slope can tell
        flat = high - low <= part / 16
        each = each.withColumn("_slope", (x2 - x1) / F.when(~flat, y2 - y1))
        at = lambda y: x1 + (F.least(F.greatest(y, low), high) - y1) * F.col("_slope")
        each = each.withColumns({"_a": F.coalesce(at(base * part - off), x1), "_b": F.coalesce(at((base + 1) * part + off), x2)})
        first, last = F.floor((F.least("_a", "_b") - 2 * off) / part), F.floor((F.greatest("_a", "_b") + 2 * off) / part)
        return each.withColumns({"_first": F.greatest(first - left, F.lit(0)).cast("int"), "_last": F.least(last - left, F.lit(3)).cast("int")})

    shifted = lambda x, by: F.call_function("shiftleft", x, by)
    bits = lambda first, last: shifted(shifted(F.lit(1), last + 1) - shifted(F.lit(1), first), F.col("_j") * 4)
    held = placed.select("_g", "_s", "_cx", "_cy").distinct().withColumn("_w", F.floor((F.col("_cy") + 0.5) * cell / wide).cast("long"))
    strips = sides.select("_g", "_s", *ENDS, _steps((low - off) / wide, (high + off) / wide).alias("_w"))
    middle = (base + 0.5) * part
    after = F.ceil((x1 + (middle - y1) * (x2 - x1) / (y2 - y1)) / part - 0.5) - left
    after = F.when((y1 <= middle) != (y2 <= middle), F.least(F.greatest(after, F.lit(0)), F.lit(4)).cast("int"))
    masks = rows(_meet(held, strips, ["_g", "_s", "_w"])).withColumn("_after", F.coalesce(after, F.lit(4)))
    masks = masks.groupBy("_g", "_s", "_cx", "_cy").agg(
        F.bit_or(F.when(F.col("_first") <= F.col("_last"), bits(F.col("_first"), F.col("_last"))).otherwise(0)).alias("t"),
        F.bit_xor(bits(F.col("_after"), F.lit(3))).alias("c"),
    )
    full = masks.groupBy(*TILE).agg(F.bit_or(F.col("c").bitwiseAND(F.bitwise_not("t"))).alias("_full"))
    parts = F.explode(F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last")))
    each = rows(_meet(placed, full, TILE)).select("*", parts.alias("_i")).where("shiftright(_full, _j * 4 + _i) & 1 = 0")
    return each.select("_g", "_s", "_id", *ENDS, (left + F.col("_i")).alias("_cx"), base.alias("_cy"))


def _opened(sides: DataFrame, placed: DataFrame, digits: int, cell: float, paths: list[str]) -> tuple[DataFrame, float]:
    """What ``placed`` has outside cells that lie within one shape, and the cells' side: less as long as pairs of edges get fewer by it."""
    filled, wide, seen = kept(_filled(sides, placed, cell), "filled", paths), cell, None
    rows = kept(_meet(placed, filled, TILE, "left_anti"), "open", paths)
    while True:
        n = F.col("count")
        edges_in, pairs = rows.groupBy(*TILE).count().agg(F.sum(n), F.sum(n * n)).first()
        if not edges_in or pairs <= DEEP * edges_in or (seen and 2 * pairs > seen) or cell / 4 < 100 * 10.0**-digits:
            return rows, cell
        rows, seen = kept(_quartered(sides, rows, digits, cell, wide), "open", paths), pairs
        tables.delete(sides.sparkSession, paths.pop(-2))
        cell /= 4


def _meetings(placed: DataFrame, digits: int) -> DataFrame:
    """``_id, x, y``: where each edge meets another of its group other than by crossing over both's ends."""
    off = 10.0**-digits
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    placed = placed.drop("_s")
    other = placed.select("_g", "_cx", "_cy", F.col("_id").alias("_other"), *[F.col(c).alias(f"o{c}") for c in ENDS])
    pairs = _meet(placed, other, TILE).where("_id < _other")

    def on(px: str, py: str, a: str) -> Column:
        """Whether a point lies on an edge whose columns begin with ``a``."""
        x1, y1, x2, y2 = (F.col(a + c) for c in ENDS)
        ux, uy = x2 - x1, y2 - y1
        t = F.least(F.greatest(((F.col(px) - x1) * ux + (F.col(py) - y1) * uy) / (ux * ux + uy * uy), F.lit(0.0)), F.lit(1.0))
        ax, ay = F.col(px) - (x1 + t * ux), F.col(py) - (y1 + t * uy)
        return ax * ax + ay * ay <= off * off

    place = lambda edge, x, y: F.struct(F.col(edge).alias("_id"), x.alias("x"), y.alias("y"))
    touching = [
        F.when(on(a + x, a + y, b), place(edge, F.col(a + x), F.col(a + y)))
        for a, b, edge in (("o", "", "_id"), ("", "o", "_other"))
        for x, y in (("x1", "y1"), ("x2", "y2"))
    ]
    ox, oy = F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    det = F.nullif(dx * oy - dy * ox, F.lit(0.0))
    qx, qy = F.col("ox1") - F.col("x1"), F.col("oy1") - F.col("y1")
    t, u = (qx * oy - qy * ox) / det, (qx * dy - qy * dx) / det
    proper = (t > 0) & (t < 1) & (u > 0) & (u < 1) & (F.size(F.array_compact("_touch")) == 0)
    x, y = F.round(F.col("x1") + t * dx, digits), F.round(F.col("y1") + t * dy, digits)
    crossing = F.when(proper, F.array(place("_id", x, y), place("_other", x, y))).otherwise(F.slice("_touch", 1, 0))
    return pairs.withColumn("_touch", F.array(*touching)).select(
        F.explode(F.concat(F.array_compact("_touch"), crossing)).alias("m")
    ).select("m.*").distinct()


def _split(sides: DataFrame, placed: DataFrame, digits: int) -> DataFrame:
    """``_g, x1, y1, x2, y2, _own, _ids``: pieces that meet at their ends only, from the lesser end.

    ``_own`` are the shapes that draw the piece an odd number of times (without
    one, it is left out), ``_ids`` all edges that it is of.
    """
    places = _meetings(placed, digits).groupBy("_id").agg(F.collect_list(F.struct("x", "y")).alias("_places"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = lambda p: ((p["x"] - F.col("x1")) * dx + (p["y"] - F.col("y1")) * dy) / (dx * dx + dy * dy)
    point = lambda t, x, y: F.struct(t.alias("t"), x.alias("x"), y.alias("y"))
    ends = F.array(point(F.lit(0.0), F.col("x1"), F.col("y1")), point(F.lit(1.0), F.col("x2"), F.col("y2")))
    inner = F.filter(F.transform("_places", lambda p: point(along(p), p["x"], p["y"])), lambda p: (p["t"] > 0) & (p["t"] < 1))
    line = F.array_sort(F.when(F.col("_places").isNull(), ends).otherwise(F.concat(ends, inner)))
    cut = _meet(sides, places, ["_id"], "left").select("_g", "_s", "_id", line.alias("p"))
    pairs = F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))
    pair = cut.select("_g", "_s", "_id", F.explode(pairs).alias("e")).where("e.a.x <> e.b.x or e.a.y <> e.b.y")
    low, high = F.struct("e.a.x", "e.a.y"), F.struct("e.b.x", "e.b.y")
    pair = pair.select("_g", "_s", "_id", F.least(low, high).alias("l"), F.greatest(low, high).alias("h"))
    named = [F.col("l.x").alias("x1"), F.col("l.y").alias("y1"), F.col("h.x").alias("x2"), F.col("h.y").alias("y2")]
    drawn = pair.select("_g", "_s", "_id", *named).groupBy("_g", "_s", *ENDS).agg(F.count("*").alias("n"), F.collect_set("_id").alias("_ids"))
    own = F.collect_list(F.when(F.col("n") % 2 == 1, F.col("_s")))
    pieces = drawn.groupBy("_g", *ENDS).agg(own.alias("_own"), F.flatten(F.collect_list("_ids")).alias("_ids"))
    return pieces.where(F.size("_own") > 0)


def _tile(cell: float) -> dict[str, Column]:
    """The cell of a piece's middle."""
    return {f"_c{a}": F.floor((F.col(f"{a}1") + F.col(f"{a}2")) / 2 / cell).cast("long") for a in "xy"}


def _covered(pieces: DataFrame, sides: DataFrame, held: DataFrame, along: str, up: str, wide: float) -> DataFrame:
    """``pieces`` with ``_above``: the shapes that hold what lies next to the middle, on the side where ``up`` grows.

    Only shapes with an edge in the middle's cell (``held``) are looked at, by strips of ``wide``.
    """
    a1, b1, a2, b2 = f"{along}1", f"{up}1", f"{along}2", f"{up}2"
    middle = pieces.select("_p", "_g", "_ids", ((F.col(a1) + F.col(a2)) / 2).alias("_ma"), ((F.col(b1) + F.col(b2)) / 2).alias("_mb"), "_cx", "_cy")
    middle = middle.withColumn("_w", F.floor(F.col("_ma") / wide).cast("long"))
    spread = sides.where(F.col(a1) != F.col(a2)).select(
        "_g", "_s", "_id", *[F.col(c).alias(f"o{c}") for c in ENDS], _steps(F.least(a1, a2) / wide, F.greatest(a1, a2) / wide).alias("_w")
    )
    low, high = F.least(f"o{a1}", f"o{a2}"), F.greatest(f"o{a1}", f"o{a2}")
    level = F.col(f"o{b1}") + (F.col("_ma") - F.col(f"o{a1}")) * (F.col(f"o{b2}") - F.col(f"o{b1}")) / F.nullif(
        F.col(f"o{a2}") - F.col(f"o{a1}"), F.lit(0.0)
    )
    over = (low <= F.col("_ma")) & (F.col("_ma") < high) & (level > F.col("_mb")) & ~F.array_contains("_ids", F.col("_id"))
    crossed = (
        _meet(_meet(middle, held, TILE), spread, ["_g", "_s", "_w"]).where(over).groupBy("_p", "_s").count().where("count % 2 = 1")
        .groupBy("_p").agg(F.collect_list("_s").alias("_above"))
    )
    return _meet(pieces, crossed, ["_p"], "left")


def _borders(pieces: DataFrame, sides: DataFrame, placed: DataFrame, wide: float) -> DataFrame:
    """``_g, x1, y1, x2, y2``: pieces between inside and outside, the inside on their left."""
    held = placed.select("_g", "_s", "_cx", "_cy").distinct()
    steep = F.abs(F.col("y2") - F.col("y1")) > F.abs(F.col("x2") - F.col("x1"))
    flat = _covered(pieces.where(~steep), sides, held, "x", "y", wide).withColumn("_left", F.lit(True))
    # along a steep piece that climbs, the side where x grows is the right one; the lesser end may be its upper one
    tall = _covered(pieces.where(steep), sides, held, "y", "x", wide).withColumn("_left", F.col("y1") > F.col("y2"))
    rows = flat.unionByName(tall)
    above = F.coalesce("_above", F.slice("_own", 1, 0))
    inside_above = F.size(above) > 0
    inside_below = (F.size(F.array_except(above, "_own")) > 0) | (F.size(F.array_except("_own", above)) > 0)
    forward = F.col("_left") == inside_above
    return rows.where(inside_above != inside_below).select(
        "_g",
        *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(ENDS, ["x2", "y2", "x1", "y1"], strict=True)],
    )


def _next(borders: DataFrame) -> DataFrame:
    """``me, on``: each piece, and the one after it around the same inside."""
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    out = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    coming = borders.select("_g", F.col("x2").alias("vx"), F.col("y2").alias("vy"), F.col("_b").alias("me"), back.alias("back"))
    going = borders.select("_g", F.col("x1").alias("vx"), F.col("y1").alias("vy"), F.col("_b").alias("on"), out.alias("out"))
    turn = F.pmod(F.col("back") - F.col("out"), F.lit(6.283185307179586))
    # the first one clockwise from where it came; straight back is the last resort
    turn = F.when(turn < 1e-12, F.lit(7.0)).otherwise(turn)
    return _meet(coming, going, ["_g", "vx", "vy"]).groupBy("me").agg(F.min_by("on", turn).alias("on"))


def _traced(follow: DataFrame, paths: list[str]) -> DataFrame:
    """``me, head, place``: pieces with one of their ring and their order, from it on."""
    spark, step, seen = follow.sparkSession, 1, None
    rows = kept(follow.select("me", "on", F.col("me").alias("head"), F.lit(0).cast("long").alias("far")), "traced", paths)
    while True:
        after = rows.select(F.col("me").alias("on"), F.col("on").alias("_on"), F.col("head").alias("_head"), F.col("far").alias("_far"))
        less = F.col("_head") < F.col("head")
        rows = kept(
            _meet(rows, after, ["on"]).select(
                "me", F.col("_on").alias("on"), F.when(less, F.col("_head")).otherwise(F.col("head")).alias("head"),
                F.when(less, F.col("_far") + step).otherwise(F.col("far")).alias("far"),
            ),
            "traced", paths,
        )
        tables.delete(spark, paths.pop(-2))
        step *= 2
        now = rows.agg(F.sum(F.xxhash64("head").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            break
        seen = now
    # what is far before the first one comes soon after it
    return rows.select("me", "head", F.when(F.col("far") > 0, -F.col("far")).otherwise(F.lit(-(2**62))).alias("place"))


def _without_straights(points: Column, digits: int) -> Column:
    """A ring without the points that lie on the line between their neighbours."""
    n = F.size(points)
    at = lambda i: F.element_at(points, (F.pmod(i, n) + 1).cast("int"))

    def bends(p: Column, i: Column) -> Column:
        a, b = at(i - 1), at(i + 1)
        ux, uy, wx, wy = p["x"] - a["x"], p["y"] - a["y"], b["x"] - p["x"], b["y"] - p["y"]
        cross = ux * wy - uy * wx
        return cross * cross > 4 * F.lit(10.0 ** (-2 * digits)) * ((ux + wx) * (ux + wx) + (uy + wy) * (uy + wy))

    return F.filter(points, bends)


def _from_least(ring: Column) -> Column:
    """The ring from its least point on."""
    first = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, first, F.size(ring)), F.slice(ring, F.lit(1), first - 1))


def _fine(sides: DataFrame) -> float:
    """A cell of the mean edge; no edge crosses more than about five hundred."""
    long = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    mean, most = sides.agg(F.avg(long), F.max(long)).first()
    return max(mean, most / 256) if mean else CELL


def _united(members: DataFrame, rings: str, digits: int, cell: float | None, overlap: bool) -> DataFrame:
    """``_g, rings``: what the shapes ``_s`` of each group cover; groups that cover nothing are missing.

    ``cell`` None is made fit. With ``overlap``, cells within a shape are looked for.
    """
    spark, paths = members.sparkSession, []
    named = members.select(F.struct("_g", "_s").alias("_k"), "_r")
    sides = edges(named, "_k", "_r").select("_k._g", "_k._s", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in ENDS])
    sides = kept(sides.where("x1 <> x2 or y1 <> y2").withColumn("_id", F.monotonically_increasing_id()), "sides", paths)
    wide = cell = cell or _fine(sides)
    placed = kept(_placed(sides, digits, cell), "placed", paths)
    if overlap:
        placed, cell = _opened(sides, placed, digits, cell, paths)
        # an edge comes to the union's border, or leaves it, where it meets another in these cells
        pieces = _split(_meet(sides, placed.select("_id"), ["_id"], "left_semi"), placed, digits).withColumns(_tile(cell))
        pieces = _meet(pieces, placed.select(*TILE), TILE, "left_semi")
    else:
        pieces = _split(sides, placed, digits).withColumns(_tile(cell))
    pieces = kept(pieces.withColumn("_p", F.monotonically_increasing_id()), "pieces", paths)
    borders = kept(_borders(pieces, sides, placed, wide).withColumn("_b", F.monotonically_increasing_id()), "borders", paths)
    while len(paths) > 1:
        tables.delete(spark, paths.pop(0))
    traced = _meet(_traced(_next(borders), paths), borders.select("_g", F.col("_b").alias("me"), F.col("x1").alias("x"), F.col("y1").alias("y")), ["me"])
    points = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("x", "y").alias("p")))), lambda r: r["p"])
    ring = traced.groupBy("_g", "head").agg(points.alias("r")).select("_g", _without_straights(F.col("r"), digits).alias("r"))
    ring = ring.where(F.size("r") > 2).select("_g", _from_least(F.col("r")).alias("r"))
    whole = kept(ring.groupBy("_g").agg(F.array_sort(F.collect_list("r")).alias(rings)), "united")
    for path in paths:
        tables.delete(spark, path)
    return whole


def _drawn(shapes: DataFrame, group: str, shape: str, rings: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``_v, _f`` of each group's shapes, without copies, and ``_f, _r`` of what is drawn.

    A figure ``_f`` stands for all shapes of the same rings, by the SHA-256 of
    their text; rows of one group and shape are one shape. Null, for a shape
    without rings, is no figure. The third one is all groups' ``_v``.
    """
    rows = shapes.select(
        F.struct(F.col(group).alias("g")).alias("_v"), F.struct(F.col(shape).alias("s")).alias("_w"), F.col(rings).alias("_r"),
        F.unhex(F.sha2(F.to_json(rings), 256)).alias("_d"),
    )
    lists = rows.groupBy("_v", "_w").agg(F.sort_array(F.collect_list("_d")).alias("_l")).select("_v", "_l")
    lists = kept(lists, "lists")
    figures = kept(lists.select("_l").where(F.size("_l") > 0).distinct().withColumn("_f", F.monotonically_increasing_id()), "figures")
    rings_of = rows.where("_r is not null").select("_d", "_r").distinct()
    parts = figures.select("_f", F.explode("_l").alias("_d")).join(rings_of, "_d").select("_f", "_r")
    return lists.join(figures, "_l", "left").select("_v", "_f"), kept(parts, "drawings"), lists.select("_v")


def _spread(members: DataFrame) -> DataFrame:
    n = max(members.sparkSession.sparkContext.defaultParallelism, -(-members.count() // SHARE))
    return members.repartition(n)


def canonical(shapes: DataFrame, group: str, shape: str, rings: str = "rings", digits: int = DIGITS, cell: float | None = None) -> DataFrame:
    """``group, rings``: the union of each group's shapes as rings that neither cross nor overlap.

    Outer rings run counter-clockwise and holes clockwise, each from its least
    point; points on straight lines are left out; rings are in order. So groups
    that cover the same area give equal values, however they were drawn. Shapes
    that touch in a point stay rings of their own. A group that covers nothing
    (null, empty or flat rings) has null rings. Coordinates are rounded to
    ``digits``; null groups are a group.
    """
    of, drawings, every = _drawn(shapes, group, shape, rings)
    groups = kept(every.distinct().withColumn("_g", F.monotonically_increasing_id()), "groups")
    members = of.where("_f is not null").distinct().join(groups, "_v").join(drawings, "_f").select("_g", F.col("_f").alias("_s"), "_r")
    whole = _united(_spread(kept(members, "members")), rings, digits, cell, True)
    return groups.join(whole, "_g", "left").select(F.col("_v.g").alias(group), rings)


def make_valid(shapes: DataFrame, key: str, rings: str = "rings", digits: int = DIGITS, cell: float = CELL) -> DataFrame:
    """``key, rings``: each shape's area in canonical form; see ``canonical``. Shapes drawn alike are made valid once."""
    of, drawings, _ = _drawn(shapes.withColumn("_shape", F.lit(0)), key, "_shape", rings)
    whole = _united(_spread(drawings.select(F.col("_f").alias("_g"), F.col("_f").alias("_s"), "_r")), rings, digits, cell, False)
    return of.join(whole.withColumnRenamed("_g", "_f"), "_f", "left").select(F.col("_v.g").alias(key), rings)


def dissolve(shapes: DataFrame, group: str, key: str, rings: str = "rings", digits: int = DIGITS, cell: float | None = None) -> DataFrame:
    """``group, rings``: the union of the shapes of each group; edges that two of them share cancel."""
    return canonical(shapes, group, key, rings, digits, cell)


def dissolved_cover(shapes: DataFrame, group: str, key: str, height: int, width: int, rings: str = "rings", digits: int = DIGITS) -> DataFrame:
    """``group, row, col``: the pixels whose centre the union of each group's shapes holds.

    As corners of unions are rounded, pixels whose centre lies on a border, or
    next to it, are held against the shapes themselves.
    """
    union = dissolve(shapes, group, key, rings, digits).select(F.struct(F.col(group).alias("g")).alias("_v"), F.col(rings).alias("_r"))
    close = kept(near(union, "_v", height, width, 10 * 10.0**-digits, "_r").withColumn("_c", F.expr(f"col div {BLOCK}")), "close")
    own = shapes.select(F.struct(F.struct(F.col(group).alias("g")).alias("v"), F.col(key).alias("k")).alias("_k"), F.col(rings).alias("_r"))
    first, last = F.ceil(F.col("a") - 0.5), F.ceil(F.col("b") - 0.5) - 1
    across = spans(edges(own, "_k", "_r"), "_k", height).select(F.col("_k.v").alias("_v"), "row", first.alias("first"), last.alias("last")).distinct()
    across = across.where("first <= last").select("*", _steps(F.col("first") / BLOCK, F.col("last") / BLOCK).alias("_c"))
    held = _meet(close, across, ["_v", "row", "_c"]).where("col between first and last").select("_v", "row", "col").distinct()
    rest = _meet(cover(union, "_v", height, width, rings="_r"), close, ["_v", "row", "col"], "left_anti")
    return rest.select("_v", "row", "col").unionByName(held).select(F.col("_v.g").alias(group), "row", "col")


def area(rings: str | Column = "rings") -> Column:
    """The area that canonical rings cover; holes run the other way and count less. Null for null rings."""

    def of(ring: Column) -> Column:
        after = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        return F.aggregate(F.zip_with(ring, after, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2), F.lit(0.0), lambda s, x: s + x)

    return F.aggregate(F.transform(rings, of), F.lit(0.0), lambda s, x: s + x)


def polygon_uuid(rings: str | Column = "rings") -> Column:
    """A UUID of canonical rings: the same for the same area, however it was drawn; null rings have none."""
    return hash_uuid(F.sha1(F.to_json(rings)))
