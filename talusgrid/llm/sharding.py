"""Shards by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws a number for every child of the subtree it is in, by
a hash of its key and the child's name, stretched by the child's weight, and
takes the least: a child gets its share of the weight, and when one child's
weight changes, rows move to or from that child only. So movement is confined
to the subtrees whose weights change. The draws are DataFrame expressions over
the tree's names, without a shuffle; the slots take one, by range.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered

#: Shards of the regular part of a tree, its regions, and racks in a region.
BASE_SHARDS = 24
REGIONS = 3
RACKS = 2


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int = BASE_SHARDS, base: int = BASE_SHARDS, regions: int = REGIONS, racks: int = RACKS) -> list[Shard]:
    """A tree of ``shards`` equal shards: ``base`` of them dealt evenly, each later one a region of its own.

    A region's weight is the sum of its shards'. Put into a rack that has shards,
    a new one would raise weights on all its path, and the rows that the region
    wins would be drawn over all of it; as a region of its own it is the only
    subtree whose weight changes, so rows move into it and nowhere else.
    """
    if shards < base:
        raise ValueError(f"the regular part alone has {base} shards")
    if base % (regions * racks):
        raise ValueError(f"{base} shards can't be dealt evenly over {regions} regions of {racks} racks")
    each = base // (regions * racks)
    tree = [Shard(f"region{i // (each * racks)}", f"rack{i // each % racks}", i) for i in range(base)]
    return tree + [Shard(f"added{i}", "rack0", i) for i in range(base, shards)]


def _check(tree: list[Shard]) -> None:
    if len({s.shard for s in tree}) < len(tree):
        raise ValueError("a shard is in the tree twice")
    if any(not s.weight >= 0 for s in tree) or not any(s.weight > 0 for s in tree):
        raise ValueError("weights must not be negative, and one at least must be positive")


def _drawn(key: Column, children: Column) -> Column:
    """The place of the child with the least stretched draw; ``children``: array of (name, weight, place)."""

    def stretched(child: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(":"), child["name"]).cast("binary")), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["place"].alias("place"))

    return F.array_min(F.transform(children, stretched))["place"]


def place(docs: DataFrame, tree: list[Shard], id_col: str = "doc_id", column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row in ``column``; nothing but id and tree decides.

    Shards without weight get no rows. Defined cases: a null id is a key of its
    own; rows of one id share a shard; a column of that name is replaced; an
    empty table gives no rows.
    """
    _check(tree)
    held = [s for s in tree if s.weight > 0]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    regions = sorted({s.region for s in held})
    racks = {r: sorted({s.rack for s in held if s.region == r}) for r in regions}

    def child(name: str, weight: float, at: int) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(at).alias("place"))

    def total(**path: str) -> float:
        return sum(s.weight for s in held if all(getattr(s, k) == v for k, v in path.items()))

    top = F.array(*[child(r, total(region=r), i) for i, r in enumerate(regions)])
    second = F.array(
        *[
            F.array(*[child(f"{r}/{k}", total(region=r, rack=k), i) for i, k in enumerate(racks[r])])
            for r in regions
        ]
    )
    third = F.array(
        *[
            F.array(
                *[
                    F.array(*[child(f"{r}/{k}/{s.shard}", s.weight, s.shard) for s in held if (s.region, s.rack) == (r, k)])
                    for k in racks[r]
                ]
            )
            for r in regions
        ]
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (column, "_shard_region", "_shard_rack")]
    rows = docs.select(*kept, _drawn(key, top).alias("_shard_region"))
    rows = rows.withColumn("_shard_rack", _drawn(key, F.get(second, F.col("_shard_region"))))
    return rows.select(*kept, _drawn(key, F.get(F.get(third, F.col("_shard_region")), F.col("_shard_rack"))).alias(column))


def slots(placed: DataFrame, order: list[str], shard_col: str = "shard", column: str = "slot") -> DataFrame:
    """Rows with their place in their shard, gapless from 0, in the order of ``order``, nulls first.

    The rows are sorted by range over all tasks, so no shard is gathered in one;
    the partitions' counts, at most one row a partition and shard, make offsets.
    """
    return numbered(placed, [shard_col], order, column, few=True)
