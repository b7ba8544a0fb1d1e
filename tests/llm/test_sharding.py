import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from talusgrid.llm import queries, sharding
from talusgrid.llm.sharding import Shard


def brute(key, tree):
    """The shard by three draws, a level at a time."""
    held = [s for s in tree if s.weight > 0]

    def draw(names):
        def stretched(name):
            digits = hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13]
            return -math.log((int(digits, 16) + 0.5) / 2**52) / names[name]

        return min(names, key=stretched)

    def weights(rows, name):
        found = defaultdict(float)
        for s in rows:
            found[name(s)] += s.weight
        return found

    region = draw(weights(held, lambda s: s.region))
    held = [s for s in held if s.region == region]
    rack = draw(weights(held, lambda s: f"{region}/{s.rack}"))
    held = [s for s in held if f"{region}/{s.rack}" == rack]
    return int(draw(weights(held, lambda s: f"{rack}/{s.shard}")).rsplit("/", 1)[1])


TREE = [
    Shard("a", "x", 0, 1.0),
    Shard("a", "x", 1, 2.0),
    Shard("a", "y", 2, 0.5),
    Shard("b", "x", 3, 4.0),
    Shard("b", "x", 7, 0.0),
    Shard("c", "z", 9, 1.5),
]


def placed(spark, ids, tree):
    df = spark.createDataFrame([(i, "other") for i in ids], "doc_id long, shard string").repartition(4)
    return {r.doc_id: r.shard for r in sharding.place(df, tree).collect()}


def test_places_against_brute_force(spark):
    ids = [*range(3000), None, -5, 2**62]
    found = placed(spark, ids, TREE)
    assert found == {i: brute("null" if i is None else i, TREE) for i in ids}
    total = sum(s.weight for s in TREE)
    n = Counter(found.values())
    for s in TREE:
        want = len(ids) * s.weight / total
        assert abs(n[s.shard] - want) <= 5 * math.sqrt(want + 1)


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    ids = range(4000)
    before = placed(spark, ids, TREE)
    heavier = [s._replace(weight=3.0) if s.shard == 2 else s for s in TREE]
    after = placed(spark, ids, heavier)
    moved = [i for i in ids if before[i] != after[i]]
    assert moved and all(after[i] in (0, 1, 2) for i in moved)  # region a, the only one whose weight changed
    assert all(after[i] == 2 for i in moved if before[i] in (0, 1))  # within it, into the changed rack
    gone = [s._replace(weight=0.0) if s.shard == 9 else s for s in TREE]
    drained = placed(spark, ids, gone)
    assert all(before[i] == 9 for i in ids if drained[i] != before[i]) and 9 not in drained.values()


@pytest.mark.parametrize("shards", [24, 25, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    ids = range(5000)
    before, after = placed(spark, ids, sharding.layout(shards)), placed(spark, ids, sharding.layout(shards + 1))
    moved = [i for i in ids if before[i] != after[i]]
    assert all(after[i] == shards for i in moved)
    assert abs(len(moved) - 5000 / (shards + 1)) < 5 * math.sqrt(5000 / shards)
    n = Counter(before.values())
    assert set(n) == set(range(shards)) and max(n.values()) < 5000 / shards + 6 * math.sqrt(5000 / shards)


def test_trees_that_make_no_sense(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    for bad in ([Shard("a", "x", 0), Shard("b", "x", 0)], [Shard("a", "x", 0, 0.0)], [Shard("a", "x", 0, -1.0)], []):
        with pytest.raises(ValueError):
            sharding.place(docs, bad)
    with pytest.raises(ValueError):
        sharding.layout(23)
    with pytest.raises(ValueError):
        sharding.layout(25, base=25)


def test_slots_of_hot_shards_are_gapless(spark):
    # one shard holds nearly all rows, most of them equal in every key
    rows = [(0, 7, "t")] * 20_000 + [(k % 3, k % 50, None) for k in range(3000)]
    df = spark.createDataFrame(rows, "shard int, doc_id long, text string").repartition(7)
    out = sharding.slots(df, ["doc_id", "text"])
    by = defaultdict(list)
    for r in out.collect():
        by[r.shard].append((r.slot, r.doc_id))
    assert sum(map(len, by.values())) == len(rows)
    for held in by.values():
        held.sort()
        assert [s for s, _ in held] == list(range(len(held)))
        assert [d for _, d in held] == sorted(d for _, d in held)
    assert out.select("shard").where("false").collect() == []
    assert sharding.slots(df.where("false"), ["doc_id"]).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op13_sharding(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert r.shard == brute(r.doc_id, sharding.layout()) and r.grown_shard in (r.shard, 24)
