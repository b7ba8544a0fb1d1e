import os

import pytest

from talusgrid.llm import common


def test_tables_are_deleted_once_their_results_are_kept(spark):
    common.clear(spark)
    first = common.table(spark.range(5), "first")
    second = common.table(first.selectExpr("id + 1 AS id"), "second")
    paths = [p.removeprefix("file:") for p in common._WRITTEN]
    common.clear(spark, keep=1)
    assert not os.path.exists(os.path.normpath(paths[0])) and os.path.exists(os.path.normpath(paths[1]))
    assert second.count() == 5


def test_components_of_chains_stars_and_nothing(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(7, 7), (130, 100), (100, 130)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in common.components(df).collect()}
    assert got == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 131)}
    assert common.components(df.limit(0)).count() == 0


class Nothing:
    """Stands for a context without a checkpoint folder, and for what it returns."""

    master = "spark://host:7077"

    def __getattr__(self, name):
        return {"isDefined": lambda: False}.get(name, self)

    def __call__(self, *_):
        return self


def test_a_cluster_without_a_shared_folder_is_told_so(spark):
    class Session:
        conf = {}  # noqa: RUF012
        sparkContext = Nothing()  # noqa: N815

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session)
    assert common.shared_dir(spark) == common.shared_dir(spark)
