"""Many rasters of one grid read together: a wide row for each pixel, without a join.

Each partition is a run of lines. Its task reads the same window of every
file, block by block, so it holds one block of each feature and no more. Which
features are read is decided by naming them; conditions on ``row`` and ``col``
and a window decide which blocks are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from .geotiff import Meta, _Lines, _meta, _tags, blocks, bounds, layout, opened

#: Values of all features together that a batch of rows holds at most, about.
BATCH_VALUES = 1 << 22
#: Lines that a partition reads at least.
LINES = 256


def described(path: str, name: str) -> tuple[Meta, tuple[int, int]]:
    """A feature's grid and its blocks' lines and columns; FileNotFoundError names feature and file."""
    system, inner = opened(path)
    try:
        with system.open_input_file(inner) as f:
            tags = _tags(f)[1]
    except FileNotFoundError:
        raise FileNotFoundError(f"feature {name}: no file {path}") from None
    return _meta(tags), layout(tags)[:2]


def check(paths: dict[str, str], shape: tuple[int, int] | None = None) -> tuple[Meta, int, int]:
    """The common grid, and lines and columns of the largest blocks; only heads of files are read.

    Without ``shape`` the first feature's is expected of all. A file that isn't
    there raises FileNotFoundError, one of another size ValueError, by name.
    """
    if not paths:
        raise ValueError("no features are named")
    found = {name: described(path, name) for name, path in paths.items()}
    first = next(iter(found.values()))[0]
    want = shape or (first.height, first.width)
    for name, (meta, _) in found.items():
        if (meta.height, meta.width) != want:
            raise ValueError(f"feature {name} has {meta.height} x {meta.width} pixels, not {want[0]} x {want[1]}")
    return first, max(b[0] for _, b in found.values()), max(b[1] for _, b in found.values())


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["features"])
        self.only_valid = options.get("valid") == "only"
        self.mask = options.get("valid") == "mask"
        shape = tuple(int(x) for x in options["shape"].split(",")) if options.get("shape") else None
        meta, self.lines, self.cols = check(self.paths, shape)
        self.window = [0, meta.height, 0, meta.width]
        if options.get("window"):
            row, col, rows, cols = (int(x) for x in options["window"].split(","))
            self.window = [row, max(row, min(meta.height, row + rows)), col, max(col, min(meta.width, col + cols))]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.window, rest = bounds(filters, self.window)
        yield from rest

    def partitions(self) -> list[InputPartition]:
        first, last, left, right = self.window
        each = self.lines * -(-LINES // self.lines)
        starts = range(first // each * each, last, each) if right > left else ()
        return [_Lines(max(at, first), min(at + each, last)) for at in starts] or [_Lines(first, first)]

    def _windows(self, partition: _Lines) -> Iterator[tuple[int, int, int, int]]:
        """Parts of the partition that are whole blocks where possible."""
        left, right = self.window[2:]
        for r in range(partition.first // self.lines * self.lines, partition.last, self.lines):
            for c in range(left // self.cols * self.cols, right, self.cols):
                yield max(r, partition.first), min(r + self.lines, partition.last), max(c, left), min(c + self.cols, right)

    def read(self, partition: _Lines) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        files = {}
        try:
            for name, path in self.paths.items():
                system, inner = opened(path)
                f = system.open_input_file(inner)
                files[name] = (f, *_tags(f))
            for r0, r1, c0, c1 in self._windows(partition):
                yield from self._rows(files, r0, r1, c0, c1)
        finally:
            for f, *_ in files.values():
                f.close()

    def _rows(self, files: dict, r0: int, r1: int, c0: int, c1: int) -> Iterator[pa.RecordBatch]:
        valid, made = np.ones((r1 - r0, c1 - c0), bool), {}
        for name, (f, order, tags) in files.items():
            values = np.full(valid.shape, np.nan)
            for top, left, part, gone in blocks(f, order, tags, r0, r1, c0, c1):
                values[top - r0 : top - r0 + part.shape[0], left - c0 : left - c0 + part.shape[1]] = np.where(gone, np.nan, part)
            valid &= np.isfinite(values)
            if not self.mask:  # for the mask alone one feature is held at a time
                made[name] = values
        rows, cols = np.mgrid[r0:r1, c0:c1].astype("i4")
        keep = np.flatnonzero(valid.ravel()) if self.only_valid else np.arange(valid.size)
        step = max(1, BATCH_VALUES // (len(made) + 2))
        for at in range(0, len(keep), step):
            which = keep[at : at + step]
            columns = [pa.array(rows.ravel()[which]), pa.array(cols.ravel()[which])]
            for values in made.values():
                held = values.ravel()[which]
                columns.append(pa.array(held, mask=np.isnan(held)))
            if self.mask:
                columns.append(pa.array(valid.ravel()[which]))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "col", *(made or ["valid"])])


class FeatureCubeSource(DataSource):
    """Options: ``features`` (JSON of name to path), ``valid`` (only, mask), ``shape`` and ``window``."""

    @classmethod
    def name(cls) -> str:
        return "feature_cube"

    def schema(self) -> str:
        if self.options.get("valid") == "mask":
            return "row int, col int, valid boolean"
        names = json.loads(self.options["features"])
        return ", ".join(["row int", "col int", *(f"`{n}` double" for n in names)])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, paths: dict[str, str], valid: str | None, shape: tuple[int, int] | None, window: tuple[int, int, int, int] | None) -> DataFrame:
    check(paths, shape)  # by name, before Spark wraps the error
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureCubeSource)
    reader = spark.read.format("feature_cube").option("features", json.dumps(paths))
    for option, given in (("valid", valid), ("shape", shape), ("window", window)):
        if given is not None:
            reader = reader.option(option, given if isinstance(given, str) else ",".join(map(str, given)))
    return reader.load()


def feature_cube(
    spark: SparkSession,
    paths: dict[str, str],
    only_valid: bool = False,
    shape: tuple[int, int] | None = None,
    window: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """``row, col`` and a column for each feature of ``paths`` (name to GeoTIFF), nodata null.

    Infinite values stay. With ``only_valid`` only pixels come at which every
    feature is a finite number. ``shape`` is the expected height and width;
    ``window`` is first row, first column, rows and columns. Raises
    FileNotFoundError for a missing file and ValueError for one of another
    size, each with the feature's name.
    """
    return _load(spark, paths, "only" if only_valid else None, shape, window)


def valid_mask(spark: SparkSession, paths: dict[str, str], shape: tuple[int, int] | None = None) -> DataFrame:
    """``row, col, valid``: whether every feature is finite there; values stay in the task, one feature at a time."""
    return _load(spark, paths, "mask", shape, None)
