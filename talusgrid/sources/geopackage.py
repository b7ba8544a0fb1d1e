"""GeoPackages as rows: ``spark.read.format("geopackage").load("zones.gpkg")``.

A GeoPackage is an SQLite file. Columns are ``feature_id``, the attributes, and
``parts`` (``ARRAY<ARRAY<STRUCT<x, y>>>``: rings of polygons or lines, null for
none) in place of the geometry. Partitions read disjoint ranges of rows, about
as many in each, however the ids are spread; each task opens the file where it
lies, or a copy of its own if that isn't a local disk. ``option("layer", ...)``
names a table; without it the first is read. A folder stands for all its
``.gpkg`` files, which have the same columns: ``write`` makes one a partition,
as an SQLite file has one writer.
"""

from __future__ import annotations

import sqlite3
import struct
import tempfile
from collections.abc import Iterator
from contextlib import closing, contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .geotiff import opened

#: Features of a partition.
EACH = 20_000
#: Fixed values of the format: bytes of a header's bounds by their kind.
BOUNDS = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


@contextmanager
def _database(path: str) -> Iterator[sqlite3.Connection]:
    system, inner = opened(path)
    if isinstance(system, fs.LocalFileSystem):
        with closing(sqlite3.connect(f"file:{inner}?mode=ro", uri=True)) as db:
            yield db
        return
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as copy:  # this task's own
        with system.open_input_file(inner) as f:
            while block := f.read(1 << 22):
                copy.write(block)
        copy.flush()
        with closing(sqlite3.connect(f"file:{copy.name}?mode=ro", uri=True)) as db:
            yield db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _layer(db: sqlite3.Connection, layer: str | None) -> tuple[str, str, list[tuple[str, str]], str]:
    """Table, geometry column, ``(name, type)`` of the attributes and the key."""
    found = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    table, geometry = next((t, c) for t, c in found if layer in (None, t))
    columns = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    key = next((c[1] for c in columns if c[5]), "rowid")
    return table, geometry, [(c[1], c[2]) for c in columns if c[1] not in (geometry, key)], key


def _type(declared: str) -> str:
    kind = declared.upper()
    if "BOOL" in kind:
        return "boolean"
    if "INT" in kind:
        return "long"
    return "double" if kind.startswith(("REAL", "DOUBLE", "FLOAT")) else "binary" if kind.startswith("BLOB") else "string"


def _points(raw: bytes, at: int, order: str, n: int, width: int) -> tuple[list, int]:
    flat = struct.unpack_from(f"{order}{n * width}d", raw, at)
    return [(flat[width * k], flat[width * k + 1]) for k in range(n)], at + 8 * n * width


def _wkb(raw: bytes, at: int) -> tuple[list, int]:
    """Lines or rings of a well-known binary geometry and where it ends."""
    order = "<" if raw[at] else ">"
    (kind,) = struct.unpack_from(f"{order}I", raw, at + 1)
    at += 5
    extra = bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000 % 10 if kind < 4000 else 0]
    kind, width = (kind & 0xFFFF) % 1000, 2 + extra
    if kind == 1:
        points, at = _points(raw, at, order, 1, width)
        return [points], at
    (n,) = struct.unpack_from(f"{order}I", raw, at)
    at += 4
    if kind == 2:
        points, at = _points(raw, at, order, n, width)
        return [points], at
    parts = []
    for _ in range(n):
        if kind == 3:
            (size,) = struct.unpack_from(f"{order}I", raw, at)
            points, at = _points(raw, at + 4, order, size, width)
            parts.append(points)
        else:
            own, at = _wkb(raw, at)
            parts += own
    return parts, at


def geometry(raw: bytes | None) -> list | None:
    """Lines or rings of a GeoPackage's binary geometry; null and empty ones have none."""
    if not raw or raw[3] & 0x10:
        return None
    return _wkb(raw, 8 + BOUNDS[raw[3] >> 1 & 7])[0] or None


def _files(path: str) -> list[str]:
    """The path itself or, of a folder, its packages in order of name."""
    system, inner = opened(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".gpkg"))
    if not found:
        raise FileNotFoundError(f"no .gpkg file in {path}")
    return [f"{path.rstrip('/')}/{name}" for name in found]


class _Range(InputPartition):
    """Rows of a file from one SQLite row number to before another (None: to the end)."""

    def __init__(self, path: str, low: int, high: int | None):
        self.path, self.low, self.high = path, low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: str | None, kinds: list[str]):
        self.path, self.layer, self.kinds = path, layer, kinds

    def partitions(self) -> list[InputPartition]:
        return [part for path in _files(self.path) for part in self._ranges(path)]

    def _ranges(self, path: str) -> Iterator[_Range]:
        with _database(path) as db:
            table = _quoted(_layer(db, self.layer)[0])
            first = db.execute(f"SELECT min(rowid) FROM {table}").fetchone()[0]
            low = 0 if first is None else first
            while low is not None:  # steps over the rows that are there, not over the numbers between them
                after = db.execute(f"SELECT rowid FROM {table} WHERE rowid >= ? ORDER BY rowid LIMIT 1 OFFSET ?", (low, EACH)).fetchone()
                high = after[0] if after else None
                yield _Range(path, low, high)
                low = high

    def read(self, partition: _Range) -> Iterator[tuple]:
        with _database(partition.path) as db:
            table, column, attributes, key = _layer(db, self.layer)
            names = ", ".join(_quoted(n) for n in (key, *[a for a, _ in attributes], column))
            end = "" if partition.high is None else f" AND rowid < {partition.high}"
            rows = db.execute(f"SELECT {names} FROM {_quoted(table)} WHERE rowid >= ?{end} ORDER BY rowid", (partition.low,))
            cast = {"boolean": bool, "double": float, "long": int, "string": str}
            for *values, shape in rows:
                yield (*[v if v is None else cast.get(k, bytes)(v) for v, k in zip(values, self.kinds, strict=True)], geometry(shape))


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _columns(self) -> list[tuple[str, str]]:
        """``feature_id``, which is text where the key is, and the attributes."""
        with _database(_files(self.options["path"])[0]) as db:
            table, _, attributes, key = _layer(db, self.options.get("layer"))
            declared = {c[1]: c[2] for c in db.execute(f"PRAGMA table_info({_quoted(table)})")}
        return [("feature_id", _type(declared.get(key, "INTEGER"))), *[(n, _type(t)) for n, t in attributes]]

    def schema(self) -> str:
        names = "".join(f"`{n}` {t}, " for n, t in self._columns())
        return f"{names}parts array<array<struct<x:double,y:double>>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("layer"), [t for _, t in self._columns()])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackage)


#: Fixed values of the format: names of its column types, its mark and version, and the codes of shapes.
TYPES = {"boolean": "BOOLEAN", "int": "INTEGER", "bigint": "INTEGER", "double": "DOUBLE", "string": "TEXT", "binary": "BLOB"}
MARK, VERSION = 0x47504B47, 10300
SHAPES = {"MULTILINESTRING": 5, "POLYGON": 3}
_TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL,
  organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '',
  last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL,
  srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""


def blob(parts: list | None, srs: int, shape: str) -> bytes | None:
    """A geometry of lines (MULTILINESTRING) or of one outline's rings (POLYGON); null has none, no parts are empty."""
    if parts is None:
        return None
    out = [b"GP\0", struct.pack("<Bi", 1 if parts else 0x11, srs), struct.pack("<BII", 1, SHAPES[shape], len(parts))]
    for points in parts:
        if shape == "MULTILINESTRING":
            out.append(struct.pack("<BI", 1, 2))
        out.append(struct.pack("<I", len(points)))
        out.append(struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in (p["x"], p["y"])]))
    return b"".join(out)


def write(df: DataFrame, folder: str, layer: str, key: str, srs: int = 2056, shape: str = "MULTILINESTRING", parts: str = "parts") -> DataFrame:
    """``df`` as GeoPackages ``part-<n>.gpkg`` in ``folder``, one a partition; ``file, n_features`` of each.

    ``key`` holds whole numbers, none twice in a partition; ``parts`` the
    geometry; other columns are attributes. A task makes its file beside the
    others under a name of its own and then renames it, so a task that runs
    twice leaves one whole file. A partition without rows writes an empty layer.
    Columns of other types than TYPES has, and shapes that SHAPES lacks, raise
    ValueError.
    """
    names = [c for c in df.columns if c not in (key, parts)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    unknown = [c for c in names if kinds[c] not in TYPES]
    if unknown or shape not in SHAPES:
        raise ValueError(f"can't be written: {', '.join(unknown) or shape}")
    system, inner = opened(folder)
    system.create_dir(inner, recursive=True)
    columns = "".join(f", {_quoted(c)} {TYPES[kinds[c]]}" for c in names)
    marks = ", ".join("?" * (len(names) + 2))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        to, inner = opened(folder)
        name, n = f"part-{task.partitionId():05d}.gpkg", 0
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as own:
            with closing(sqlite3.connect(own.name)) as db:
                db.executescript(f"PRAGMA application_id = {MARK}; PRAGMA user_version = {VERSION};" + _TABLES)
                db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
                db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
                db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (layer, shape, srs))
                db.execute(f"CREATE TABLE {_quoted(layer)} ({_quoted(key)} INTEGER PRIMARY KEY, geom {shape}{columns})")
                for batch in batches:
                    rows = ((r[key], blob(r[parts], srs, shape), *[r[c] for c in names]) for r in batch.to_pylist())
                    db.executemany(f"INSERT INTO {_quoted(layer)} VALUES ({marks})", rows)
                    n += batch.num_rows
                db.commit()
            draft = f"{inner}/_{name}.{task.taskAttemptId()}"
            with open(own.name, "rb") as made, to.open_output_stream(draft) as out:
                while block := made.read(1 << 22):
                    out.write(block)
            to.move(draft, f"{inner}/{name}")
        yield pa.RecordBatch.from_pydict({"file": [name], "n_features": [n]})

    written = df.mapInArrow(save, "file string, n_features long").collect()  # a row a file
    return df.sparkSession.createDataFrame(written, "file string, n_features long")
