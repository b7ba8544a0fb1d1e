"""Excel, GeoPackage, CSV and JSON: files written here by hand or by the standard library."""

import os
import sqlite3
import struct
import zipfile
from contextlib import closing

import pytest
from pyspark.sql import functions as F

from talusgrid.sources import excel, geopackage, tables

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(path):
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>last</t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>3.5</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="3"><c r="B3"><v>7</v></c></row><row r="4"/>'
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{links}"><sheets><sheet name="a" sheetId="1" r:id="rId7"/><sheet name="b" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId8" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="worksheets/first.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>pk</t></si><si><t>value</t></si><si><r><t>00</t></r><r><t>12</t></r></si></sst>')
        z.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{sheet}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(f"{tmp_path}/a.xlsx")
    excel.register(spark)
    df = spark.read.format("xlsx").load(f"{tmp_path}/a.xlsx")
    assert df.columns == ["pk", "value", "column_2", "last"]
    assert [tuple(r) for r in df.collect()] == [("0012", "3.5", None, "true"), (None, "7", None, None), (None, None, None, None)]


def blob(wkb, flags=1):
    return b"GP\0" + bytes([flags]) + struct.pack("<i", 2056) + bytes(geopackage.BOUNDS[flags >> 1 & 7]) + wkb


def line(*points, order="<", kind=2):
    flat = [v for p in points for v in p]
    return struct.pack(f"{order}BII{len(flat)}d", order == "<", kind, len(points), *flat)


def package(path):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('zones', 'geom'), ('others', 'g')")
    db.execute('CREATE TABLE zones (fid INTEGER PRIMARY KEY, name TEXT, "a size" REAL, n MEDIUMINT, geom BLOB)')
    db.execute("CREATE TABLE others (fid INTEGER PRIMARY KEY, g BLOB)")
    a, b = [(0.0, 1.0), (2.0, 3.0)], [(4.0, 5.0), (6.0, 7.0), (8.0, 9.0)]
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    shapes = {
        3: (blob(line(*a)), [a]),
        4: (blob(struct.pack("<BII", 1, 5, 2) + line(*a) + line(*b, order=">"), flags=3), [a, b]),
        5: (blob(struct.pack("<BII", 1, 3, 1) + line(*ring)[5:]), [ring]),
        6: (blob(line(*[(*p, 9.0) for p in b], kind=1002)), [b]),
        7: (None, None),
        8: (blob(b"", flags=0x11), None),
        9: (blob(struct.pack(">BIdd", 0, 1, 3.0, 4.0)), [[(3.0, 4.0)]]),
        50_001: (blob(struct.pack("<BII", 1, 6, 1) + struct.pack("<BII", 1, 3, 1) + line(*ring)[5:]), [ring]),
    }
    for fid, (raw, _) in shapes.items():
        db.execute("INSERT INTO zones VALUES (?, ?, ?, ?, ?)", (fid, f"é{fid}" if fid != 7 else None, fid / 2, fid, raw))
    db.commit()
    db.close()
    return {fid: parts for fid, (_, parts) in shapes.items()}


def test_geopackage(spark, tmp_path):
    want = package(f"{tmp_path}/z.gpkg")
    geopackage.register(spark)
    df = spark.read.format("geopackage").load(f"{tmp_path}/z.gpkg")
    assert dict(df.dtypes) == {"feature_id": "bigint", "name": "string", "a size": "double", "n": "bigint", "parts": "array<array<struct<x:double,y:double>>>"}
    got = {r.feature_id: r for r in df.collect()}
    assert {k: r.parts and [[tuple(p) for p in part] for part in r.parts] for k, r in got.items()} == want
    assert (got[3].name, got[7].name, got[3]["a size"], got[9].n) == ("é3", None, 1.5, 9)
    assert df.rdd.getNumPartitions() == 1
    assert spark.read.format("geopackage").option("layer", "others").load(f"{tmp_path}/z.gpkg").count() == 0


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("007", 1, None), ("8", None, "x, \"y\"")], "pk string, n int, t string")
    tables.write_csv(df, f"{tmp_path}/c")
    back = tables.read_csv(spark, f"{tmp_path}/c")
    assert back.dtypes == [("pk", "string"), ("n", "int"), ("t", "string")]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tables.write_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/j").collect())) == sorted(map(tuple, df.collect()))
    assert "null" in "".join(r.value for r in spark.read.text(f"{tmp_path}/j").collect())


def test_results_are_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.made_once(spark, f"{tmp_path}/once", make).count() == 3
    assert len(calls) == 1


def test_geopackage_of_spread_and_of_text_keys(spark, tmp_path):
    """Partitions follow the rows: ids far apart make no more of them, and a key may be text."""
    far, named = f"{tmp_path}/far.gpkg", f"{tmp_path}/named.gpkg"
    for path, key, keys in ((far, "INTEGER", [1, 10**12]), (named, "TEXT", ["b", "a"])):
        db = sqlite3.connect(path)
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom')")
        db.execute(f"CREATE TABLE t (id {key} PRIMARY KEY, geom BLOB, n INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, NULL, ?)", [(k, n) for n, k in enumerate(keys)])
        db.commit()
        db.close()
        geopackage.register(spark)
        df = spark.read.format("geopackage").load(path)
        assert df.rdd.getNumPartitions() == 1
        assert sorted((r.n, r.feature_id) for r in df.collect()) == list(enumerate(keys))


def test_geopackage_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geopackage, "EACH", 3)
    path = f"{tmp_path}/r.gpkg"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom')")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, geom BLOB)")
    ids = [-5, 0, 1, 7, 900, 901, 5000, 10**9, 10**15]
    db.executemany("INSERT INTO t VALUES (?, NULL)", [(k,) for k in ids])
    db.commit()
    db.close()
    reader = geopackage._Reader(path, None, ["long"])
    parts = reader.partitions()
    assert [(p.low, p.high) for p in parts] == [(-5, 7), (7, 5000), (5000, None)]
    assert [r[0] for p in parts for r in reader.read(p)] == ids


@pytest.mark.parametrize("shape", ["MULTILINESTRING", "POLYGON"])
def test_geopackages_written_and_read(spark, tmp_path, shape):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.5, 3.25), (0.0, 0.0)]
    rows = [(k, f"n{k}" if k % 3 else None, k / 4, k % 2 == 0, None if k == 5 else [] if k == 6 else [ring, ring[:2]][: 1 + k % 2]) for k in range(20)]
    kind = "id long, name string, h double, ok boolean, parts array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame(rows, kind).repartition(3, "id")
    folder = f"{tmp_path}/out"
    made = geopackage.write(df, folder, "zones", "id", 2056, shape)
    assert sum(r.n_features for r in made.collect()) == 20
    again = geopackage.write(df, folder, "zones", "id", 2056, shape)  # written over, not beside
    assert sorted(os.listdir(folder)) == sorted(r.file for r in again.collect())
    geopackage.register(spark)
    got = spark.read.format("geopackage").option("layer", "zones").load(folder)
    assert got.columns == ["feature_id", "name", "h", "ok", "parts"]
    read = {r.feature_id: (r.name, r.h, r.ok, r.parts and [[tuple(p) for p in line] for line in r.parts]) for r in got.collect()}
    assert read == {k: (name, h, ok, parts or None) for k, name, h, ok, parts in rows}
    with closing(sqlite3.connect(f"{folder}/{made.first().file}")) as db:
        assert db.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
        assert db.execute("SELECT table_name, srs_id FROM gpkg_contents").fetchall() == [("zones", 2056)]
    empty = geopackage.write(df.limit(0), f"{tmp_path}/none", "zones", "id")
    assert sum(r.n_features for r in empty.collect()) == 0
    with pytest.raises(ValueError):
        geopackage.write(df.withColumn("h", F.array("h")), folder, "zones", "id")
