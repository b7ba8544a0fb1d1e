import io
import zipfile

import pytest

from talusgrid.llm import warc

PAGES = [(k, f"http://x/{k}", t) for k, t in enumerate([None, "", "a", "b" * 5000, "a", "é\r\n\r\nx", "a", "", "b" * 5000])]


def want(pages, least):
    out = {}
    for k, _, t in pages:
        data = (t or "").encode()
        same = [j for j, _, u in pages if (u or "").encode() == data and len(data) >= least]
        refers = min(same) if same and min(same) != k else None
        out[k] = (len(data), warc.digest_of(data), "revisit" if refers is not None else "response", refers, data)
    return out


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, sha string").repartition(3)
    folder = f"file://{tmp_path}/w"
    packages = warc.write_packages(df, folder, least_bytes=least, package=4000)
    rows = warc.read_packages(packages, folder, run_length=2).collect()
    expect = want(PAGES, least)
    assert len(rows) == len(PAGES)
    for r in rows:
        n, digest, kind, refers, data = expect[r.page_id]
        assert (r.payload_bytes, r.digest, r.record_type, r.refers_to) == (n, digest, kind, refers)
        assert r.payload == (data if kind == "response" else None)
        assert r.url == f"http://x/{r.page_id}"


def test_no_rows_null_and_repeated_ids(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame([(None, None, "q"), (1, "u\n", "q"), (1, "u", "q")], "page_id long, url string, html string")
    rows = warc.read_packages(warc.write_packages(df, folder), folder).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows) == [
        ("1", "response", None), ("1", "response", None), ("None", "revisit", 1),
    ]
    assert warc.read_packages(warc.write_packages(df.limit(0), folder), folder).count() == 0


@pytest.mark.parametrize("big", [warc.MARK32, 10, 200])
def test_zip64_forms(big):
    out = io.BytesIO()
    z = warc.ZipWriter(out, big=big)
    data = {"a": b"x" * 5, "dir/b": b"y" * 300, "c": b""}
    for name, body in data.items():
        z.add(name, [body[:3], body[3:]])
    z.close()
    raw = out.getvalue()
    found = warc.members(io.BytesIO(raw), len(raw))
    assert {n: raw[a : a + k] for n, (a, k) in found.items()} == data
    with zipfile.ZipFile(io.BytesIO(raw)) as other:
        assert {n: other.read(n) for n in other.namelist()} == data
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"nothing"), 7)
