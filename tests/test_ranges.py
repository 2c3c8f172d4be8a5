"""Encoded grids in byte ranges against whole files."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import grids
from gridloom.plans import jobs
from gridloom.sources import files, ranges


@pytest.fixture
def folder(tmp_path):
    """Payloads of many lengths (odd ones too), a long header, broken headers, a file without payload, equal names in two folders."""
    rng = random.Random(9)
    head = "#binvox 1\ndim 4 4 4\ntranslate 1 2 3\nscale 2\ndata\n"
    for tile in ("s", "t"):
        (tmp_path / tile).mkdir()
        for k, n in enumerate((0, 1, 2, 7, 64, 1001, 5000)):
            (tmp_path / tile / f"g{k}.obj_4.binvox").write_bytes(head.encode() + bytes(rng.randrange(256) for _ in range(n)))
    long = "#binvox 1\n" + "\n" * 9000 + head.split("\n", 1)[1]
    (tmp_path / "t" / "long.obj_4.binvox").write_bytes(long.encode() + b"\x01\x03\x00\x3d")
    (tmp_path / "t" / "bad.binvox").write_bytes(b"#vox\ndata\n\x01\x01")
    (tmp_path / "t" / "none.binvox").write_bytes(head.replace("data\n", "").encode())
    return str(tmp_path)


@pytest.mark.parametrize("size", [2, 7, 64, 1 << 20])
def test_ranges_equal_whole_files(spark, folder, size):
    headed, parts = ranges.scan_grid_ranges(spark, folder + "/t", size)
    whole = grids.headers(files.scan_grids(spark, folder + "/t"))
    shown = ["file_name", "status", "dx", "dy", "dz", "translate", "scale", "payload_at"]
    assert sorted(map(str, headed.select(*shown).collect())) == sorted(map(str, whole.select(*shown).collect()))
    payloads = {r.file_name: bytes(r.payload) for r in whole.where("status = 'ok'").collect()}
    got = {}
    for r in sorted(parts.collect(), key=lambda r: r.first_run):
        name = r.path.rsplit("/", 1)[1]
        assert r.first_run * 2 == len(got.get(name, b"")) and len(r.payload) <= max(2, size - size % 2)
        got[name] = got.get(name, b"") + bytes(r.payload)
    assert got == {n: p for n, p in payloads.items() if p}


@pytest.mark.parametrize(("size", "chunk"), [(6, 4), (100, 64), (1 << 20, 65_536)])
def test_run_numbers_match(spark, folder, size, chunk):
    _, parts = ranges.scan_grid_ranges(spark, folder + "/t", size)
    runs = grids.decode_runs(parts.select(F.element_at(F.split("path", "/"), -1).alias("file_key"), "first_run", "payload"), chunk)
    whole = grids.headers(files.scan_grids(spark, folder + "/t")).where("status = 'ok'")
    expected = sorted((r.file_name, i, r.payload[2 * i], r.payload[2 * i + 1]) for r in whole.collect() for i in range(len(r.payload) // 2))
    assert sorted(map(tuple, runs.collect())) == expected


def test_job_over_ranges_equals_whole_files(spark, folder):
    for tiles in (False, True):
        at = folder if tiles else folder + "/s"
        row = lambda df: sorted(tuple(r) for r in df.select("obj_key", "ix", "iy", "iz", "x", "y", "z", "voxel_position", *(["tile"] if tiles else [])).collect())  # noqa: B023, E731
        by_range = row(jobs.from_grids(spark, at, tiles=tiles, range_bytes=10))
        assert by_range == row(jobs.from_grids(spark, at, tiles=tiles, range_bytes=None)) and by_range


def test_written_files_are_whole_and_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("t/a b.bin", b"\x00\x01"), ("t/deep/c", b""), ("é#.x", b"xyz")], "path string, content binary").repartition(3)
    for _ in range(2):
        assert files.write_files(rows, str(tmp_path / "out")) == 3
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"t/a b.bin": b"\x00\x01", "t/deep/c": b"", "é#.x": b"xyz"}
    assert files.write_files(rows.limit(0), str(tmp_path / "none")) == 0


def test_headers_are_read_once(spark, folder, monkeypatch):
    """Short headers ask for one pass over leading bytes, a long one for one more; what follows reads neither them nor the folder's list."""
    kept, asked = ranges.with_bytes, []
    monkeypatch.setattr(ranges, "with_bytes", lambda rows: asked.append(1) or kept(rows))
    for tile, passes in (("s", 1), ("t", 2)):
        asked.clear()
        headed = ranges.headers_of_files(ranges.list_files(spark, f"{folder}/{tile}"))
        plan = headed._jdf.queryExecution().executedPlan().toString()
        assert len(asked) == passes and "MapInArrow" not in plan and "binaryFile" not in plan


def test_small_ranges_come_together(spark, folder):
    """Ranges that are read in one batch keep their own bytes."""
    rows = ranges.list_files(spark, folder, tiles=True).withColumns({"start": F.col("length") % 3, "size": F.col("length").cast("long")})
    got = {(r.path, bytes(r.bytes)) for r in ranges.with_bytes(rows).collect()}
    assert got == {(r.path, open("/" + r.path.removeprefix("file:").lstrip("/"), "rb").read()[r.start :]) for r in rows.collect()} and len(got) == 17
