"""Meshes, sidecars, encoded grids and voxelizers against golden values and brute force."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import grids, mesh, semantics, voxelize, voxels
from gridloom.sources import files


def lines(spark, texts):
    return spark.createDataFrame([("o", t) for t in texts], "obj_key string, line string")


def test_swap_axes(spark):
    given = ["# comment", "v 1.0 2.0 3.0 0.5 0.5 0.5", "vn 0 0 1", "f 1 2 3", "v 1 2", "v a b c"]
    assert [r.line for r in mesh.swap_axes(lines(spark, given)).collect()] == ["# comment", "v 1.0 3.0 2.0 0.5 0.5 0.5", "vn 0 0 1", "f 1 2 3", "v 1 2", "v a c b"]


def test_parse_vertices(spark):
    given = ["v 1 2 3", "v  1.5\t-2e0 .5 9", "v 1 2 3\r", "v\t1 2 3", "v 1d 2 3", "v 0x1p3 1 1", "v 1 2", "vn 1 2 3", "v nan inf -Infinity", "v +1. 2 3", ""]
    rows = [(r.x, r.y, r.z) for r in mesh.parse_vertices(lines(spark, given)).collect()]
    assert rows[:3] == [(1, 2, 3), (1.5, -2.0, 0.5), (1, 2, 3)]
    assert math.isnan(rows[3][0]) and rows[3][1:] == (math.inf, -math.inf) and rows[4] == (1, 2, 3) and len(rows) == 5


def test_bbox_ignores_nan(spark):
    v = spark.createDataFrame([("a", 1.0, math.nan, 3.0), ("a", math.nan, math.nan, 5.0)], "obj_key string, x double, y double, z double")
    r = mesh.object_bbox(v).first()
    assert (r.xmin, r.xmax, r.ymin, r.ymax, r.zmin, r.zmax, r.n_vertices) == (1, 1, None, None, 3, 5, 2)


def test_documents_round_trip(spark):
    box = spark.createDataFrame([("a", 0.0, 4.0, 0.0, 3.0, 0.0, 2.0, "t")], "obj_key string, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double, tile string")
    row = mesh.bbox_documents(box, "tile").first()
    held = json.loads(row.document)
    assert held["global_bbox"]["json_featuretype"] == "translate_model" and held["per_file"]["a"]["translate"] == [0.0, 0.0, 0.0] and held["per_file"]["a"]["obj_filename"] == "a.obj"
    back = mesh.bboxes_of_document(mesh.bbox_documents(box, "tile")).first()
    assert (back.xmax, back.ymax, back.zmax) == (4.0, 3.0, 2.0)
    grid = mesh.grid_mapping(box, 0.5).withColumn("tile", F.lit("t"))
    assert json.loads(mesh.grid_documents(grid, "tile", 0.5).first().document) == {"target_voxel_size": 0.5, "total_files": 1, "grid_distribution": {"8": 1}, "grid_mapping": {"a.obj": 8}}


def test_empty_mapping_falls_back(spark):
    none = spark.createDataFrame([], "obj_key string, grid int")
    keys = spark.createDataFrame([("a",)], "obj_key string")
    assert mesh.grid_lookup(keys, none).first().grid == 256


def test_mesh_and_sidecar_files(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 1 2 3\r\nf 1 1 1\n")
    (tmp_path / "b.OBJ").write_text("v 1 2 3\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.obj").write_text("v 1 2 3\n")
    assert {(r.obj_key, r.line) for r in files.scan_mesh(spark, str(tmp_path)).collect()} == {("a", "v 1 2 3"), ("a", "f 1 1 1")}
    numbered = files.mesh_lines(files.text_files(spark, str(tmp_path), "*.obj"))
    assert [(r.line_no, r.line) for r in numbered.orderBy("line_no").collect()][:2] == [(0, "v 1 2 3"), (1, "f 1 1 1")]
    (tmp_path / "a.json").write_text(json.dumps({"building_id": "b", "extra": [1]}))
    (tmp_path / "b.json").write_text("{oops")
    (tmp_path / "c.json").write_text('{"building_id": 7}')
    (tmp_path / "Index.json").write_text("{}")
    rows = {r.obj_key: (r.status, r.building_id) for r in files.scan_sidecars(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("parsed", "b"), "b": ("failed", None), "c": ("failed", None)}


def test_index_document(spark, tmp_path):
    doc = {"CRS": {"srsName": "EPSG:1"}, "a.obj": {"tag": "{x}Roof", "parentID": ["p"], "gmlID": "g"}, "b": {"tag": "W", "parentID": [], "gmlID": ["h"], "class": "C"}, "bad": {"tag": "W", "parentID": 3, "gmlID": "g"}, "none": 5}
    (tmp_path / "index.json").write_text(json.dumps(doc))
    rows = {r.obj_key: (r.parent_id, r.gml_id, r["class"]) for r in files.scan_index(spark, str(tmp_path / "index.json")).collect()}
    assert rows == {"a.obj": ("p", "g", None), "b": (None, "h", "C")}
    index = files.scan_index(spark, str(tmp_path / "index.json")).withColumnRenamed("obj_key", "obj_filename")
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "obj_key string")
    assert {r.obj_key: r.object_type for r in semantics.semantic_lookup(keys, index).collect()} == {"a": "Roof", "b": "C", "z": "Unknown"}


def test_all_skipped_is_an_error(spark):
    side = spark.createDataFrame([("a", "parsed")], "obj_key string, status string")
    none = spark.createDataFrame([], "obj_key string")
    with pytest.raises(ValueError):
        semantics.require_processed(semantics.outcomes(side, none))


def payload(runs):
    return bytes(b for r in runs for b in r)


def cells(spark, runs, dims):
    df = grids.decode_runs(spark.createDataFrame([("f", bytearray(payload(runs)))], "file_key string, payload binary"))
    return sorted((r.ix, r.iy, r.iz) for r in grids.occupied_cells(df, F.lit(dims[1]), F.lit(dims[2])).collect())


def test_occupied_cells(spark):
    assert cells(spark, [(1, 1), (0, 7)], (2, 2, 2)) == [(0, 0, 0)]
    assert cells(spark, [(0, 5), (1, 1), (0, 18)], (2, 3, 4)) == [(0, 1, 1)]
    full = cells(spark, [(1, 27)], (3, 3, 3))
    assert len(full) == 27 and full[-1] == (2, 2, 2)
    assert cells(spark, [(0, 1), (2, 1), (1, 0), (0, 6)], (2, 2, 2)) == [(0, 0, 1)]


@pytest.mark.parametrize("raw", [b"", b"\x01", b"\x01\x02\x03", bytes(random.Random(4).randbytes(1001))])
def test_decode_runs_twins(spark, raw):
    df = spark.createDataFrame([("f", bytearray(raw))], "file_key string, payload binary")
    expected = [(i, raw[2 * i], raw[2 * i + 1]) for i in range(len(raw) // 2)]
    for decoded in (grids.decode_runs(df, 64), grids.decode_runs(df), grids.decode_runs_arrow(df)):
        assert sorted((r.run_no, r.value, r.n) for r in decoded.collect()) == expected


def test_headers(spark, tmp_path):
    head = b"#binvox 1\ndim 2 3 4\ntranslate 1 2.5 -3e1\n\nscale 0.5\ndata\n"
    cases = {
        "ok": head + b"\x01\x02data\n", "bad_magic": b"binvox\n" + head, "missing_data": head[:-5], "bad_header": head.replace(b"scale", b"color 1\nscale"),
        "missing_dim": head.replace(b"dim 2 3 4\n", b""), "missing_translate": head.replace(b"translate 1 2.5 -3e1\n", b""), "missing_scale": head.replace(b"scale 0.5\n", b""),
    }
    for name, content in cases.items():
        (tmp_path / f"{name}.obj_2.binvox").write_bytes(content)
    rows = {r.file_name.split(".")[0]: r for r in grids.headers(files.scan_grids(spark, str(tmp_path))).collect()}
    assert {k: r.status for k, r in rows.items()} == {k: k for k in cases}
    ok = rows["ok"]
    assert (ok.dx, ok.dy, ok.dz, ok.translate, ok.scale, bytes(ok.payload)) == (2, 3, 4, [1.0, 2.5, -30.0], 0.5, b"\x01\x02data\n")


def test_long_headers(spark):
    head = b"#binvox 1\n" + b"\n" * 6000 + b"dim 2 3 4\ntranslate 1 2.5 -3e1\nscale 0.5\ndata\n"
    row = grids.headers(spark.createDataFrame([("a_7.binvox", bytearray(head + b"\x01\x18"))], "file_name string, content binary")).first()
    assert (row.status, row.dy, bytes(row.payload)) == ("ok", 3, b"\x01\x18")


def test_jobs_over_folders(spark, tmp_path):
    from gridloom.plans import jobs

    corners = [(x, y, z) for x in (0, 4) for y in (0, 4) for z in (0, 4)]
    quads = ["1 2 4 3", "5 6 8 7", "1 2 6 5", "3 4 8 7", "1 3 7 5", "2 4 8 6"]
    (tmp_path / "a.obj").write_text("# cube\n" + "".join(f"v {x} {y} {z}\n" for x, y, z in corners) + "".join(f"f {q}\n" for q in quads))
    (tmp_path / "a.json").write_text('{"building_id": "b1", "polygon_gml_id": "p1", "thematic_role": "RoofSurface"}')
    (tmp_path / "a.obj_2.binvox").write_bytes(b"#binvox 1\ndim 2 2 2\ntranslate 0 0 0\nscale 4\ndata\n\x01\x01\x00\x07")
    rows = jobs.from_meshes(spark, str(tmp_path), target=0.5).collect()
    assert len(rows) == 8**3 - 6**3 and {(r.building_gmlid, r.object_type) for r in rows} == {("b1", "RoofSurface")}
    assert min((r.x, r.y, r.z) for r in rows) == (0.25, 0.25, 0.25)
    one = jobs.from_grids(spark, str(tmp_path)).collect()
    assert [(r.ix, r.iy, r.iz, r.x, r.y, r.z, r.gmlid) for r in one] == [(0, 0, 0, 1.0, 1.0, 1.0, "p1")]
    (tmp_path / "b.obj").write_text("# nothing\n")
    with pytest.raises(ValueError, match="without vertices, first b"):
        jobs.from_meshes(spark, str(tmp_path), target=0.5)


def test_file_key(spark):
    df = spark.createDataFrame([("a.b.obj_64.binvox",), ("a_64.binvox",), ("x",)], "n string")
    k, g = grids.file_key(F.col("n"))
    assert [tuple(r) for r in df.select(k, g).collect()] == [("a.b", 64), ("a_64.binvox", 64), ("x", None)]


def test_strict_length(spark):
    df = spark.createDataFrame([("a", 0, 1, 8), ("b", 0, 1, 7)], "file_key string, run_no int, value int, n int")
    assert {r.file_key: r.valid for r in grids.length_check(df, F.lit(2), F.lit(2), F.lit(2)).collect()} == {"a": True, "b": False}


def triangle_rows():
    rng, out = np.random.default_rng(1), []
    for k in range(40):
        p = rng.uniform(0, 8, (3, 3))
        if k % 7 == 0:
            p[:, 2] = 3.0
        if k % 11 == 0:
            p[1] = p[0]
        if k == 5:
            p = np.round(p)
        out.append(p)
    return out


def brute_cells(triangles, grid):
    found = set()
    for p in triangles:
        edges = [p[1] - p[0], p[2] - p[1], p[0] - p[2]]
        axes = [*np.eye(3), np.cross(edges[0], edges[1]), *(np.cross(a, e) for a in np.eye(3) for e in edges)]
        for cell in np.ndindex(grid, grid, grid):
            q = p - (np.array(cell) + 0.5)
            if all((q @ a).min() <= 0.5 * abs(a).sum() + 1e-9 and (q @ a).max() >= -0.5 * abs(a).sum() - 1e-9 for a in axes):
                found.add(cell)
    return found


@pytest.mark.parametrize("split", [65_536, 4])
def test_voxelize_surface_against_brute_force(spark, split):
    own = triangle_rows()
    schema = "obj_key string, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz")
    df = spark.createDataFrame([("o", *map(float, p.ravel())) for p in own] + [("o", *[math.nan] * 9), ("flat", *[1.0] * 9)], schema)
    grid = spark.createDataFrame([("o", 8, 8.0, 0.0, 0.0, 0.0), ("flat", 8, 0.0, 1.0, 1.0, 1.0)], "obj_key string, grid int, scale double, ox double, oy double, oz double")
    rows = voxelize.voxelize_surface(df, grid, split).collect()
    assert {(r.ix, r.iy, r.iz) for r in rows if r.obj_key == "o"} == brute_cells(own, 8)
    assert [(r.ix, r.iy, r.iz) for r in rows if r.obj_key == "flat"] == [(0, 0, 0)]
    assert len(rows) == len({tuple(r) for r in rows})


def test_faces(spark):
    text = ["v 0 0 0", "v 1 0 0", "v 1 1 0", "v 0 1 0", "f 1/1 2/2 3/3 4/4", "f -1 -2 -3", "f 1 2"]
    df = spark.createDataFrame([("o", i, t) for i, t in enumerate(text)], "obj_key string, line_no int, line string")
    faces = voxelize.faces(df)
    assert sorted((r.a, r.b, r.c) for r in faces.collect()) == [(1, 2, 3), (1, 3, 4), (4, 3, 2)]
    v = mesh.parse_vertices(df).withColumn("vertex_no", F.col("line_no") + 1)
    assert voxelize.triangles_of_faces(v, faces).count() == 3


def test_points_and_world(spark):
    v = spark.createDataFrame([("o", 0.0, 0.0, 0.0), ("o", 8.0, 8.0, 8.0), ("o", 8.0, 8.0, 7.9)], "obj_key string, x double, y double, z double")
    grid = spark.createDataFrame([("o", 8, 8.0, 0.0, 0.0, 0.0)], "obj_key string, grid int, scale double, ox double, oy double, oz double")
    rows = {(r.ix, r.iy, r.iz): r.points for r in voxelize.voxelize_points(v, grid).collect()}
    assert rows == {(0, 0, 0): 1, (7, 7, 7): 2}
    head = spark.createDataFrame([("o", 2.0, [1.0, 2.0, 3.0]), ("p", 2.0, [1.0, 2.0, 3.0])], "obj_key string, scale double, translate array<double>")
    box = mesh.object_bbox(v)
    assert {r.obj_key: (r.ox, r.oy, r.oz) for r in voxels.voxel_origin(head, box).collect()} == {"o": (3.0, 3.0, 3.0), "p": (1.0, 3.0, 2.0)}
