"""Tiles whose objects have the same names, and meshes that are read in many parts."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import mesh, semantics, voxelize, voxels
from gridloom.operators.keys import object_key
from gridloom.plans import jobs
from gridloom.sources import files

QUADS = ["1 2 4 3", "5 6 8 7", "1 2 6 5", "3 4 8 7", "1 3 7 5", "2 4 8 6"]


def cube(size, at=0):
    corners = [(x, y, z) for x in (at, at + size) for y in (at, at + size) for z in (at, at + size)]
    return "# cube\n" + "".join(f"v {x} {y} {z}\n" for x, y, z in corners) + "".join(f"f {q}\n" for q in QUADS)


@pytest.fixture
def two_tiles(tmp_path):
    """Objects a and b in both tiles, of other sizes, ids and types; a loose file beside the tiles."""
    root = tmp_path / "in"
    for tile, size, role in (("east", 4, "RoofSurface"), ("west", 2, "GroundSurface")):
        (root / tile / "deep").mkdir(parents=True)
        (root / tile / "a.obj").write_text(cube(size))
        (root / tile / "deep" / "b.obj").write_text(cube(size + 1, at=10))
        (root / tile / "a.json").write_text(f'{{"building_id": "{tile}_a", "polygon_gml_id": "p_{tile}", "thematic_role": "{role}"}}')
        (root / tile / f"a.obj_{size}.binvox").write_bytes(f"#binvox 1\ndim 2 2 2\ntranslate 0 0 0\nscale {size}\ndata\n".encode() + b"\x01\x01\x00\x07")
    (root / "west" / "deep" / "b.json").write_text('{"building_id": "west_b", "class": "Shed"}')
    (root / "a.obj").write_text(cube(50))
    return str(root)


def test_equal_names_in_two_tiles_are_two_objects(spark, two_tiles):
    rows = jobs.from_meshes(spark, two_tiles, target=0.5, tiles=True)
    shell = lambda n: n**3 - (n - 2) ** 3
    found = {(r.tile, r.obj_key): (r.n, r.building_gmlid, r.object_type, r.x) for r in rows.groupBy("tile", "obj_key", "building_gmlid", "object_type").agg(F.count("*").alias("n"), F.min("x").alias("x")).collect()}
    assert found == {
        ("east", "a"): (shell(8), "east_a", "RoofSurface", 0.25), ("east", "b"): (shell(10), "UNKNOWN", "Unknown", 10.25),
        ("west", "a"): (shell(8), "west_a", "GroundSurface", 0.125), ("west", "b"): (shell(8), "west_b", "Shed", 10 + 3 / 16),
    }
    assert rows.groupBy("tile", "obj_key", "ix", "iy", "iz").count().where("count > 1").count() == 0


def test_encoded_grids_of_tiles(spark, two_tiles):
    found = {(r.tile, r.obj_key, r.x, r.gmlid, r.object_type) for r in jobs.from_grids(spark, two_tiles, tiles=True).collect()}
    assert found == {("east", "a", 1.0, "p_east", "RoofSurface"), ("west", "a", 0.5, "p_west", "GroundSurface")}


def test_boxes_and_grids_by_tile(spark, two_tiles):
    boxes = mesh.object_bbox(mesh.parse_vertices(files.scan_mesh(spark, two_tiles, tiles=True)))
    assert {(r.tile, r.xmin, r.xmax) for r in mesh.global_bbox(boxes).collect()} == {("east", 0.0, 15.0), ("west", 0.0, 13.0)}
    mapping = mesh.grid_mapping(boxes, 0.1)
    assert {(r.tile, r.grid, r.percent) for r in mesh.grid_histogram(mapping).collect()} == {("east", 40, 50.0), ("east", 50, 50.0), ("west", 20, 50.0), ("west", 30, 50.0)}
    keys = spark.createDataFrame([("east", "new"), ("west", "new"), ("west", "a"), ("north", "x")], "tile string, obj_key string")
    assert {tuple(r) for r in mesh.grid_lookup(keys, mapping).select("tile", "obj_key", "grid").collect()} == {("east", "new", 50), ("west", "new", 30), ("west", "a", 20), ("north", "x", 256)}
    side = files.scan_sidecars(spark, two_tiles, tiles=True)
    assert tuple(semantics.outcomes(side, boxes).first()) == (3, 0) and semantics.outcomes(side, boxes.where("tile = 'east'")).first().skipped == 2


def test_a_table_with_tiles_and_one_without_do_not_meet(spark):
    with_tile = spark.createDataFrame([("t", "a", "b", "c", "d")], "tile string, obj_key string, building_id string, class_gml_id string, polygon_gml_id string")
    with pytest.raises(ValueError, match="column tile"):
        semantics.resolved_ids(with_tile.drop("tile"), with_tile)
    with pytest.raises(ValueError, match="column tile"):
        semantics.semantic_lookup(with_tile.select("obj_key"), with_tile.withColumns({"obj_filename": F.lit("a"), "class": F.lit("c"), "tag": F.lit("d")}))
    assert object_key(with_tile, with_tile) == ["tile", "obj_key"] and object_key(with_tile.drop("tile")) == ["obj_key"]


def wild_mesh(seed, n=400):
    """Vertices, unreadable vertices, and faces that count from either end, in any order."""
    rng, out, seen = random.Random(seed), ["# start"], 0
    for _ in range(n):
        kind = rng.random()
        if seen < 4 or kind < 0.5:
            out.append("v " + " ".join(f"{rng.uniform(0, 9):.3f}" for _ in range(3)))
            seen += 1
        elif kind < 0.55:
            out.append("v broken 1 2")
            seen += 1
        elif kind < 0.6:
            out.append("vn 0 0 1")
        else:
            out.append("f " + " ".join(str(-rng.randint(1, seen)) if rng.random() < 0.5 else f"{rng.randint(1, seen)}/1/2" for _ in range(rng.randint(3, 5))))
    return "\n".join(out) + rng.choice(["", "\n"])


def plain_triangles(text):
    """Fans of all faces, by one loop over the lines."""
    points, out = [], []
    for line in text.split("\n"):
        parts = line.split()
        if line.startswith("v "):
            points.append(None if parts[1] == "broken" else tuple(map(float, parts[1:4])))
        elif line.startswith("f "):
            n = [int(p.split("/")[0]) for p in parts[1:]]
            n = [len(points) + 1 + k if k < 0 else k for k in n]
            out += [(n[0], n[i], n[i + 1]) for i in range(1, len(n) - 1)]
    return sorted(tuple(x for k in t for x in points[k - 1]) for t in out if all(points[k - 1] for k in t))


@pytest.mark.parametrize("part_bytes", [97, 2000, 10_000_000])
def test_meshes_in_parts_equal_whole_files(spark, tmp_path, part_bytes):
    texts = {f"m{k}": wild_mesh(k, 40 if k else 900) for k in range(3)}
    for name, text in texts.items():
        (tmp_path / f"{name}.obj").write_text(text)
    settings = {"spark.sql.files.maxPartitionBytes": part_bytes, "spark.sql.files.openCostInBytes": 1, "spark.sql.files.minPartitionNum": 1}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        lines = files.scan_mesh(spark, str(tmp_path))
        blocks = lines.select("obj_key", "block").distinct().groupBy("obj_key").count().collect()
        found = voxelize.triangles_of_faces(voxelize.vertex_numbers(lines), voxelize.faces(lines)).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    if part_bytes == 97:
        assert {r.obj_key: r["count"] for r in blocks}["m0"] > 50
    whole = files.mesh_lines(files.text_files(spark, str(tmp_path), "*.obj"))
    also = voxelize.triangles_of_faces(voxelize.vertex_numbers(whole), voxelize.faces(whole)).collect()
    for name, text in texts.items():
        expected = plain_triangles(text)
        assert sorted(tuple(r)[1:] for r in found if r.obj_key == name) == expected
        assert sorted(tuple(r)[1:] for r in also if r.obj_key == name) == expected


def test_points_job_gives_each_voxel_once(spark):
    points = spark.createDataFrame([("t", "a", float(x), 0.0, 0.0) for x in (0, 0, 1, 7)] + [("u", "a", 1.0, 2.0, 3.0)], "tile string, obj_key string, x double, y double, z double")
    side = spark.createDataFrame([("u", "a", "b", None, "p", None, None)], "tile string, obj_key string, building_id string, class_gml_id string, polygon_gml_id string, thematic_role string, class string")
    rows = {(r.tile, r.ix, r.points, r.building_gmlid, r.gmlid) for r in jobs.voxels_of_points(points, side, 1.0).collect()}
    assert rows == {("t", 0, 2, "UNKNOWN", "UNKNOWN"), ("t", 1, 1, "UNKNOWN", "UNKNOWN"), ("t", 7, 1, "UNKNOWN", "UNKNOWN"), ("u", 0, 1, "b", "p")}
    assert voxels.counts(spark.createDataFrame([("f",)], "file_key string")).first().voxels == 1
