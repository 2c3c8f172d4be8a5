"""Documents in lines: their text, their order, and very large ones."""

import glob
import json

from pyspark.sql import functions as F

from gridloom.operators import documents, mesh, semantics


def text_of(path, group):
    (name,) = glob.glob(f"{path}/tile={group}/*.txt")
    return open(name, encoding="utf-8").read()


def test_lines_are_the_same_documents(spark, tmp_path):
    rows = [("t", f'o"{k}é', float(k), k + 1.0, 0.0, 2.0, -1.0, 9.0) for k in range(23)] + [("u", "x", 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)]
    boxes = spark.createDataFrame(rows, "tile string, obj_key string, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double").repartition(3)
    grids = mesh.grid_mapping(boxes, 0.5)
    sidecars = boxes.select("tile", "obj_key", F.lit("b").alias("building_id"), F.lit(None).cast("string").alias("class_gml_id"), F.lit("p").alias("polygon_gml_id"), F.lit("RoofSurface").alias("thematic_role"), F.lit(None).cast("string").alias("class"))
    index = semantics.index_entry(sidecars)
    whole = {
        "boxes": (documents.bbox_document_lines(boxes, "tile", 5), mesh.bbox_documents(boxes, "tile")),
        "grids": (documents.grid_document_lines(grids, "tile", 0.5, 5), mesh.grid_documents(grids, "tile", 0.5)),
        "index": (documents.index_document_lines(index, "tile", 25832, chunk=5), semantics.index_documents(index, "tile", 25832)),
    }
    for name, (lines, one) in whole.items():
        path = str(tmp_path / name)
        documents.write_documents(lines, path, "tile")
        for row in one.collect():
            text = text_of(path, row.tile)
            assert json.loads(text) == json.loads(row.document)
            if row.tile == "t":
                assert len(text.splitlines()) >= 7
                found = [k for line in text.splitlines()[1:-1] for k in json.loads("{" + line.lstrip(",") + "}")]
                assert found == sorted(found) and len(found) == 23
    back = {(r.tile, r.name, r.value) for r in documents.read_entries(spark, str(tmp_path / "grids")).collect()}
    assert back == {(r.tile, r.obj_filename, str(r.grid)) for r in grids.collect()}


def test_a_group_without_entries_and_one_without_head(spark, tmp_path):
    entries = spark.createDataFrame([("a", "n", "1"), ("lost", "n", "1")], "tile string, name string, value string")
    heads = spark.createDataFrame([("a", "{"), ("empty", "{")], "tile string, head string")
    documents.write_documents(documents.document_lines(entries, heads, "}", "tile"), str(tmp_path / "d"), "tile")
    assert json.loads(text_of(tmp_path / "d", "a")) == {"n": 1} and json.loads(text_of(tmp_path / "d", "empty")) == {}
    assert not glob.glob(f"{tmp_path}/d/tile=lost*")


def test_a_tile_of_a_million_objects_is_written_and_read(spark, tmp_path):
    mapping = spark.range(1_000_000).select(F.lit("t").alias("tile"), F.concat(F.lit("object_"), "id", F.lit(".obj")).alias("obj_filename"), (8 + F.col("id") % 900).cast("int").alias("grid"))
    path = str(tmp_path / "big")
    documents.write_documents(documents.grid_document_lines(mapping, "tile", 0.5), path, "tile")
    back = documents.read_entries(spark, path)
    mark = lambda name, grid: [F.count("*"), F.sum(F.xxhash64(name, F.col(grid).cast("int")).cast("decimal(38,0)"))]
    assert back.agg(*mark("name", "value")).first() == mapping.agg(*mark("obj_filename", "grid")).first()
