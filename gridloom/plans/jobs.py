"""Whole jobs over folders: meshes, sidecars and encoded grids in, voxel rows out.

With `tiles` each folder inside the given one is a tile: rows bear its name, and objects of equal names in
two tiles are two objects throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.operators import grids, mesh, semantics, voxelize, voxels
from gridloom.operators.keys import object_key, tile_key
from gridloom.sources import files, ranges, shared


def named(keys: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The rows of `keys` with ids and type of their object."""
    return voxels.ids_and_type(keys, sidecars, semantics.index_entry(sidecars))


def voxels_of_points(points: DataFrame, sidecars: DataFrame, target: float = X.DEFAULT_VOXEL_SIZE, srid: int = X.DEFAULT_SRID) -> DataFrame:
    """Voxel rows of all cells that hold a vertex, placed by each object's own box and named by its sidecar.

    Points are dealt out by object once, to as many tasks as their files ask for; boxes, cells and names then
    need no further shuffle of them, and no task grows with the input.
    """
    key = object_key(points, sidecars)
    points = points.select(*key, "x", "y", "z").repartition(shared.tasks_for(points), *key)
    cube = voxels.cube_of_bbox(mesh.object_bbox(points), target)
    cells = voxelize.voxelize_points(points, cube)
    placed = named(cube.withColumns(voxels.sizes(F.col("scale"), F.col("grid"))), sidecars)
    return voxels.voxel_rows(cells.join(placed, key), srid)


def from_meshes(spark: SparkSession, folder: str, target: float = X.DEFAULT_VOXEL_SIZE, srid: int = X.DEFAULT_SRID, tiles: bool = False) -> DataFrame:
    """Voxel rows of the surfaces of all meshes in a folder, named by the sidecars beside them. A mesh without vertices is an error.

    Meshes are read in parts and numbered by prefix sums over these, so a mesh of any size is many tasks' work.
    """
    lines = files.scan_mesh(spark, folder, tiles)
    key = object_key(lines)
    boxes = mesh.object_bbox(mesh.parse_vertices(lines))
    mesh.require_vertices(files.mesh_names(spark, folder, tiles), boxes)
    cube = voxels.cube_of_bbox(boxes, target)
    cells = voxelize.voxelize_surface(voxelize.triangles_of_faces(voxelize.vertex_numbers(lines), voxelize.faces(lines)), cube)
    side = files.scan_sidecars(spark, folder, tiles).where("status = 'parsed'")
    placed = named(cube.withColumns(voxels.sizes(F.col("scale"), F.col("grid"))), side)
    return voxels.voxel_rows(cells.join(placed, key), srid)


def from_grids(spark: SparkSession, folder: str, srid: int = X.DEFAULT_SRID, tiles: bool = False, range_bytes: int | None = ranges.RANGE_BYTES) -> DataFrame:
    """Voxel rows of all encoded grids in a folder, placed by the meshes beside them, else by their headers; broken files are left out.

    Files of any size are read in byte ranges; with None they are read whole by Spark's own reader, for stores
    that it alone reaches.
    """
    if range_bytes is None:
        read = grids.named_grids(grids.headers(files.scan_grids(spark, folder, tiles)).where("status = 'ok'"))
        read = read.withColumn("file_key", F.concat_ws("/", *tile_key(read), "file_name"))
        payloads = read.select("file_key", "payload")
    else:
        headed, parts = ranges.scan_grid_ranges(spark, folder, range_bytes, tiles)
        read = grids.named_grids(headed.where("status = 'ok'").withColumnRenamed("path", "file_key"))
        payloads = parts.withColumnRenamed("path", "file_key")
    tile = tile_key(read)
    shape = read.select(*tile, "file_key", "obj_key", "dx", "dy", "dz", "scale", "translate")
    runs = grids.decode_runs(payloads).join(shape.select("file_key", "dy", "dz"), "file_key")
    cells = grids.occupied_cells(runs, F.col("dy"), F.col("dz"))
    boxes = mesh.object_bbox(mesh.parse_vertices(files.scan_mesh(spark, folder, tiles)))
    sizes = {f"s{a}": F.coalesce(X.voxel_size(F.col("scale"), F.col(f"d{a}")), F.lit(0.0)) for a in "xyz"}
    side = files.scan_sidecars(spark, folder, tiles).where("status = 'parsed'")
    placed = named(voxels.voxel_origin(shape, boxes).withColumns(sizes), side)
    return voxels.voxel_rows(cells.join(placed, "file_key"), srid)
