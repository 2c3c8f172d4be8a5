"""Voxel rows: origins, world coordinates, ids, geometry, lookups and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import expressions as X
from gridloom.operators.keys import object_key


def voxel_origin(grids: DataFrame, bboxes: DataFrame) -> DataFrame:
    """Adds ox, oy, oz: the centre of the object's box less half the scale, or the header's translation with y and z exchanged."""
    key = object_key(grids, bboxes)
    boxes = bboxes.select(*key, *[X.centre(F.col(f"{a}min"), F.col(f"{a}max")).alias(f"_{a}") for a in "xyz"])
    joined = grids.join(boxes, key, "left")
    moved = X.unswapped(F.col("translate"))
    return joined.withColumns({f"o{a}": F.coalesce(F.col(f"_{a}") - F.col("scale") * 0.5, moved[k]) for k, a in enumerate("xyz")}).drop("_x", "_y", "_z")


def cube_of_bbox(bboxes: DataFrame, target: float) -> DataFrame:
    """(obj_key, scale, grid, ox, oy, oz): the cube around the box's centre with the box's largest side, and its cells an axis."""
    scaled = bboxes.withColumn("scale", X.max_dimension())
    return scaled.select(*object_key(bboxes), "scale", X.grid_size(F.col("scale"), target).alias("grid"), *[(X.centre(F.col(f"{a}min"), F.col(f"{a}max")) - F.col("scale") * 0.5).alias(f"o{a}") for a in "xyz"])


def world_coordinates(cells: DataFrame) -> DataFrame:
    """Adds x, y, z, the middles of cells: origin + (index + 0.5) * size for each axis (columns o*, i*, s*)."""
    return cells.withColumns({a: F.col(f"o{a}") + (F.col(f"i{a}") + F.lit(0.5)) * F.col(f"s{a}") for a in "xyz"})


def voxel_rows(cells: DataFrame, srid: int = X.DEFAULT_SRID) -> DataFrame:
    """Cells with ids and coordinates as voxel rows: position, point and gmlid, which is the polygon's."""
    position = X.voxel_position(*[F.col(c) for c in ("ix", "iy", "iz", "sx", "sy", "sz")])
    placed = world_coordinates(cells).withColumn("voxel_position", position).withColumn("gmlid", F.col("polygon_gmlid"))
    return placed.withColumn("vox_geom", X.point_z(F.col("x"), F.col("y"), F.col("z"), F.lit(srid)))


def by_id(voxels: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of one gmlid, building, class or object type; reaches the scan as a pushed filter."""
    return voxels.where(F.col(column) == value)


def in_box(voxels: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Rows whose point lies in the closed box."""
    inside = [F.col(a).between(lo, hi) for a, lo, hi in zip("xyz", low, high, strict=True)]
    return voxels.where(inside[0] & inside[1] & inside[2])


def counts(cells: DataFrame, key: str = "file_key") -> DataFrame:
    return cells.groupBy(key).agg(F.count("*").alias("voxels"))


def id_collisions(voxels: DataFrame) -> DataFrame:
    """Positions that several cells of one object share."""
    return voxels.groupBy(*object_key(voxels), "voxel_position").agg(F.count("*").alias("cells")).where("cells > 1")


def colliding_offsets(grids: DataFrame) -> DataFrame:
    """All columns of `grids` (with sx, sy, sz and the cells an axis gx, gy, gz) and dx, dy, dz: every index offset between cells that share a position.

    Two cells share one if and only if 10^8 fx dx + 10^3 fy dy + fz dz = 0 for the factors f of the
    sizes, so offsets follow from the sizes alone. One of each pair of opposite offsets is given, the
    one whose first nonzero part is positive. For each dx that the other axes can make up for, dy runs
    through its range and dz is what is left, if whole and inside the grid; where fz is 0, all dz do.
    An axis of factor 0 doesn't count in a position, so all of its offsets collide. Grids have up to 2048
    cells an axis: a dx is at most 4095 rows, and dx is 0 but for sizes that differ some 50-fold.
    """
    fx, fy, fz = X.position_factors(F.col("sx"), F.col("sy"), F.col("sz"))
    wx, wy, wz = X.POSITION_WEIGHTS
    div = lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double")))
    shaped = grids.withColumns({"_x": fx * wx, "_y": fy * wy, "_z": fz * wz, **{f"_n{a}": F.col(f"g{a}").cast("long") - 1 for a in "xyz"}})
    # how far the other two axes reach
    most = F.when(F.col("_x") == 0, F.col("_nx")).otherwise(F.least(F.col("_nx"), div(F.col("_y") * F.col("_ny") + F.col("_z") * F.col("_nz"), F.col("_x"))))
    swept = shaped.where("_nx >= 0 and _ny >= 0 and _nz >= 0").withColumn("dx", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    swept = swept.withColumn("dy", F.explode(F.sequence(F.when(F.col("dx") > 0, -F.col("_ny")).otherwise(F.lit(0).cast("long")), F.col("_ny"))))
    rest = F.col("_x") * F.col("dx") + F.col("_y") * F.col("dy")
    ahead = (F.col("dx") > 0) | (F.col("dy") > 0)
    whole = swept.where((F.col("_z") > 0) & ahead).withColumn("dz", F.call_function("div", -rest, F.col("_z"))).where((F.col("dz") * F.col("_z") == -rest) & (F.abs("dz") <= F.col("_nz")))
    free = swept.where((F.col("_z") == 0) & (rest == 0)).withColumn("dz", F.explode(F.sequence(F.when(ahead, -F.col("_nz")).otherwise(F.lit(0).cast("long")), F.col("_nz")))).where(ahead | (F.col("dz") > 0))
    return whole.unionByName(free).select(*grids.columns, *[F.col(f"d{a}").cast("int").alias(f"d{a}") for a in "xyz"])


def colliding_pairs(cells: DataFrame, offsets: DataFrame, key: str = "obj_key") -> DataFrame:
    """(key, ix, iy, iz, jx, jy, jz): pairs of cells of one object that share a position, by the offsets of its grid.

    `cells` has each cell once, `offsets` has `key`, dx, dy and dz; an object without offsets has no
    pairs and is not searched. Cells meet by place, so a position is never a group.
    """
    moved = cells.join(offsets.select(key, "dx", "dy", "dz"), key).select(key, "ix", "iy", "iz", *[(F.col(f"i{a}") + F.col(f"d{a}")).alias(f"j{a}") for a in "xyz"])
    other = cells.select(key, *[F.col(f"i{a}").alias(f"j{a}") for a in "xyz"])
    return moved.join(other, [key, "jx", "jy", "jz"]).select(key, "ix", "iy", "iz", "jx", "jy", "jz")


def csv_rows(voxels: DataFrame) -> DataFrame:
    """Voxel rows (with object_type) in the ten columns of the text form: geometry as hex, coordinates as plain decimals."""
    text = {a.upper(): X.plain_decimal(F.col(a)) for a in "xyz"}
    rows = voxels.withColumn("vox_geom", F.hex("vox_geom"))
    return rows.select("voxel_position", "vox_geom", "gmlid", "building_gmlid", "class_gmlid", "polygon_gmlid", "object_type", *[c.alias(n) for n, c in text.items()])


def ids_and_type(keys: DataFrame, sidecars: DataFrame, index: DataFrame) -> DataFrame:
    from gridloom.operators import semantics

    return semantics.semantic_lookup(semantics.resolved_ids(keys, sidecars), index)


def sizes(scale: Column, grid: Column) -> dict[str, Column]:
    return {f"s{a}": F.coalesce(X.voxel_size(scale, grid), F.lit(0.0)) for a in "xyz"}
