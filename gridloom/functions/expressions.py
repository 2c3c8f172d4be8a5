"""Column expressions: bounding boxes, grid sizes, voxel ids, tags, decimal text and point geometry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed limits of a grid and the grid taken where nothing is known.
MIN_GRID, MAX_GRID, FALLBACK_GRID = 8, 2048, 256
DEFAULT_VOXEL_SIZE, DEFAULT_SRID = 0.5, 25832
UNKNOWN = "UNKNOWN"

#: Fixed namespaces and the roles that belong to the first.
BUILDING_NAMESPACE = "{http://www.opengis.net/citygml/building/2.0}"
CONSTRUCTION_NAMESPACE = "{http://www.opengis.net/citygml/construction/3.0}"
BUILDING_ROLES = ("WallSurface", "RoofSurface", "GroundSurface", "OuterCeilingSurface", "OuterFloorSurface", "ClosureSurface")

#: Text that counts as a number: decimal, with or without exponent, or a spelled infinity or NaN.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])$"


def centre(low: Column, high: Column) -> Column:
    return (low + high) * 0.5


def max_dimension(prefix: str = "") -> Column:
    return F.greatest(*[F.col(f"{prefix}{a}max") - F.col(f"{prefix}{a}min") for a in "xyz"])


def grid_size(dimension: Column, target: float) -> Column:
    """ceil(dimension / target), held between 8 and 2048; NaN gives the least grid, infinity the largest."""
    if not (target > 0 and target < float("inf")):
        raise ValueError("the target voxel size must be positive and finite")
    cells = F.when(F.isnan(dimension), 0.0).otherwise(F.ceil(F.least(dimension / F.lit(target), F.lit(1e9))).cast("double"))
    return F.least(F.greatest(cells, F.lit(float(MIN_GRID))), F.lit(float(MAX_GRID))).cast("int")


def voxel_size(scale: Column, dim: Column) -> Column:
    return F.try_divide(scale.cast("double"), dim.cast("double"))


def unswapped(translate: Column) -> Column:
    """Header translations have y and z exchanged."""
    return F.array(translate[0], translate[2], translate[1])


def linear_index(x: Column, y: Column, z: Column, dy: Column, dz: Column) -> Column:
    return (x.cast("long") * dy + y) * dz + z


def cell_of(index: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    plane = dy.cast("long") * dz
    rest = index % plane
    return F.call_function("div", index, plane).cast("int"), F.call_function("div", rest, dz.cast("long")).cast("int"), (rest % dz).cast("int")


#: Fixed weights of the three indices in a voxel's position.
POSITION_WEIGHTS = (100_000_000, 1_000, 1)


def position_factors(sx: Column, sy: Column, sz: Column) -> tuple[Column, Column, Column]:
    """Each size in half smallest sizes, rounded; 0 where it isn't positive and finite."""
    edge = F.least(sx, sy, sz) * 0.5

    def factor(size: Column) -> Column:
        ratio = F.try_divide(size, edge)
        return F.coalesce(F.when(F.isnan(ratio) | (F.abs(ratio) == float("inf")), 0.0).otherwise(F.round(ratio)), F.lit(0.0)).cast("long")

    return factor(sx), factor(sy), factor(sz)


def voxel_position(ix: Column, iy: Column, iz: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """i * 10^8 + j * 10^3 + k, where each is index * factor + 1 with the factors of position_factors().

    Ids are unique inside small grids only: k may need four digits, which then run into j's
    (see voxels.colliding_offsets).
    """
    parts = [(i.cast("long") * f + 1) * w for i, f, w in zip((ix, iy, iz), position_factors(sx, sy, sz), POSITION_WEIGHTS, strict=True)]
    return parts[0] + parts[1] + parts[2]


def namespaced_tag(role: Column) -> Column:
    return F.concat(F.when(role.isin(*BUILDING_ROLES), BUILDING_NAMESPACE).otherwise(CONSTRUCTION_NAMESPACE), role)


def without_namespace(tag: Column) -> Column:
    return F.when(tag.contains("}"), F.trim(F.substring_index(tag, "}", -1))).otherwise(tag)


def object_type(cls: Column, tag: Column) -> Column:
    return F.coalesce(cls, without_namespace(tag), F.lit("Unknown"))


def first_of(value: Column) -> Column:
    """First string of a VARIANT that holds a string or a list of strings; null for an empty list and for anything else."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "ARRAY<STRING>", F.try_variant_get(value, "$[0]", "string"))


def crs_name(srid: Column) -> Column:
    return F.concat(F.lit("EPSG:"), srid.cast("string"))


def total_cells(dx: Column, dy: Column, dz: Column) -> Column:
    return dx.cast("long") * dy.cast("long") * dz.cast("long")


def tile_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.gml$", "")


def _spread(x: Column, text: Column) -> Column:
    """A number's text in scientific form as a plain decimal, with as many zeros as its power of ten asks for."""
    power = F.substring_index(text, "E", -1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "E", 1), "[-.]", ""), "(?<=.)0+$", "")
    zeros = lambda n: F.repeat(F.lit("0"), n)
    whole = F.concat(digits, zeros(power + 1 - F.length(digits)))
    cut = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    plain = F.when(power < 0, F.concat(F.lit("0."), zeros(-power - 1), digits)).when(F.length(digits) <= power + 1, whole).otherwise(cut)
    return F.concat(F.when(x < 0, "-").otherwise(""), plain)


def plain_decimal(x: Column) -> Column:
    """The shortest text of a double without exponent and without a trailing `.0`; every digit stays, however small or large the number.

    Java 17 gives some doubles a digit too many: a text of 15 or 16 digits is taken where it reads back as
    the same double.
    """
    text = x.cast("string")
    some, more = (F.format_string(f"%.{n}E", x) for n in (14, 15))
    fewer = F.when(some.cast("double") == x, some).when(more.cast("double") == x, more).otherwise(text)
    long = F.length(text) > 16
    # through a list of one, so that the rare long way has the text once and not again for each part
    spread = F.transform(F.array(F.when(long, fewer).otherwise(text)), lambda t: _spread(x, t))[0]
    shown = F.when(text.contains("E") | (long & (more.cast("double") == x)), spread).otherwise(F.regexp_replace(text, r"\.0$", ""))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, F.when(text.startswith("-"), "-0").otherwise("0")).otherwise(shown)


def _reversed_bytes(hexed: Column, n: int) -> Column:
    return F.concat(*[F.substring(hexed, 2 * k + 1, 2) for k in reversed(range(n))])


def _double_le(x: Column) -> Column:
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("long")
    return _reversed_bytes(F.lpad(F.hex(bits), 16, "0"), 8)


def point_z_hex(x: Column, y: Column, z: Column, srid: Column) -> Column:
    """Upper-case hex of a little-endian EWKB point with z and SRID: 33 bytes."""
    head = F.concat(F.lit("01010000A0"), _reversed_bytes(F.lpad(F.hex(srid.cast("long")), 8, "0"), 4))
    return F.concat(head, *[_double_le(v) for v in (x, y, z)])


def point_z(x: Column, y: Column, z: Column, srid: Column) -> Column:
    return F.unhex(point_z_hex(x, y, z, srid))


def point_z_arrow(srid: int = DEFAULT_SRID):
    """The same bytes by an Arrow UDF, for wide tables where the native form's text work shows."""

    @F.pandas_udf("binary")
    def build(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        kind = np.dtype([("order", "u1"), ("type", "<u4"), ("srid", "<u4"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")])
        for x, y, z in batches:
            rows = np.zeros(len(x), dtype=kind)
            rows["order"], rows["type"], rows["srid"] = 1, 0xA0000001, srid
            rows["x"], rows["y"], rows["z"] = x, y, z
            raw = rows.tobytes()
            yield pd.Series([raw[i : i + 33] for i in range(0, len(raw), 33)])

    return build
