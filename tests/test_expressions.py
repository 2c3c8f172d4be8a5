"""Golden values of the column expressions."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from gridloom.functions import expressions as X


def one(spark, column, row=((0,),), schema="k int"):
    return spark.createDataFrame(list(row), schema).select(column.alias("v")).first()["v"]


def point(spark, x, y, z, srid=25832):
    return one(spark, X.point_z(*[F.lit(float(v)) for v in (x, y, z)], F.lit(srid)))


def test_point_bytes(spark):
    raw = bytes(point(spark, 1, 2, 3))
    assert len(raw) == 33 and raw[:9].hex().upper() == "01010000A0E8640000"
    assert raw[9:] == struct.pack("<3d", 1, 2, 3)
    assert one(spark, X.point_z_hex(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(25832))).startswith("01010000A0E8640000")


def test_point_arrow_twin(spark):
    df = spark.createDataFrame([(1.5, -2.25, 1e300), (0.0, -0.0, 7.0)], "x double, y double, z double")
    native = df.select(X.point_z(F.col("x"), F.col("y"), F.col("z"), F.lit(25832)).alias("v")).collect()
    arrow = df.select(X.point_z_arrow(25832)("x", "y", "z").alias("v")).collect()
    assert native == arrow


@pytest.mark.parametrize("d,t,g", [(10.0, 0.5, 20), (0.1, 0.5, 8), (5000.0, 1.0, 2048), (127.9, 0.5, 256), (math.nan, 1.0, 8), (math.inf, 1.0, 2048)])
def test_grid_size(spark, d, t, g):
    assert one(spark, X.grid_size(F.lit(d), t)) == g


@pytest.mark.parametrize("t", [0.0, -1.0, math.inf, math.nan])
def test_grid_target_must_be_positive_and_finite(t):
    with pytest.raises(ValueError):
        X.grid_size(F.lit(1.0), t)


def position(spark, cell, size):
    return one(spark, X.voxel_position(*map(F.lit, cell), *map(F.lit, size)))


def test_voxel_position(spark):
    assert position(spark, (0, 0, 0), (0.5, 0.5, 0.5)) == 100001001
    assert position(spark, (1, 2, 3), (0.5, 0.5, 0.5)) == 300005007
    assert position(spark, (1, 1, 1), (1.0, 0.5, 0.25)) == 900005003
    assert position(spark, (5, 5, 5), (0.0, 0.0, 0.0)) == 100001001
    assert position(spark, (0, 0, 1000), (1.0, 1.0, 1.0)) == position(spark, (0, 1, 0), (1.0, 1.0, 1.0))


def test_tags(spark):
    assert one(spark, X.namespaced_tag(F.lit("WallSurface"))) == "{http://www.opengis.net/citygml/building/2.0}WallSurface"
    assert one(spark, X.namespaced_tag(F.lit("BuildingConstructiveElement"))) == "{http://www.opengis.net/citygml/construction/3.0}BuildingConstructiveElement"
    assert one(spark, X.without_namespace(F.lit("{a}{b} Roof "))) == "Roof"
    assert one(spark, X.without_namespace(F.lit(" plain "))) == " plain "


@pytest.mark.parametrize("text,expected", [('"x"', "x"), ('["DEBY_LOD2_4907506"]', "DEBY_LOD2_4907506"), ('["a","b"]', "a"), ("[]", None), ("7", None), ('[1,"a"]', None)])
def test_first_of(spark, text, expected):
    assert one(spark, X.first_of(F.parse_json(F.lit(text)))) == expected


def test_sizes_and_boxes(spark):
    assert [one(spark, X.voxel_size(F.lit(1.0), F.lit(d))) for d in (10, 20, 40)] == [0.1, 0.05, 0.025]
    assert one(spark, X.voxel_size(F.lit(1.0), F.lit(0))) is None
    box = spark.createDataFrame([(0.0, 4.0, 0.0, 3.0, 0.0, 2.0)], "xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    assert box.select(X.max_dimension().alias("v")).first()["v"] == 4.0
    assert one(spark, X.unswapped(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))) == [1.0, 3.0, 2.0]
    assert one(spark, X.crs_name(F.lit(25832))) == "EPSG:25832"
    assert one(spark, X.total_cells(F.lit(2048), F.lit(2048), F.lit(2048))) == 2048**3
    assert one(spark, X.tile_name(F.lit("a.gml"))) == "a"
    assert one(spark, X.linear_index(F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(5))) == 33


@pytest.mark.parametrize("v,text", [(690800.0, "690800"), (12345678.5, "12345678.5"), (0.0, "0"), (-0.0, "-0"), (1.5, "1.5"), (1e-7, "0.0000001"), (123456789.25, "123456789.25"), (-20000000.0, "-20000000"), (math.nan, "NaN"), (math.inf, "inf"), (-math.inf, "-inf"), (100.0, "100")])
def test_plain_decimal(spark, v, text):
    assert one(spark, X.plain_decimal(F.lit(v))) == text


@pytest.mark.parametrize(("v", "text"), [(6.938893903907228e-18, "0.000000000000000006938893903907228"), (-8.881784197001252e-16, "-0.0000000000000008881784197001252"), (8e-5, "0.00008"), (1e23, "100000000000000000000000"), (2.5e17, "250000000000000000"), (12345678901.25, "12345678901.25")])
def test_plain_decimal_keeps_every_digit(spark, v, text):
    """As text and in the SQL twin, which once gave an exponent."""
    import duckdb

    from gridloom.plans.catalogue import plain_sql

    assert one(spark, X.plain_decimal(F.lit(v))) == text
    assert duckdb.execute(f"SELECT {plain_sql('x')} FROM (SELECT {v!r}::DOUBLE AS x)").fetchone()[0] == text
