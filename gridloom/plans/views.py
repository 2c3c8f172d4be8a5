"""Derived inputs of the registered queries, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The registered queries' voxel size, and the shape and header of the encoded grids.
TARGET = 6.0
DIM = 32
SCALE = 16.0
TRANSLATE = (1.0, 2.0, 3.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mesh_vertex(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("concat('part_', l_partkey) AS obj_key", "l_orderkey", "l_linenumber", "l_quantity AS x", "l_extendedprice / 1000 AS y", "l_discount * 100 AS z")


def mesh_text(spark, sf_dir) -> DataFrame:
    """Mesh lines from the vertices, with a few other lines for each object."""
    v = mesh_vertex(spark, sf_dir)
    lines = v.select("obj_key", F.concat_ws(" ", F.lit("v"), F.col("x").cast("string"), F.col("y").cast("string"), F.col("z").cast("string")).alias("line"))
    noise = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("obj_key"), F.explode(F.array(*map(F.lit, ["# object", "vn 0 0 1", "f 1 2 3", "v\t1 2 3", "v 1d 2 3", "v 1 2"]))).alias("line"))
    return lines.unionByName(noise)


def sidecar(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 17 <> 0").selectExpr(
        "concat('part_', p_partkey) AS obj_key", "p_partkey",
        "CASE WHEN p_size % 10 <> 0 THEN p_brand END AS building_id",
        "CASE WHEN p_size % 11 <> 0 THEN p_type END AS class_gml_id",
        "CASE WHEN p_size % 13 <> 0 THEN concat('poly_', p_partkey) END AS polygon_gml_id",
        "CASE p_size % 7 WHEN 0 THEN 'WallSurface' WHEN 1 THEN 'RoofSurface' WHEN 2 THEN 'GroundSurface' WHEN 3 THEN 'OuterCeilingSurface' WHEN 4 THEN 'BuildingConstructiveElement' WHEN 5 THEN 'ClosureSurface' END AS thematic_role",
        "CASE WHEN p_size % 4 = 0 THEN concat('Ifc', p_type) END AS class",
    )


def parts(spark, sf_dir) -> DataFrame:
    """All object keys, those without sidecar too."""
    return table(spark, sf_dir, "part").selectExpr("concat('part_', p_partkey) AS obj_key", "p_partkey", "p_brand", "p_size", "p_retailprice")


def meshes(spark, sf_dir) -> DataFrame:
    """Objects that have a mesh: all parts but every fifth."""
    return parts(spark, sf_dir).where("p_partkey % 5 <> 0").select("obj_key")


def rle_run(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    # files of bounded size: their number grows with the table
    keyed = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws(".", "p_brand", F.expr("p_partkey div 1000")).alias("file_key"))
    place = F.row_number().over(W.partitionBy("file_key").orderBy("p_partkey")) - 1
    return keyed.select("file_key", place.alias("run_no"), (F.col("p_size") % 3).alias("value"), F.col("p_size").alias("n"))


def tile_event(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("concat('tile_', user_id) AS tile", "event_id", "ts", "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status")


def ledger(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    return tile_event(spark, sf_dir).withColumn("attempt", F.row_number().over(W.partitionBy("tile").orderBy("ts", "event_id")))


#: The same views for SQL, and what follows from them.
SQL = {
    "mesh_vertex": "SELECT concat('part_', l_partkey) AS obj_key, l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem",
    "sidecar": """SELECT concat('part_', p_partkey) AS obj_key, p_partkey,
        CASE WHEN p_size % 10 <> 0 THEN p_brand END AS building_id, CASE WHEN p_size % 11 <> 0 THEN p_type END AS class_gml_id,
        CASE WHEN p_size % 13 <> 0 THEN concat('poly_', p_partkey) END AS polygon_gml_id,
        CASE p_size % 7 WHEN 0 THEN 'WallSurface' WHEN 1 THEN 'RoofSurface' WHEN 2 THEN 'GroundSurface' WHEN 3 THEN 'OuterCeilingSurface' WHEN 4 THEN 'BuildingConstructiveElement' WHEN 5 THEN 'ClosureSurface' END AS thematic_role,
        CASE WHEN p_size % 4 = 0 THEN concat('Ifc', p_type) END AS class FROM part WHERE p_partkey % 17 <> 0""",
    "parts": "SELECT concat('part_', p_partkey) AS obj_key, p_partkey, p_brand, p_size, p_retailprice FROM part",
    "meshes": "SELECT concat('part_', p_partkey) AS obj_key FROM part WHERE p_partkey % 5 <> 0",
    "rle_run": "SELECT concat(p_brand, '.', p_partkey // 1000) AS file_key, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) - 1 AS run_no, p_size % 3 AS value, p_size AS n FROM part",
    "tile_event": "SELECT concat('tile_', user_id) AS tile, event_id, ts, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events",
    "ledger": "SELECT *, row_number() OVER (PARTITION BY tile ORDER BY ts, event_id) AS attempt FROM tile_event",
    "bbox": "SELECT obj_key, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax, CAST(count(*) AS BIGINT) AS n_vertices FROM mesh_vertex GROUP BY obj_key",
    "cube": f"""SELECT obj_key, greatest(xmax - xmin, ymax - ymin, zmax - zmin) AS scale,
        CAST(least(greatest(ceil(greatest(xmax - xmin, ymax - ymin, zmax - zmin) / {TARGET}), 8), 2048) AS INT) AS grid,
        (xmin + xmax) * 0.5 - greatest(xmax - xmin, ymax - ymin, zmax - zmin) * 0.5 AS ox,
        (ymin + ymax) * 0.5 - greatest(xmax - xmin, ymax - ymin, zmax - zmin) * 0.5 AS oy,
        (zmin + zmax) * 0.5 - greatest(xmax - xmin, ymax - ymin, zmax - zmin) * 0.5 AS oz FROM bbox""",
    "cells": """SELECT v.obj_key, grid, scale, ox, oy, oz,
        CAST(CASE WHEN scale > 0 THEN least(greatest(floor((x - ox) / (scale / grid)), 0), grid - 1) ELSE 0 END AS INT) AS ix,
        CAST(CASE WHEN scale > 0 THEN least(greatest(floor((y - oy) / (scale / grid)), 0), grid - 1) ELSE 0 END AS INT) AS iy,
        CAST(CASE WHEN scale > 0 THEN least(greatest(floor((z - oz) / (scale / grid)), 0), grid - 1) ELSE 0 END AS INT) AS iz,
        CAST(count(*) AS BIGINT) AS points FROM mesh_vertex v JOIN cube c ON v.obj_key = c.obj_key GROUP BY ALL""",
    "typed": """SELECT p.obj_key, coalesce(s.building_id, 'UNKNOWN') AS building_gmlid, coalesce(s.class_gml_id, 'UNKNOWN') AS class_gmlid,
        coalesce(s.polygon_gml_id, 'UNKNOWN') AS polygon_gmlid, CASE WHEN s.obj_key IS NULL THEN 'Unknown' ELSE coalesce(s.class, s.thematic_role, 'WallSurface') END AS object_type
        FROM parts p LEFT JOIN sidecar s ON p.obj_key = s.obj_key""",
    "voxels": """SELECT c.obj_key, ix, iy, iz, ox + (ix + 0.5::DOUBLE) * (CASE WHEN scale > 0 THEN scale / grid ELSE 0 END) AS x, oy + (iy + 0.5::DOUBLE) * (CASE WHEN scale > 0 THEN scale / grid ELSE 0 END) AS y,
        oz + (iz + 0.5::DOUBLE) * (CASE WHEN scale > 0 THEN scale / grid ELSE 0 END) AS z,
        CASE WHEN scale > 0 THEN (CAST(ix AS BIGINT) * 2 + 1) * 100000000 + (CAST(iy AS BIGINT) * 2 + 1) * 1000 + CAST(iz AS BIGINT) * 2 + 1 ELSE 100001001 END AS voxel_position,
        polygon_gmlid AS gmlid, building_gmlid, class_gmlid, polygon_gmlid, object_type FROM cells c JOIN typed t ON c.obj_key = t.obj_key""",
    # every coordinate with the bytes of its double in hex, least byte first: exponent and fraction by arithmetic that is exact for doubles
    "double_bytes": """SELECT v, concat(substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) AS le FROM (
        SELECT v, lpad(hex(CASE WHEN v = 0 THEN 0::UBIGINT ELSE CASE WHEN v < 0 THEN 9223372036854775808::UBIGINT ELSE 0::UBIGINT END
            + CAST(e + 1023 AS UBIGINT) * 4503599627370496::UBIGINT + CAST((abs(v) / pow(2.0, e) - 1) * 4503599627370496.0::DOUBLE AS UBIGINT) END), 16, '0') AS h FROM (
        SELECT v, e0 + CASE WHEN abs(v) >= pow(2.0, e0 + 1) THEN 1 WHEN abs(v) < pow(2.0, e0) THEN -1 ELSE 0 END AS e FROM (
        SELECT v, CASE WHEN v = 0 THEN 0 ELSE CAST(floor(log2(abs(v))) AS INT) END AS e0 FROM (SELECT x AS v FROM voxels UNION SELECT y FROM voxels UNION SELECT z FROM voxels))))""",
    # points as EWKB with z and SRID 25832
    "points": """SELECT r.*, concat('01010000A0E8640000', b1.le, b2.le, b3.le) AS vox_geom FROM voxels r JOIN double_bytes b1 ON b1.v = r.x JOIN double_bytes b2 ON b2.v = r.y JOIN double_bytes b3 ON b3.v = r.z""",
}
NEEDS = {"ledger": ["tile_event"], "bbox": ["mesh_vertex"], "cube": ["bbox"], "cells": ["mesh_vertex", "cube"], "typed": ["parts", "sidecar"], "voxels": ["cells", "typed"], "double_bytes": ["voxels"], "points": ["voxels", "double_bytes"]}


def with_views(body: str, *names: str) -> str:
    """A statement that first defines the named views and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body
